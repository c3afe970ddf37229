"""Overviews of error events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exact import exact_avg
from .filters import EVENT_FIELDS, Fields, Filters, compile_filters
from .toplists import first_rows, with_whole

# Severities that count as alerts.
ALERT_SEVERITIES = ["error", "critical"]


def top_alerts(df: DataFrame, filters: Filters | None = None, n: int | None = 5, fields: Fields = EVENT_FIELDS) -> DataFrame:
    """Host and service pairs with most alerts (all of them without ``n``), their averages and latest alert.

    ``total_events`` counts all filtered events, alerts or not; list and total come from one scan.
    """
    alert = F.col("severity").isin(ALERT_SEVERITIES)

    latest = F.max_by(
        F.struct("message", "event_ts", "severity"), F.when(alert, F.struct("event_ts", "event_id"))
    )
    measures = ["cpu_percent", "memory_percent", "response_time_ms"]
    rows = df.where(compile_filters(filters, fields))
    marked = rows.withColumns({f"_{m}": F.when(alert, F.col(m)) for m in measures})
    cpu, memory, response = [F.coalesce(exact_avg(f"_{m}"), F.lit(0.0)) for m in measures]
    pairs = marked.groupBy("host", "service").agg(
        F.count("*").alias("all_events"),
        F.count_if(alert).alias("error_count"),
        cpu.alias("avg_cpu"),
        memory.alias("avg_memory"),
        response.alias("avg_response_ms"),
        latest.alias("latest"),
    )
    listed = with_whole(pairs, ["host", "service"], {"total_events": F.coalesce(F.sum("all_events"), F.lit(0))})
    order = [F.desc("error_count"), "host", "service"]
    return first_rows(listed, F.col("error_count") > 0, order, n, ["total_events"]).select(
        "host",
        "service",
        "error_count",
        "avg_cpu",
        "avg_memory",
        "avg_response_ms",
        F.col("latest.message").alias("latest_message"),
        F.col("latest.event_ts").alias("latest_timestamp"),
        F.col("latest.severity").alias("latest_severity"),
        "total_events",
    )


def host_overview(df: DataFrame, n: int | None = 10) -> DataFrame:
    """Events, alerts, alert share and load of the ``n`` hosts with most events, or of all."""
    stats = df.groupBy("host").agg(
        F.count("*").alias("events"),
        F.count_if(F.col("severity").isin(ALERT_SEVERITIES)).alias("errors"),
        exact_avg("cpu_percent").alias("avg_cpu"),
        exact_avg("memory_percent").alias("avg_memory"),
    )
    share = F.when(F.col("events") > 0, F.col("errors") * 100.0 / F.col("events")).otherwise(0.0)
    hosts = stats.withColumn("error_percent", share).orderBy(F.desc("events"), "host")
    return hosts if n is None else hosts.limit(n)
