"""Views that give the driver tables the shape of trips, zones, monitoring events, samples, counters and series.

Each view is a projection: one expression per column, valid in Spark SQL (and, but for one, in the SQL of the check).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import prepare

TRIPS = {
    "trip_order": "l_orderkey",
    "trip_line": "l_linenumber",
    "VendorID": "l_linenumber",
    "tpep_pickup_datetime": "l_shipdate + INTERVAL '1' MINUTE * ((l_orderkey*37) % 1440)"
    " + INTERVAL '1' SECOND * (l_partkey % 60)",
    "tpep_dropoff_datetime": "l_shipdate + INTERVAL '1' MINUTE * ((l_orderkey*37) % 1440)"
    " + INTERVAL '1' SECOND * (l_partkey % 60 + 30 + (l_orderkey*7919 + l_linenumber*104729) % 7800)",
    "passenger_count": "CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE CAST(l_linenumber AS DOUBLE) END",
    "trip_distance": "(l_quantity - 1) * 2.1",
    "store_and_fwd_flag": "CASE WHEN l_returnflag = 'N' THEN 'N' ELSE 'Y' END",
    "PULocationID": "l_suppkey % 265 + 1",
    "DOLocationID": "l_partkey % 20 + 1",
    "payment_type": "(l_orderkey + l_linenumber) % 6 + 1",
    "fare_amount": "l_extendedprice/200 - 5",
    "tip_amount": "(l_extendedprice/200 - 5) * l_discount",
    "total_amount": "(l_extendedprice/200 - 5) * (1 + l_discount + l_tax)",
}

MONITORING = {
    "event_id": "event_id",
    "event_ts": "ts",
    "host": "'host-' || CAST(user_id % 5 AS VARCHAR(5))",
    "service": "'svc-' || CAST(event_id % 6 AS VARCHAR(5))",
    "event_type": "CASE event_type WHEN 'error' THEN 'alert' WHEN 'view' THEN 'metric' ELSE 'log' END",
    "severity": "CASE WHEN (event_id*31) % 100 < 70 THEN 'info' WHEN (event_id*31) % 100 < 90 THEN 'warning'"
    " WHEN (event_id*31) % 100 < 98 THEN 'error' ELSE 'critical' END",
    "message": "CASE WHEN event_id % 5 = 0 THEN 'No reply from 192.168.7.9 in time: timeout'"
    " WHEN event_id % 5 = 1 THEN 'Every pooled connection is taken, can’t open more'"
    " WHEN event_id % 5 = 2 THEN 'A slow query over access_log read 1,204 rows' ELSE 'All checks of the node are fine' END",
    "cpu_percent": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST((event_id*13) % 91 + 5 AS DOUBLE) END",
    "memory_percent": "CAST((event_id*17) % 71 + 20 AS DOUBLE)",
    "response_time_ms": "CAST(floor(value*5) AS INT)",
    "status_code": "CASE event_id % 5 WHEN 0 THEN 500 WHEN 1 THEN 404 ELSE 200 END",
    "bytes_sent": "(event_id*7919) % 1000000 + 100",
}

SAMPLES = {
    "host": "'host-' || CAST(user_id % 5 AS VARCHAR(5))",
    "process": "'proc-' || CAST(user_id AS VARCHAR(8))",
    "metricGroup": "event_type",
    "metricName": "'value'",
    "timestamp_ms": "unix_millis(CAST(ts AS TIMESTAMP))",
    "value": "CASE WHEN event_id % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 101 = 0"
    " THEN CAST('Infinity' AS DOUBLE) WHEN event_id % 89 = 0 THEN -1.0 ELSE value END",
}

# A counter per user that grows with the event number and starts again at 0 every 1000 events.
COUNTERS = {"user_id": "user_id", "event_id": "event_id", "ts": "ts", "value": "event_id % 1000"}

PROM_SERIES = {
    "metric_name": "lower(p_type) || '_' || replace(p_name, ' ', '_') || CASE WHEN p_size % 17 = 0 THEN '_info' ELSE '' END",
    "job": "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE lower(p_type) END",
    "instance": "'node' || CAST(p_partkey % 5 AS VARCHAR(5)) || '.nodes.example:9100'",
    "brand": "p_brand",
    "size": "CAST(p_size AS VARCHAR(5))",
    "quantile": "CASE WHEN p_partkey % 3 = 0 THEN '0.99' ELSE NULL END",
}


def columns(view: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in view.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*columns(TRIPS))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        (F.col("n_nationkey") + 1).alias("zone_id"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("borough"),
        F.substring("r_name", 1, 2).alias("short"),
    )


def monitoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*columns(MONITORING))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*columns(SAMPLES))


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*columns(COUNTERS))


def prom_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per series with its label map; absent labels are not in the map."""
    flat = table(spark, sf_dir, "part").selectExpr(*columns(PROM_SERIES))
    names = {"__name__": "metric_name", **{n: n for n in ("job", "instance", "brand", "size", "quantile")}}
    pairs = [piece for label, column in names.items() for piece in (F.lit(label), F.col(column))]
    full = F.create_map(*pairs)
    return flat.select(F.map_filter(full, lambda k, v: v.isNotNull()).alias("labels"))


def prom_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of a metric by the length of its name; one third of the names has none."""
    name = PROM_SERIES["metric_name"]
    return (
        table(spark, sf_dir, "part")
        .selectExpr(f"{name} AS metric_name")
        .distinct()
        .where("length(metric_name) % 3 < 2")
        .selectExpr("metric_name", "CASE WHEN length(metric_name) % 3 = 0 THEN 'counter' ELSE 'gauge' END AS type")
    )
