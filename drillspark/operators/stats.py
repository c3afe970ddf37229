"""Grouped statistics of trips and monitoring events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.exact import exact_avg, exact_sum, resum
from .filters import EVENT_FIELDS, TRIP_FIELDS, Fields, Filters, compile_filters


def grouped(
    df: DataFrame,
    keys: Mapping[str, Column] | list[str],
    count: str,
    sums: Mapping[str, str] | None = None,
    avgs: Mapping[str, str] | None = None,
    maxs: Mapping[str, str] | None = None,
) -> DataFrame:
    """Count, exact sums, exact averages and maxima of columns per key, combined on the map side."""
    if not isinstance(keys, Mapping):
        keys = {k: F.col(k) for k in keys}
    measures = [F.count("*").alias(count)]
    measures += [exact_sum(c).alias(n) for n, c in (sums or {}).items()]
    measures += [exact_avg(c).alias(n) for n, c in (avgs or {}).items()]
    measures += [F.max(c).alias(n) for n, c in (maxs or {}).items()]
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*measures)


def stats_by(df: DataFrame, filters: Filters, field: str, fields: Fields = TRIP_FIELDS) -> DataFrame:
    """Trips, sum and average of the amount per value of a field, by ascending value."""
    by = fields.group_column(field)
    rows = df.where(compile_filters(filters, fields))
    return grouped(
        rows, {field: by}, "count", {"sum_total_amount": "total_amount"}, {"avg_total_amount": "total_amount"}
    ).orderBy(field)


def event_stats(df: DataFrame, filters: Filters, field: str, fields: Fields = EVENT_FIELDS, limit: int | None = None) -> DataFrame:
    """Events, average response and bytes per value of a field: the largest groups first, hours and the like in order.

    All groups are shown, that of missing values too, or the ``limit`` first ones.
    """
    by = fields.group_column(field)
    rows = df.where(compile_filters(filters, fields))
    stats = rows.groupBy(by.alias(field)).agg(
        F.count("*").alias("count"),
        exact_avg("response_time_ms").alias("avg_response_time_ms"),
        exact_sum("bytes_sent", 0).alias("sum_bytes_sent"),
    )
    stats = stats.orderBy(field) if field in fields.virtual else stats.orderBy(F.desc("count"), F.asc(field))
    return stats if limit is None else stats.limit(limit)


def facet_hour(df: DataFrame) -> DataFrame:
    """Events per hour of day over all days."""
    return df.groupBy(times.hour_of("event_ts").alias("event_hour")).agg(F.count("*").alias("count")).orderBy("event_hour")


def overall_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("total_trips"),
        exact_sum("fare_amount").alias("total_fares"),
        exact_sum("tip_amount").alias("total_tips"),
        exact_sum("total_amount").alias("total_revenue"),
        exact_avg("trip_distance").alias("avg_distance"),
        exact_avg("fare_amount").alias("avg_fare"),
        exact_avg("tip_amount").alias("avg_tip"),
        exact_avg("total_amount").alias("avg_total"),
        exact_avg("passenger_count").alias("avg_passengers"),
        exact_sum("trip_distance").alias("total_distance"),
    )


def by_weekday(df: DataFrame, convention: str = "sun1") -> DataFrame:
    return grouped(
        df,
        {"weekday": times.weekday("tpep_pickup_datetime", convention)},
        "trips",
        {"revenue": "total_amount"},
        {"avg_amount": "total_amount", "avg_distance": "trip_distance", "avg_tip": "tip_amount"},
    ).orderBy("weekday")


def by_hour(df: DataFrame) -> DataFrame:
    return grouped(
        df,
        {"hour": times.hour_of("tpep_pickup_datetime")},
        "trips",
        {"revenue": "total_amount"},
        {"avg_amount": "total_amount"},
    ).orderBy("hour")


def by_passengers(df: DataFrame) -> DataFrame:
    return grouped(
        df,
        ["passenger_count"],
        "trips",
        {"revenue": "total_amount"},
        {"avg_amount": "total_amount", "avg_distance": "trip_distance"},
    ).orderBy("passenger_count")


def top_zones(df: DataFrame, n: int | None = 10) -> DataFrame:
    """Pickup zones with most trips, or all of them."""
    stats = grouped(
        df,
        ["PULocationID"],
        "trips",
        {"revenue": "total_amount"},
        {"avg_amount": "total_amount", "avg_distance": "trip_distance"},
    )
    zones = stats.orderBy(F.desc("trips"), F.asc("PULocationID"))
    return zones if n is None else zones.limit(n)


def hour_money(df: DataFrame, distance: bool = False) -> DataFrame:
    """Sum and averages of money per pickup hour, on request with the average distance."""
    avgs = {"avg_total_amount": "total_amount", "avg_tip_amount": "tip_amount"}
    if distance:
        avgs["avg_trip_distance"] = "trip_distance"
    hour = times.hour_of("tpep_pickup_datetime")
    return grouped(df, {"pickup_hour": hour}, "count", {"sum_total_amount": "total_amount"}, avgs).orderBy("pickup_hour")


def with_share(stats: DataFrame, column: str, width: int = 20) -> DataFrame:
    """Adds the share of the total in percent and the length of a bar whose longest has ``width`` characters."""
    whole = stats.agg(F.struct(F.sum(column).alias("total"), F.max(column).alias("longest"))).scalar()
    n = F.col(column).cast("double")
    shown = stats.withColumn("share_percent", n * 100 / whole["total"])
    return shown.withColumn("bar", (n / whole["longest"] * width).cast("int"))


def kpi_cards(hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """Headline numbers from hourly and daily statistics: weighted and plain averages, peak hour, totals."""
    peak = F.max_by("pickup_hour", F.struct(F.col("count"), -F.col("pickup_hour")))
    weighted = hourly.withColumn("_weighted", F.col("avg_total_amount") * F.col("count"))
    cards = weighted.agg(
        F.sum("count").alias("trips"),
        resum("sum_total_amount").alias("total_revenue"),
        peak.alias("peak_hour"),
        (resum("_weighted") / F.sum("count")).alias("avg_from_averages"),
    ).withColumn("avg_fare", F.col("total_revenue") / F.col("trips"))
    return cards.withColumn("mean_daily_avg_fare", daily.agg(exact_avg("avg_fare")).scalar())
