"""Hourly, daily, monthly and route rollups of trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.formats import make_id
from .stats import grouped

PICKUP, DROPOFF = "tpep_pickup_datetime", "tpep_dropoff_datetime"


def rollup_hourly(df: DataFrame) -> DataFrame:
    """One row per (date, hour) with id ``yyyyMMdd_HH``."""
    rollup = grouped(
        df.withColumn("_minutes", times.minutes_elapsed(PICKUP, DROPOFF)),
        {"pickup_date": times.day_of(PICKUP), "pickup_hour": times.hour_of(PICKUP)},
        "trip_count",
        {"total_revenue": "total_amount", "total_passengers": "passenger_count"},
        {
            "avg_fare": "total_amount",
            "avg_distance": "trip_distance",
            "avg_tip": "tip_amount",
            "avg_duration_min": "_minutes",
        },
    )
    hour = F.lpad(F.col("pickup_hour").cast("string"), 2, "0")
    return rollup.withColumn("id", make_id(times.fmt_ts("pickup_date", "yyyyMMdd"), hour))


def rollup_routes(df: DataFrame, min_trips: int = 10) -> DataFrame:
    """One row per (pickup, drop-off zone) with at least ``min_trips`` trips, id ``PU_DO``."""
    rollup = grouped(
        df,
        ["PULocationID", "DOLocationID"],
        "trip_count",
        {"total_revenue": "total_amount"},
        {"avg_fare": "total_amount", "avg_distance": "trip_distance", "avg_tip": "tip_amount"},
    )
    return rollup.where(F.col("trip_count") >= min_trips).withColumn("id", make_id("PULocationID", "DOLocationID"))


def rollup_daily(df: DataFrame) -> DataFrame:
    """One row per date with id ``yyyyMMdd`` and the name of the day."""
    rollup = grouped(
        df,
        {"pickup_date": times.day_of(PICKUP), "pickup_dayofweek": times.weekday(PICKUP)},
        "trip_count",
        {"total_revenue": "total_amount", "total_passengers": "passenger_count"},
        {"avg_fare": "total_amount", "avg_distance": "trip_distance", "avg_tip": "tip_amount"},
        {"max_fare": "total_amount", "max_distance": "trip_distance"},
    )
    return rollup.withColumn("id", times.fmt_ts("pickup_date", "yyyyMMdd")).withColumn(
        "day_name", times.fmt_ts("pickup_date", "EEEE")
    )


def by_month(df: DataFrame) -> DataFrame:
    """Trips and revenue per ``yyyyMM``."""
    return grouped(df, {"month": times.month_key(PICKUP)}, "trips", {"revenue": "total_amount"}).orderBy("month")
