"""Plausibility rules and profiles of trips."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.exact import exact_avg
from ..functions.formats import band
from .rollups import DROPOFF, PICKUP


# Upper ends of the distance bands in miles, and their names.
DISTANCE_BANDS = ([2, 5, 10], ["0-2 mi", "2-5 mi", "5-10 mi", "10+ mi"])


def plausible() -> Column:
    """0 < distance < 100, 0 < fare < 500, 0 < passengers <= 6."""
    distance, fare, passengers = F.col("trip_distance"), F.col("fare_amount"), F.col("passenger_count")
    return (distance > 0) & (distance < 100) & (fare > 0) & (fare < 500) & (passengers > 0) & (passengers <= 6)


def moving() -> Column:
    """The lighter rule: some distance and a fare above zero."""
    return (F.col("trip_distance") > 0) & (F.col("fare_amount") > 0)


def clean_trips(df: DataFrame) -> DataFrame:
    return df.where(plausible())


def clean_report(df: DataFrame) -> DataFrame:
    """Rows before and after cleaning and the share removed, from one scan."""
    counts = df.agg(F.count("*").alias("rows_before"), F.count_if(plausible()).alias("rows_after"))
    removed = F.col("rows_before") - F.col("rows_after")
    return counts.withColumn("rows_removed", removed).withColumn(
        "removed_percent", F.when(F.col("rows_before") > 0, removed * 100.0 / F.col("rows_before"))
    )


def duration(mode: str = "elapsed") -> Column:
    """Trip minutes: ``elapsed`` time, or minute marks crossed (``boundary``)."""
    if mode == "elapsed":
        return times.minutes_elapsed(PICKUP, DROPOFF)
    if mode == "boundary":
        return times.minute_boundaries(PICKUP, DROPOFF)
    raise ValueError(f"unknown duration mode: {mode}")


def payable(mode: str = "elapsed") -> Column:
    """The part of ``valid`` that needs no duration: an amount above zero and, for ``elapsed``, both zones."""
    paid = F.col("total_amount") > 0
    if mode == "boundary":
        return paid
    return paid & F.col("PULocationID").isNotNull() & F.col("DOLocationID").isNotNull()


def plausible_duration(minutes: Column, mode: str = "elapsed") -> Column:
    return minutes.between(1, 120) if mode == "boundary" else (minutes > 1) & (minutes < 120)


def valid(mode: str = "elapsed") -> Column:
    """Trips fit for route ranking.

    ``elapsed``: more than 1 and less than 120 minutes, an amount above zero, both zones known.
    ``boundary``: 1 to 120 minute marks, an amount above zero.
    """
    return payable(mode) & plausible_duration(duration(mode), mode)


def valid_trips(df: DataFrame, mode: str = "elapsed") -> DataFrame:
    return df.where(valid(mode))


def _as_rows(wide: DataFrame, names: list[str]) -> DataFrame:
    """One struct column per name becomes one row per name."""
    return wide.select(F.explode(F.array(*[F.col(f"`{n}`") for n in names])).alias("row")).select("row.*")


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values per column: (column, nulls, percent)."""
    names = columns or df.columns
    nulls = [F.count_if(F.col(n).isNull()) for n in names]
    rows = [
        F.struct(F.lit(n).alias("column"), k.alias("nulls"), (k * 100.0 / F.count("*")).alias("percent")).alias(n)
        for n, k in zip(names, nulls)
    ]
    return _as_rows(df.agg(*rows), names)


def value_ranges(df: DataFrame) -> DataFrame:
    return df.agg(
        F.min("trip_distance").alias("min_distance"),
        F.max("trip_distance").alias("max_distance"),
        F.min("fare_amount").alias("min_fare"),
        F.max("fare_amount").alias("max_fare"),
        F.min(PICKUP).alias("first_pickup"),
        F.max(PICKUP).alias("last_pickup"),
    )


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, count, mean, stddev, min, max) with the sample standard deviation."""
    rows = [
        F.struct(
            F.lit(n).alias("column"),
            F.count(n).alias("count"),
            exact_avg(n).alias("mean"),
            F.stddev_samp(n).alias("stddev"),
            F.min(n).cast("double").alias("min"),
            F.max(n).cast("double").alias("max"),
        ).alias(n)
        for n in columns
    ]
    return _as_rows(df.agg(*rows), columns)


def corr_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns over complete rows: (a, b, corr), from one scan."""
    complete = df.dropna(subset=columns)
    pairs = list(combinations_with_replacement(columns, 2))
    wide = complete.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = []
    for a, b in pairs:
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{a}|{b}`").alias("corr")))
    return wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def tip_by_distance(df: DataFrame) -> DataFrame:
    """Average tip rate (percent of the fare), tip and total per distance band."""
    rate = F.when(F.col("fare_amount") > 0, F.col("tip_amount") / F.col("fare_amount") * 100).otherwise(0)
    miles = band("trip_distance", *DISTANCE_BANDS).alias("distance_bucket")
    stats = df.withColumn("_rate", rate).groupBy(miles).agg(
        F.count("*").alias("trips"),
        exact_avg("_rate").alias("avg_tip_rate"),
        exact_avg("tip_amount").alias("avg_tip"),
        exact_avg("total_amount").alias("avg_total"),
    )
    return stats.orderBy("distance_bucket")


def longest_trips(df: DataFrame, n: int = 10) -> DataFrame:
    """The longest trips by distance in tenths of a mile, earlier ones first among equals."""
    return _shown(df.orderBy(F.desc(F.round("trip_distance", 1)), *_TIES).limit(n))


def priciest_trips(df: DataFrame, n: int = 10) -> DataFrame:
    """The trips with the largest amount in cents, earlier ones first among equals."""
    return _shown(df.orderBy(F.desc(F.round("total_amount", 2)), *_TIES).limit(n))


_TIES = [PICKUP, DROPOFF, "trip_distance", "fare_amount", "tip_amount", "total_amount"]


def _shown(df: DataFrame) -> DataFrame:
    """Trips as listed for a reader: minutes, one decimal for miles, cents for money."""
    return df.select(
        times.fmt_ts(PICKUP, "yyyy-MM-dd HH:mm").alias("pickup"),
        F.round("trip_distance", 1).alias("distance"),
        F.round("fare_amount", 2).alias("fare"),
        F.round("tip_amount", 2).alias("tip"),
        F.round("total_amount", 2).alias("total"),
    )
