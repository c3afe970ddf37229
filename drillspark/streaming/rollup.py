"""Hourly rollup that grows with every batch of trips and stays compact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.exact import PLACES, decimal_sum
from ..functions.times import hour_start
from .levels import LeveledTable

KEYS = ["hour", "PULocationID"]
PARTIAL_SCHEMA = (
    f"hour timestamp_ntz, PULocationID bigint, trips bigint, revenue decimal(38,{PLACES}), distance decimal(38,{PLACES})"
)


def hourly_partials(trips: DataFrame) -> DataFrame:
    """Trips, revenue and distance per (hour, pickup zone), as sums that add up exactly."""
    return trips.groupBy(
        hour_start("tpep_pickup_datetime").cast("timestamp_ntz").alias("hour"),
        F.col("PULocationID").cast("bigint").alias("PULocationID"),
    ).agg(
        F.count("*").alias("trips"),
        decimal_sum("total_amount").alias("revenue"),
        decimal_sum("trip_distance").alias("distance"),
    )


def combined(partials: DataFrame) -> DataFrame:
    """One partial row per (hour, zone)."""
    return partials.groupBy(*KEYS).agg(
        F.sum("trips").alias("trips"),
        F.sum("revenue").cast(f"decimal(38,{PLACES})").alias("revenue"),
        F.sum("distance").cast(f"decimal(38,{PLACES})").alias("distance"),
    )


def rollup_table(spark: SparkSession, out: str, fan_in: int = 8) -> LeveledTable:
    return LeveledTable(spark, out, PARTIAL_SCHEMA, combined, fan_in)


def start_hourly_rollup(stream: DataFrame, out: str, checkpoint: str, once: bool = True, fan_in: int = 8) -> StreamingQuery:
    """Add the partial sums of each batch to the table at ``out``; rows may be as late as they like.

    A batch that runs again counts once. Parts are combined as they gather, so the table stays compact however long the
    stream runs. The stream keeps no state.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        rollup_table(batch.sparkSession, out, fan_in).add(hourly_partials(batch), batch_id)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_rollup(spark: SparkSession, out: str) -> DataFrame:
    """The rollup as it stands: partial sums added up per (hour, zone)."""
    return combined(rollup_table(spark, out).read()).withColumns({c: F.col(c).cast("double") for c in ("revenue", "distance")})


def first_hours(spark: SparkSession, out: str, n: int | None = 24) -> DataFrame:
    """Trips and revenue of the first ``n`` hours over all zones, or of all hours."""
    hours = rollup_table(spark, out).read().groupBy("hour").agg(
        F.sum("trips").alias("total_trips"), F.sum("revenue").cast("double").alias("total_revenue")
    )
    return hours.orderBy("hour") if n is None else hours.orderBy("hour").limit(n)


def compact_rollup(spark: SparkSession, out: str, target: str | None = None) -> int:
    """Combine all parts into one, in place, also between two batches of a stream; or into a new table at ``target``.

    Returns the number of parts that are left.
    """
    table = rollup_table(spark, out)
    if target is None:
        return table.merge(everything=True)
    copy = rollup_table(spark, target)
    copy.add(combined(table.read()), max((p.last for p in table.manifest().parts), default=-1) + 1)
    return len(copy.manifest().parts)
