"""Names for zone ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Zones from one JSON object ``{"1": {"name": .., "borough": .., "short": ..}, ...}``."""
    shape = "map<string,struct<name:string,borough:string,short:string>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", shape)).alias("id", "zone")).select(
        F.col("id").cast("int").alias("zone_id"), "zone.*"
    )


def with_zone(df: DataFrame, zones: DataFrame, column: str, prefix: str) -> DataFrame:
    """Adds ``<prefix>_name``, ``_label`` ("name (short)"), ``_borough`` and ``_short``; unknown ids get defaults.

    No broadcast is forced: Spark broadcasts the zones if their size allows it and joins by shuffle otherwise.
    """
    named = zones.select(
        F.col("zone_id").alias("_zone"),
        F.col("name").alias("_name"),
        F.col("borough").alias("_borough"),
        F.col("short").alias("_short"),
    )
    fallback = F.concat(F.lit("Zone "), F.col(column).cast("string"))
    full = F.concat("_name", F.lit(" ("), F.col("_short"), F.lit(")"))
    return (
        df.join(named, F.col(column) == F.col("_zone"), "left")
        .withColumn(f"{prefix}_name", F.coalesce("_name", fallback))
        .withColumn(f"{prefix}_label", F.coalesce(full, fallback))
        .withColumn(f"{prefix}_borough", F.coalesce("_borough", F.lit("Unknown")))
        .withColumn(f"{prefix}_short", F.coalesce("_short", F.lit("N/A")))
        .drop("_zone", "_name", "_borough", "_short")
    )
