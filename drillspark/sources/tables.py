"""Tables: load once, partition by month, describe."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import month_key


def _has_rows(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def load_if_empty(df: DataFrame, target: str) -> bool:
    """Append the rows to a table unless it holds some; True if rows were written.

    ``target`` is a path if it has a slash, else a table of the catalogue. One row is looked at, nothing is counted.
    """
    spark = df.sparkSession
    if "/" in target:
        if _has_rows(spark, target):
            return False
        df.write.mode("overwrite").parquet(target)
        return True
    if spark.catalog.tableExists(target) and not spark.table(target).isEmpty():
        return False
    df.write.mode("append").saveAsTable(target)
    return True


def with_partitions(df: DataFrame, pickup: str = "tpep_pickup_datetime") -> DataFrame:
    """Adds ``month``, the folder of a row, and ``pickup_date``, whose ranges Parquet can skip by."""
    return df.withColumn("month", month_key(pickup)).withColumn("pickup_date", F.to_date(pickup))


def write_trips(df: DataFrame, path: str, pickup: str = "tpep_pickup_datetime", zone: str = "PULocationID") -> None:
    """One folder per month, files sorted by pickup time and zone.

    The rows are rebalanced by month: adaptive execution splits large months over many tasks and joins small ones, so
    a month with a third of all rows becomes many files instead of one long task.
    """
    placed = with_partitions(df, pickup).hint("rebalance", F.col("month"))
    ordered = placed.sortWithinPartitions("month", pickup, zone)
    ordered.write.mode("overwrite").partitionBy("month").parquet(path)


def read_months(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, pickup: str = "tpep_pickup_datetime"
) -> DataFrame:
    """Trips of a monthly table between two ISO times, both included.

    Months outside are not listed. Inside them Parquet skips by date, as filters on times without zone are not pushed
    down to it.
    """
    df = spark.read.parquet(path).drop("_batch")  # a folder below the month, in tables that a stream loads
    df = df.withColumn("month", F.col("month").cast("string"))
    month, date, time = F.col("month"), F.col("pickup_date"), F.col(pickup)
    if start:
        limit = F.lit(start).cast("timestamp_ntz")
        df = df.where((month >= start[:7].replace("-", "")) & (date >= F.lit(start[:10]).cast("date")) & (time >= limit))
    if end:
        limit = F.lit(end).cast("timestamp_ntz")
        df = df.where((month <= end[:7].replace("-", "")) & (date <= F.lit(end[:10]).cast("date")) & (time <= limit))
    return df


def describe_schema(df: DataFrame) -> list[tuple[int, str, str, bool]]:
    """(position, column, type, nullable)."""
    return [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields, 1)]


def preview(df: DataFrame, order: list[Column | str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def describe_table(df: DataFrame, order: list[Column | str], n: int = 5) -> DataFrame:
    """Columns with their types and the values of the first ``n`` rows: (position, column, type, value)."""
    cells = [
        F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("column"),
            F.lit(kind).alias("type"),
            F.col(name).cast("string").alias("value"),
        )
        for position, name, kind, _ in describe_schema(df)
    ]
    return preview(df, order, n).select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def dataset_profile(df: DataFrame) -> DataFrame:
    """Rows, files and bytes of a file-based frame; rows are counted per file first, no column is read."""
    files = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    per_file = files.groupBy("path").agg(F.count("*").alias("rows"), F.max("size").alias("size"))
    return per_file.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count("*").alias("files"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
    )
