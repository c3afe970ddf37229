"""Trip files of several months with slightly different schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The declared schema of a trip file.
TRIP_SCHEMA = T.StructType(
    [
        T.StructField("VendorID", T.LongType()),
        T.StructField("tpep_pickup_datetime", T.TimestampNTZType()),
        T.StructField("tpep_dropoff_datetime", T.TimestampNTZType()),
        T.StructField("passenger_count", T.DoubleType()),
        T.StructField("trip_distance", T.DoubleType()),
        T.StructField("RatecodeID", T.DoubleType()),
        T.StructField("store_and_fwd_flag", T.StringType()),
        T.StructField("PULocationID", T.LongType()),
        T.StructField("DOLocationID", T.LongType()),
        T.StructField("payment_type", T.LongType()),
        T.StructField("fare_amount", T.DoubleType()),
        T.StructField("extra", T.DoubleType()),
        T.StructField("mta_tax", T.DoubleType()),
        T.StructField("tip_amount", T.DoubleType()),
        T.StructField("tolls_amount", T.DoubleType()),
        T.StructField("improvement_surcharge", T.DoubleType()),
        T.StructField("total_amount", T.DoubleType()),
        T.StructField("congestion_surcharge", T.DoubleType()),
        T.StructField("airport_fee", T.DoubleType()),
    ]
)
# Spellings to repair, and columns that keep their type when files are brought together.
RENAMES = {"Airport_fee": "airport_fee"}
KEEP_TYPES = ["tpep_pickup_datetime", "tpep_dropoff_datetime", "store_and_fwd_flag"]


def read_trips(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """One or many Parquet files or folders of one schema, read from the first file if none is given.

    With ``TRIP_SCHEMA`` no file is opened to plan the query, and a column that a file lacks is null.
    """
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(*paths)


def common_columns(dfs: list[DataFrame]) -> list[str]:
    """Column names all frames have (case counts), in alphabetic order."""
    return sorted(set.intersection(*[set(df.columns) for df in dfs]))


def harmonise(
    dfs: list[DataFrame], renames: dict[str, str] = RENAMES, keep_types: list[str] = KEEP_TYPES
) -> list[DataFrame]:
    """The frames with equal names, their common columns only, and every column but ``keep_types`` as double."""

    def renamed(df: DataFrame) -> DataFrame:
        return df.toDF(*[renames.get(c, c) for c in df.columns])

    dfs = [renamed(df) for df in dfs]
    names = common_columns(dfs)
    casts = [F.col(c) if c in keep_types else F.col(c).cast("double").alias(c) for c in names]
    return [df.select(*casts) for df in dfs]


def union_months(dfs: list[DataFrame], **options) -> DataFrame:
    """All rows of the harmonised frames; duplicates stay."""
    return reduce(DataFrame.unionByName, harmonise(dfs, **options))
