"""Serving tables: small rollups written whole, read back for display."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import on_disk
from .documents import to_documents, unwrap

_open: dict[tuple[str, str], DataFrame] = {}


def publish(df: DataFrame, path: str) -> DataFrame:
    """Replace the table at ``path`` by these rows in document form and return it as written."""
    docs = to_documents(df)
    docs.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(docs.schema).parquet(path)


def publish_once(spark: SparkSession, path: str, build: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """The serving table at ``path``, built and published if there is none yet, or anew if ``fresh``.

    The table outlives the query that built it; further calls in the same application list no files and read no footers.
    """
    key = (spark.sparkContext.applicationId, path)
    files, done = on_disk(spark, f"{path}/_SUCCESS")
    if fresh or not files.exists(done):
        _open[key] = publish(build(), path)
    elif key not in _open:
        _open[key] = spark.read.parquet(path)
    return _open[key]


def read_serving(spark: SparkSession, path: str, order: list[Column | str], numbers: list[str] | None = None) -> DataFrame:
    """A serving table in display order; ``numbers`` are read as double, unreadable values as null."""
    return displayed(spark.read.parquet(path), order, numbers)


def displayed(table: DataFrame, order: list[Column | str], numbers: list[str] | None = None) -> DataFrame:
    """The same for an open serving table."""
    df = unwrap(table)
    for name in numbers or []:
        df = df.withColumn(name, F.expr(f"try_cast(`{name}` AS DOUBLE)"))
    return df.orderBy(*order)


def _first(ordered: DataFrame, n: int | None) -> DataFrame:
    return ordered if n is None else ordered.limit(n)


def serving_day(hourly: DataFrame, day: str | None = None) -> DataFrame:
    """The hours of one day (``yyyy-MM-dd``), of the newest day if none is given."""
    day = day or hourly.agg(F.max("pickup_date")).scalar()
    return hourly.where(F.col("pickup_date") == day).orderBy("pickup_hour")


def serving_top_routes(routes: DataFrame, n: int | None = 10) -> DataFrame:
    """The routes with most revenue, or all of them."""
    return _first(routes.orderBy(F.desc("total_revenue"), "id"), n)


def serving_last_days(daily: DataFrame, n: int | None = 10) -> DataFrame:
    """The newest days, or all of them."""
    return _first(daily.orderBy(F.desc("pickup_date")), n)


def serving_dow(daily: DataFrame) -> DataFrame:
    """Days per name of day."""
    return daily.groupBy("day_name").agg(F.count("*").alias("days")).orderBy(F.desc("days"), "day_name")
