"""Histograms over numbers and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import bucket_label
from ..functions.times import hour_start


def range_facet(
    df: DataFrame, column: str, start: int = 0, end: int = 100, gap: int = 10, keep_empty: bool = False, style: str = "money"
) -> DataFrame:
    """Rows per bucket of ``[start, end)``: (val, label, count); empty buckets only with ``keep_empty``."""
    c = F.col(column)
    low = (F.floor((c - start) / gap) * gap + start).cast("int")
    counts = df.where((c >= start) & (c < end)).groupBy(low.alias("val")).agg(F.count("*").alias("count"))
    if keep_empty:
        frame = df.sparkSession.range(start, end, gap).select(F.col("id").cast("int").alias("val"))
        counts = frame.join(counts, "val", "left").select("val", F.coalesce("count", F.lit(0)).alias("count"))
    return counts.select("val", bucket_label("val", gap, style).alias("label"), "count").orderBy("val")


def histogram(df: DataFrame, column: str, interval: int, style: str = "ms") -> DataFrame:
    """Rows per interval without bounds, non-empty intervals only."""
    low = (F.floor(F.col(column) / interval) * interval).cast("bigint")
    counts = df.where(F.col(column).isNotNull()).groupBy(low.alias("val")).agg(F.count("*").alias("count"))
    return counts.select("val", bucket_label("val", interval, style).alias("label"), "count").orderBy("val")


def events_per_hour(df: DataFrame, by: str | None = None, fill: bool = False, ts: str = "event_ts") -> DataFrame:
    """Events per full hour, on request per value of ``by``; ``fill`` adds the hours without events as 0."""
    if fill and by:
        raise ValueError("only whole hours are filled, not hours per value")
    counts = df.groupBy(hour_start(ts).alias("hour"), *([by] if by else [])).agg(F.count("*").alias("count"))
    if not fill:
        return counts.orderBy("hour", *([by] if by else []))
    # All hours between the first and the last; the list is as long as the time span has hours.
    span = counts.agg(F.min("hour").alias("first"), F.max("hour").alias("last"))
    hours = span.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL '1' HOUR"))).alias("hour"))
    filled = hours.join(counts, "hour", "left")
    return filled.select("hour", F.coalesce("count", F.lit(0)).alias("count")).orderBy("hour")
