"""Exact quantiles that never bring one group into one task."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .joins import join_on


def quantiles(df: DataFrame, column: str, probabilities: list[float], by: list[str] | None = None) -> DataFrame:
    """(by.., p, value): the smallest value whose share of rows up to it reaches p; missing values do not count.

    1. Count rows per group and value (combined on the map side: few rows remain where values repeat).
    2. Sort by group and value over all tasks and write the sorted slices.
    3. Add up the counts per slice to see which slice holds each wanted rank.
    4. Look for the value inside those slices only.
    Whatever the size of a group, a task sees one slice of it.
    """
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n"))
    sliced = counts.repartitionByRange(*by, column).withColumn("slice", F.spark_partition_id())
    slices = stage_table(sliced, "quantile-slices")

    group = by or [F.lit(0)]
    in_order = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = slices.groupBy(*by, "slice").agg(F.sum("n").alias("slice_rows"))
    offsets = per_slice.withColumn("before", F.coalesce(F.sum("slice_rows").over(in_order), F.lit(0))).withColumn(
        "total", F.sum("slice_rows").over(Window.partitionBy(*group))
    )
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(Decimal(str(p))).alias("exact")) for p in probabilities])
    ranks = offsets.withColumn("q", F.explode(wanted)).withColumn(
        "rank", F.greatest(F.ceil(F.col("q.exact") * F.col("total")).cast("bigint"), F.lit(1).cast("bigint"))
    )
    targets = ranks.where("rank > before AND rank <= before + slice_rows").select(
        *by, "slice", "before", "rank", F.col("q.p").alias("p")
    )
    running = Window.partitionBy(*by, "slice", "p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    reached = join_on(slices, targets, [*by, "slice"]).withColumn("upto", F.col("before") + F.sum("n").over(running))
    return reached.where("upto >= rank").groupBy(*by, "p").agg(F.min(column).alias("value"))


def percentiles(df: DataFrame, column: str, percents: list[float] = (50, 75, 90, 95, 99)) -> DataFrame:
    """(percent, value) of one column."""
    found = quantiles(df, column, [float(Decimal(str(p)) / 100) for p in percents])
    return found.select((F.col("p") * 100).alias("percent"), "value").orderBy("percent")
