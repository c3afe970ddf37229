"""Facet counts for drill-down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_col
from .filters import Fields, Filters, field_predicates

TOTAL = "*"


def facets(
    df: DataFrame, filters: Filters, names: list[str], fields: Fields, limit: int | None = 30, sort: str = "count"
) -> DataFrame:
    """Counts per field under all filters except the field's own, top ``limit`` values per field (None: all of them).

    Returns (field, value, count, rank); the row with field ``*`` holds the number of rows under all filters, also when
    that is 0. ``sort`` ranks the shown values by ``count``, by ``value``, or ``none`` (no rank); without
    a limit there is no rank either.

    One scan serves all fields: a row counts for a field if no other field's filter rejects it, so rows that two
    filters reject drop out at once. Counts combine before the shuffle.
    """
    names = [n for n in names if n in fields.allowed]
    rejects = {f: F.when(p, 0).otherwise(1) for f, p in field_predicates(filters, fields).items()}
    all_rejects = reduce(lambda a, b: a + b, rejects.values(), F.lit(0))
    flagged = df.select(
        all_rejects.alias("_rejects"),
        *[rejects.get(n, F.lit(0)).alias(f"_own_{i}") for i, n in enumerate(names, 1)],
        *[fields.column(n).alias(f"_value_{i}") for i, n in enumerate(names, 1)],
    ).where("_rejects <= 1")
    # item 0 is the row itself, item i its value of field i; values keep their types, and become text when they are counted
    items = flagged.withColumn("_item", F.explode(F.array(*[F.lit(i) for i in range(len(names) + 1)])))
    keep = F.when(F.col("_item") == 0, F.col("_rejects") == 0)
    for i in range(1, len(names) + 1):
        keep = keep.when(F.col("_item") == i, (F.col("_rejects") == F.col(f"_own_{i}")) & F.col(f"_value_{i}").isNotNull())
    keys = [f"_value_{i}" for i in range(1, len(names) + 1)]
    own = [F.when(F.col("_item") == i, F.col(k)).alias(k) for i, k in enumerate(keys, 1)]
    counted_once = items.where(keep).select("_item", *own, F.lit(1).cast("bigint").alias("n"))
    nothing = [F.lit(None).cast(flagged.schema[k].dataType).alias(k) for k in keys]
    no_hit = df.sparkSession.range(0, 1, 1, 1).select(F.lit(0).alias("_item"), *nothing, F.lit(0).cast("bigint").alias("n"))
    grouped = counted_once.unionByName(no_hit).groupBy("_item", *keys).agg(F.sum("n").alias("count"))
    field = F.element_at(F.array(*[F.lit(n) for n in [TOTAL, *names]]), F.col("_item") + 1)
    value = F.when(F.col("_item") == 0, F.lit(TOTAL)).otherwise(F.coalesce(*[F.col(k).cast("string") for k in keys], F.lit("")))
    counted = grouped.select(field.alias("field"), value.alias("value"), "count")
    if limit is None:
        return counted
    per_field = Window.partitionBy("field")
    by_count = per_field.orderBy(F.desc("count"), F.asc("value"))
    top = counted.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= limit)
    if sort == "count":
        return top
    if sort == "none":
        return top.drop("rank")
    if sort == "value":
        by_value = per_field.orderBy(F.expr("try_cast(value AS DOUBLE)").asc_nulls_last(), F.asc("value"))
        return top.withColumn("rank", F.row_number().over(by_value))
    raise ValueError(f"unknown sort: {sort}")


def facet(df: DataFrame, column: Column | str, where: Column | None = None, limit: int | None = 20) -> DataFrame:
    """Rows per value of one field, largest first; rows without a value are not counted."""
    rows = df if where is None else df.where(where)
    values = rows.select(as_col(column).alias("value")).where(F.col("value").isNotNull())
    counts = values.groupBy("value").agg(F.count("*").alias("count"))
    ordered = counts.orderBy(F.desc("count"), F.asc("value"))
    return ordered if limit is None else ordered.limit(limit)


def order_weekdays(df: DataFrame, day: str) -> DataFrame:
    """Rows in the order Monday to Sunday, given codes 1=Sunday..7=Saturday, with their position."""
    position = F.pmod(F.col(day).cast("int") + 5, F.lit(7))
    return df.withColumn("position", position + 1).orderBy("position")
