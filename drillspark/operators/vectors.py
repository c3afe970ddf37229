"""Label matching and arithmetic on labelled instant vectors."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label


def match_labels(
    series: DataFrame,
    eq: dict[str, str] | None = None,
    re: dict[str, str] | None = None,
    nre: dict[str, str] | None = None,
    labels: str = "labels",
) -> DataFrame:
    """Series whose labels equal, match or do not match; patterns cover the whole value, missing labels are empty."""
    tests = [label(labels, k) == v for k, v in (eq or {}).items()]
    whole = "(?s)\\A(?:{})\\z"  # unlike ^ and $, not around a line break
    tests += [label(labels, k).rlike(whole.format(v)) for k, v in (re or {}).items()]
    tests += [~label(labels, k).rlike(whole.format(v)) for k, v in (nre or {}).items()]
    return series.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def drop_info(series: DataFrame, labels: str = "labels") -> DataFrame:
    """Without metrics named ``*_info``."""
    return series.where(~F.endswith(label(labels, "__name__"), F.lit("_info")))


def above(vector: DataFrame, bound: float = 0.0, value: str = "value") -> DataFrame:
    """Samples above a bound."""
    return vector.where(F.col(value) > bound)


_BINARY = {
    "div": lambda a, b: F.try_divide(a, b),
    "sub": lambda a, b: a - b,
    "share": lambda a, b: F.try_divide(a, a + b),
    "used": lambda a, b: 1 - F.try_divide(a, b),
}


def vector_binaries(a: DataFrame, b: DataFrame, on: list[str], ops: Mapping[str, str], value: str = "value") -> DataFrame:
    """Combine samples of equal labels by several operations at once: ``on`` and a column for each name in ``ops``.

    Operations: ``div`` a/b, ``sub`` a-b, ``share`` a/(a+b), ``used`` 1-a/b. Samples without a partner drop out; a missing
    label equals a missing label. A label set that one side has twice fails the query, as it has no single partner. Both
    sides are grouped by labels together, so there is one shuffle, however many operations are asked for.
    """
    sides = [
        vector.select(*on, *[(F.col(value) if s == side else F.lit(None)).cast("double").alias(f"_{s}") for s in "ab"], F.lit(side).alias("_side"))
        for side, vector in zip("ab", (a, b))
    ]
    met = sides[0].unionByName(sides[1]).groupBy(*on).agg(
        F.max("_a").alias("_a"), F.max("_b").alias("_b"), *[F.count_if(F.col("_side") == s).alias(f"_n_{s}") for s in "ab"]
    )
    repeated = F.concat(F.lit("a label set is repeated on one side: "), F.to_json(F.struct(*on)))
    once = F.when((F.col("_n_a") > 1) | (F.col("_n_b") > 1), F.raise_error(repeated)).otherwise(F.lit(True))
    met = met.where(once & (F.col("_n_a") > 0) & (F.col("_n_b") > 0))
    return met.select(*on, *[_BINARY[op](F.col("_a"), F.col("_b")).alias(name) for name, op in ops.items()])


def vector_binary(a: DataFrame, b: DataFrame, on: list[str], op: str, value: str = "value") -> DataFrame:
    """One operation of ``vector_binaries``; its result is the value."""
    return vector_binaries(a, b, on, {value: op}, value)


_AGGREGATES = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}


def vector_aggs(
    vector: DataFrame, ops: Mapping[str, str], by: list[str] | None = None, without: list[str] | None = None, value: str = "value"
) -> DataFrame:
    """Aggregate samples ``by`` some label columns, or by all label columns ``without`` some; else all into one.

    ``ops`` names the results; all come from one pass.
    """
    if by is not None and without is not None:
        raise ValueError("give by or without, not both")
    keys = by or []
    if without is not None:
        keys = [c for c in vector.columns if c != value and c not in without]
    return vector.groupBy(*keys).agg(*[_AGGREGATES[op](value).alias(name) for name, op in ops.items()])


def vector_agg(
    vector: DataFrame, op: str, by: list[str] | None = None, without: list[str] | None = None, value: str = "value"
) -> DataFrame:
    """One aggregate of ``vector_aggs``; its result is the value."""
    return vector_aggs(vector, {value: op}, by, without, value)


def label_values(series: DataFrame, metric: str, name: str, labels: str = "labels") -> DataFrame:
    """Values a label takes on a metric."""
    value: Column = F.element_at(labels, F.lit(name)).alias("value")
    found = series.where(label(labels, "__name__") == metric).select(value).where(F.col("value").isNotNull())
    return found.distinct().orderBy("value")
