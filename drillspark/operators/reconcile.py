"""Comparison of two computations of one result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key: ``status`` is same, differs, only_a or only_b, with the values of both sides. Nulls equal nulls."""
    left = a.select(*[F.col(k).alias(f"_a_{k}") for k in keys], F.struct(*values).alias("a"))
    right = b.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.struct(*values).alias("b"))
    same_key = reduce(lambda x, y: x & y, [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys])
    status = (
        F.when(F.col("b").isNull(), "only_a")
        .when(F.col("a").isNull(), "only_b")
        .when(F.col("a").eqNullSafe(F.col("b")), "same")
        .otherwise("differs")
    )
    return left.join(right, same_key, "full_outer").select(
        *[F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys],
        status.alias("status"),
        *[F.col(f"a.{v}").alias(f"a_{v}") for v in values],
        *[F.col(f"b.{v}").alias(f"b_{v}") for v in values],
    )
