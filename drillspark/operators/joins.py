"""Equi-join in which missing keys equal each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """All columns of ``left`` and the other columns of ``right``; a group without a key finds its partner too."""
    others = [F.col(c) for c in right.columns if c not in keys]
    renamed = right.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *others)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])
