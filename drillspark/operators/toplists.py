"""First rows of a grouped list with a total over the whole list, as one lazy plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WHOLE = "_whole_list"


def with_whole(grouped: DataFrame, keys: list[str], totals: Mapping[str, Column]) -> DataFrame:
    """The rows of ``grouped``, one for each value of ``keys``, and one more for the whole list, marked in ``_whole_list``.

    ``totals`` are aggregates over the list; in the rows of single keys they hold the aggregate of that row alone. The
    list is grouped once more by grouping sets, which combine before their shuffle, so rows and totals come from one scan.
    """
    others = [c for c in grouped.columns if c not in keys]
    kept = [F.any_value(c).alias(c) for c in others]
    added = [total.alias(name) for name, total in totals.items()]
    both = grouped.groupingSets([[F.col(k) for k in keys], []], *keys)
    return both.agg((F.grouping_id() > 0).alias(_WHOLE), *kept, *added)


def first_rows(listed: DataFrame, keep: Column, order: list[Column | str], n: int | None, totals: list[str]) -> DataFrame:
    """Of ``with_whole``, the first ``n`` rows that are to be kept, or all, in order and with the totals of the whole list."""
    whole = F.col(_WHOLE)
    kept = listed.where(whole | keep)
    if n is None:
        for name in totals:
            kept = kept.withColumn(name, listed.where(whole).select(name).scalar())
        return kept.where(~whole).drop(_WHOLE).orderBy(*order)
    first = kept.orderBy(F.desc(whole), *order).limit(n + 1)
    among = Window.partitionBy()  # of n + 1 rows, which the limit has brought into one task
    for name in totals:
        first = first.withColumn(name, F.max(F.when(whole, F.col(name))).over(among))
    return first.where(~whole).drop(_WHOLE).orderBy(*order)
