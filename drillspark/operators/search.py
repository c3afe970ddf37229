"""Word search over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_any_word, has_word_prefix
from .filters import EVENT_FIELDS, Fields, Filters, compile_filters

# Fields of an event shown with a hit.
HIT_FIELDS = [
    "event_ts",
    "host",
    "service",
    "severity",
    "event_type",
    "message",
    "cpu_percent",
    "memory_percent",
    "response_time_ms",
    "status_code",
]


def match(df: DataFrame, column: str, query: str, filters: Filters | None = None, fields: Fields = EVENT_FIELDS) -> DataFrame:
    """Rows whose text holds any word of the query and that pass the filters."""
    return df.where(compile_filters(filters, fields) & has_any_word(column, query))


def newest_first(df: DataFrame, ts: str = "event_ts", *ties: Column | str) -> DataFrame:
    return df.orderBy(F.desc(ts), *ties)


def search(
    df: DataFrame,
    query: str,
    filters: Filters | None = None,
    size: int | None = 20,
    column: str = "message",
    columns: list[str] | None = None,
    ties: tuple[str, ...] = ("event_id",),
) -> DataFrame:
    """The newest hits, ``size`` of them or all."""
    shown = columns or HIT_FIELDS
    hits = newest_first(match(df, column, query, filters), "event_ts", *[F.asc(t) for t in ties])
    return (hits if size is None else hits.limit(size)).select(*ties, *shown)


def search_page(
    df: DataFrame,
    query: str,
    filters: Filters | None = None,
    size: int | None = 20,
    column: str = "message",
    columns: list[str] | None = None,
    ties: tuple[str, ...] = ("event_id",),
) -> DataFrame:
    """The newest hits as ``search`` gives them, each with the number of all hits as ``total``, in one lazy plan."""
    return search(df, query, filters, size, column, columns, ties).withColumn("total", total_hits(df, query, filters, column).scalar())


def total_hits(df: DataFrame, query: str, filters: Filters | None = None, column: str = "message") -> DataFrame:
    return match(df, column, query, filters).agg(F.count("*").alias("total"))


def match_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text holds a word that starts with ``prefix``."""
    return df.where(has_word_prefix(column, prefix))


def count_documents(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("documents"))
