"""Small helpers the operators share."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(module: str) -> None:
    """Send functions of this module to executors whole, so that the package need not be installed there."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name in any letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def lower_ascii(text: Column) -> Column:
    """Only A-Z in lower case; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def ordered(column: Column) -> Column:
    """The number of an id, missing ids after all others; for choosing the smallest id of a group."""
    return F.struct(column.isNull().alias("missing"), column.alias("id"))


def if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A written table of short rows, marked for broadcast if it has at most ``rows``; else it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def text_key(df: DataFrame) -> Column:
    """What stands for a row's text where texts are not carried along; a missing text counts as empty."""
    return F.md5(F.coalesce(df["text"], F.lit("")))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text are in ``dropped`` (doc_id, text_key), a written table."""
    doc, key = free_name(docs, "dropped_doc"), free_name(docs, "dropped_key")
    gone = if_small(dropped.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)))
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col(doc)) & (text_key(docs) == F.col(key)), "left_anti")


def for_long_texts(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most ``rows`` rows to Python at once: with whole texts, Spark's 10,000 would need too much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, rows)


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, without copying, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
