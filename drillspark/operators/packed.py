"""Packed series: documents that hold points as base64 of big-endian (double value, int64 epoch ms) pairs.

Python runs inside the tasks only to turn bytes into points and back, one Arrow batch at a time.
"""

from __future__ import annotations

import base64
import binascii
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .joins import join_on
from .series import SERIES, drop_sentinel, finite

# The functions below travel to the executors by value, so this package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The layout of one packed point.
POINT = np.dtype([("value", ">f8"), ("ts", ">i8")])
# First and last millisecond of the years 1 to 9999; points outside carry no usable time.
TIME_RANGE = (-62_135_596_800_000, 253_402_300_799_999)
DAY_MS = 86_400_000
MAX_POINTS = 50_000
#: Points of decoded documents in one Arrow batch, and packed documents in one.
DECODED, PACKED = 65_536, 1024

DOCUMENT_COLUMNS = {
    "host": "ts_host",
    "process": "ts_process",
    "metricGroup": "ts_metricGroup",
    "metricName": "ts_metricName",
}
_POINT_SCHEMA = "host string, process string, metricGroup string, metricName string, timestamp_ms bigint, value double"
_DOCUMENT_SCHEMA = (
    "ts_host string, ts_process string, ts_metricGroup string, ts_metricName string, "
    "ts_start bigint, ts_end bigint, ts_data_amountValues bigint, ts_data string"
)


def _payload(text: str | None) -> bytes:
    """Whole points of one payload; a broken payload has none, a broken last pair is left out."""
    if not text:
        return b""
    try:
        raw = base64.b64decode(text)
    except (binascii.Error, ValueError):
        return b""
    return raw[: len(raw) // POINT.itemsize * POINT.itemsize]


def _unpack(batches: Iterator[pa.RecordBatch], at_once: int = DECODED) -> Iterator[pa.RecordBatch]:
    """Points of documents, at most ``at_once`` in a batch, whatever came in a batch of documents."""
    for batch in batches:
        texts = batch.column("ts_data")
        row_of, held, size = [], [], 0

        def points():
            found = np.frombuffer(b"".join(held), POINT)
            rows = np.repeat(row_of, [len(raw) // POINT.itemsize for raw in held])
            usable = (found["ts"] >= TIME_RANGE[0]) & (found["ts"] <= TIME_RANGE[1])
            found, rows = found[usable], rows[usable]
            for at in range(0, len(found), at_once):
                part, of = found[at : at + at_once], pa.array(rows[at : at + at_once])
                keys = [batch.column(document).take(of) for document in DOCUMENT_COLUMNS.values()]
                values = [pa.array(part["ts"].astype("i8")), pa.array(part["value"].astype("f8"))]
                yield pa.RecordBatch.from_arrays(keys + values, [*DOCUMENT_COLUMNS, "timestamp_ms", "value"])

        for row in range(batch.num_rows):
            raw = _payload(texts[row].as_py())
            while raw:
                part = raw[: (at_once - size) * POINT.itemsize]
                raw = raw[len(part) :]
                held.append(part)
                row_of.append(row)
                size += len(part) // POINT.itemsize
                if size == at_once:
                    yield from points()
                    row_of, held, size = [], [], 0
        if size:
            yield from points()


def decode_series(docs: DataFrame) -> DataFrame:
    """One row per point of every document; points without a usable time are left out."""
    return docs.select(*DOCUMENT_COLUMNS.values(), "ts_data").mapInArrow(_unpack, _POINT_SCHEMA)


_PLACE = ["_day", "_document"]


def _breaks(batch: pa.RecordBatch) -> np.ndarray:
    """Rows with another series, day or document than the row before."""
    breaks = np.zeros(batch.num_rows, bool)
    for c in (*SERIES, *_PLACE):
        codes = batch.column(c).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        breaks[1:] |= np.nan_to_num(codes[1:], nan=-1) != np.nan_to_num(codes[:-1], nan=-1)
    return np.flatnonzero(breaks)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _documents(rows: pa.RecordBatch) -> pa.RecordBatch:
    """A document for each run of sorted rows."""
    first = np.concatenate([[0], _breaks(rows)])
    ends = np.append(first[1:], rows.num_rows)
    points = np.empty(rows.num_rows, POINT)
    points["ts"], points["value"] = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("timestamp_ms", "value"))
    raw, size = points.tobytes(), POINT.itemsize
    data = [base64.b64encode(raw[start * size : end * size]).decode() for start, end in zip(first.tolist(), ends.tolist())]
    columns = [rows.column(k).take(pa.array(first)) for k in SERIES]
    numbers = [pa.array(n.astype("i8")) for n in (points["ts"][first], points["ts"][ends - 1], ends - first)]
    names = [*DOCUMENT_COLUMNS.values(), "ts_start", "ts_end", "ts_data_amountValues", "ts_data"]
    return pa.RecordBatch.from_arrays([*columns, *numbers, pa.array(data, pa.string())], names)


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a run of equal series, day and document ends."""
    held: list[pa.RecordBatch] = []  # the run that may go on in the next batch

    def key(batch: pa.RecordBatch, row: int) -> list:
        return [batch.column(c)[row].as_py() for c in (*SERIES, *_PLACE)]

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield _joined(held)
            held = []
        breaks = _breaks(batch)
        if len(breaks):
            last = int(breaks[-1])
            yield _joined([*held, batch.slice(0, last)])
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield _joined(held)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal series, day and document in sorted rows become documents, wherever Arrow batches end.

    A batch of documents is full with ``PACKED`` of them or the first that brings it to ``DECODED`` points.
    """
    held: list[pa.RecordBatch] = []
    documents = points = 0
    for rows in _whole_runs(batches):
        found = _documents(rows)
        at = 0
        for end, n in enumerate(found.column("ts_data_amountValues").to_pylist(), 1):
            documents, points = documents + 1, points + n
            if documents >= PACKED or points >= DECODED:
                yield _joined([*held, found.slice(at, end - at)])
                held, at, documents, points = [], end, 0, 0
        if at < found.num_rows:
            held.append(found.slice(at))
    if held:
        yield _joined(held)


def numbered_points(df: DataFrame, by_day: bool = False) -> DataFrame:
    """Points with ``position``, their number in time order from 0 within their series, or within series and day.

    Sorted slices of all points are written with their numbers, points are counted per slice and series, and the counts
    of the slices before are added: no series has to fit into a task. Equal times go by value. Points need a value (NaN
    and infinity are values) and a time.
    """
    points = df.where(F.col("value").isNotNull() & F.col("timestamp_ms").isNotNull())
    points = points.select(*SERIES, F.col("timestamp_ms").cast("bigint"), F.col("value").cast("double"))
    points = points.withColumn("_day", F.floor(F.col("timestamp_ms") / DAY_MS))
    group = [*SERIES, "_day"] if by_day else SERIES
    order = [*SERIES, "timestamp_ms", "value"]
    # a row's number grows with its slice, and inside a slice in the order of rows
    placed = points.repartitionByRange(*order).sortWithinPartitions(*order)
    slices = stage_table(placed.withColumn("_row", F.monotonically_increasing_id()), "point-slices")
    slices = slices.withColumn("_slice", F.shiftright("_row", 33))
    counts = slices.groupBy(*group, "_slice").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offset = (F.col("_before") - F.col("_first")).alias("_offset")
    met = join_on(slices, counts.select(*group, "_slice", offset), [*group, "_slice"])
    return met.select(*SERIES, "_day", "timestamp_ms", "value", (F.col("_row") + F.col("_offset")).alias("position"))


def pack_series(df: DataFrame, most: int = MAX_POINTS) -> DataFrame:
    """Documents of points in time order, at most one day and ``most`` points long.

    The points of a series and day are numbered over all tasks, and a document holds the next ``most`` of them, so
    documents begin and end at the same points however rows are dealt over tasks and batches.
    """
    document = F.floor(F.col("position") / most).alias("_document")
    points = numbered_points(df, by_day=True).select(*SERIES, *_PLACE[:1], document, "timestamp_ms", "value")
    placed = points.repartition(*SERIES, *_PLACE).sortWithinPartitions(*SERIES, *_PLACE, "timestamp_ms", "value")
    return placed.mapInArrow(_pack, _DOCUMENT_SCHEMA)


CLEANERS = {"finite": finite, "sentinel": drop_sentinel}


def merge_segments(docs: DataFrame, clean: str = "finite") -> DataFrame:
    """Points of all segments of each series, cleaned; as rows, so nothing has to be concatenated."""
    return CLEANERS[clean](decode_series(docs))


def merged_points(docs: DataFrame, clean: str = "finite") -> DataFrame:
    """One series in time order of all segments of each key: its cleaned points and their ``position`` from 0."""
    return numbered_points(merge_segments(docs, clean)).drop("_day")


def merged_catalogue(docs: DataFrame, clean: str = "finite") -> DataFrame:
    """Per series after merging and cleaning: first and last time and the new number of points."""
    return merge_segments(docs, clean).groupBy(*SERIES).agg(
        F.min("timestamp_ms").alias("ts_start"),
        F.max("timestamp_ms").alias("ts_end"),
        F.count("*").alias("ts_data_amountValues"),
    )


def compact_segments(docs: DataFrame, clean: str = "finite") -> DataFrame:
    """Segments of a series packed again: cleaned, in time order, recounted."""
    return pack_series(merge_segments(docs, clean))
