"""Filter sets: ``{field: [value, "[lo TO hi]", ...]}`` becomes one predicate, OR inside a field, AND across fields."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.columns import as_col

Filters = Mapping[str, Iterable]


@dataclass(frozen=True)
class Fields:
    """Fields a user may filter and group by; virtual ones are computed when the query runs."""

    allowed: frozenset[str]
    virtual: Mapping[str, Callable[[], Column]] = field(default_factory=dict)

    def column(self, name: str) -> Column:
        return self.virtual[name]() if name in self.virtual else F.col(name)

    def group_column(self, name: str) -> Column:
        if name not in self.allowed:
            raise ValueError(f"not a field to group by: {name}")
        return self.column(name)


# Fields open to filters.
TRIP_FIELDS = Fields(
    frozenset(
        {
            "pickup_hour",
            "pickup_dayofweek",
            "payment_type",
            "PULocationID",
            "DOLocationID",
            "total_amount",
            "trip_distance",
            "fare_amount",
            "tip_amount",
            "passenger_count",
            "VendorID",
            "RatecodeID",
        }
    ),
    {
        "pickup_hour": lambda: times.hour_of("tpep_pickup_datetime"),
        "pickup_dayofweek": lambda: times.weekday("tpep_pickup_datetime"),
    },
)
EVENT_FIELDS = Fields(
    frozenset(
        {
            "host",
            "service",
            "event_type",
            "severity",
            "cpu_percent",
            "memory_percent",
            "disk_percent",
            "response_time_ms",
            "status_code",
            "bytes_sent",
            "event_hour",
        }
    ),
    {"event_hour": lambda: times.hour_of("event_ts")},
)


def selection_to_filters(selection: Iterable[str]) -> dict[str, list]:
    """``["payment_type:1", "total_amount:[0 TO 10]"]`` as a filter set; whole numbers become integers."""
    filters: dict[str, list] = {}
    for item in selection:
        name, colon, value = item.partition(":")
        if not colon:
            continue
        if not _is_range(value):
            try:
                value = int(value)
            except ValueError:
                pass
        filters.setdefault(name, []).append(value)
    return filters


def _is_range(value) -> bool:
    return isinstance(value, str) and value.startswith("[") and " TO " in value


_RANGE = re.compile(r"\[\s*(\S+) TO (\S+)\s*\]")


def _end(text: str) -> float | datetime | None:
    """One end of a range: a finite number, an ISO date (its midnight) or time without offset, or None for ``*``."""
    if text == "*":
        return None
    try:
        number = float(text)
    except ValueError:
        time = datetime.fromisoformat(text)
        # a final Z is how some clients write times that have no zone in the data
        if time.tzinfo is not None and not text.endswith("Z"):
            raise ValueError(f"time with an offset: {text}") from None
        return time.replace(tzinfo=None)
    if not math.isfinite(number):
        raise ValueError(f"not a finite number: {text}")
    return number


def _range_predicate(column: Column, text: str) -> Column:
    """Inclusive range of numbers or of times; a range that cannot be read is an error, never a filter left out."""
    found = _RANGE.fullmatch(text)
    if found is None:
        raise ValueError(f"not a range: {text}")
    ends = [_end(e) for e in found.groups()]
    if len({type(e) for e in ends if e is not None}) > 1:
        raise ValueError(f"a number and a time in one range: {text}")
    low, high = (F.lit(e.isoformat()).cast("timestamp_ntz") if isinstance(e, datetime) else e for e in ends)
    if low is None and high is None:
        return column.isNotNull()
    if low is None:
        return column <= high
    return column >= low if high is None else column.between(low, high)


def field_predicate(column: Column, values: Iterable) -> Column | None:
    """Predicate of one field, or None if nothing was selected."""
    values = list(values)
    plain = [v for v in values if not _is_range(v)]
    options = [column.isin(plain)] if plain else []
    options += [_range_predicate(column, v) for v in values if _is_range(v)]
    return reduce(lambda a, b: a | b, options) if options else None


def field_predicates(filters: Filters | Iterable[str] | None, fields: Fields) -> dict[str, Column]:
    """One predicate per filtered field; unknown fields are ignored, unreadable ranges of known ones are errors."""
    if not filters:
        return {}
    if not isinstance(filters, Mapping):
        filters = selection_to_filters(filters)
    found = {f: field_predicate(fields.column(f), values) for f, values in filters.items() if f in fields.allowed}
    return {f: p for f, p in found.items() if p is not None}


def compile_filters(filters: Filters | Iterable[str] | None, fields: Fields, exclude: str | None = None) -> Column:
    """The whole filter set as one predicate, without the field ``exclude``; no filters means true."""
    kept = [p for f, p in field_predicates(filters, fields).items() if f != exclude]
    return reduce(lambda a, b: a & b, kept) if kept else F.lit(True)


def weekend_nights(ts: Column | str) -> Column:
    """Friday or Saturday, 22:00 to 04:59."""
    hour, day = times.hour_of(ts), times.weekday(ts)
    return day.isin(6, 7) & (hour.between(22, 23) | hour.between(0, 4))


def subset(df: DataFrame, where: Column, fields: list[str]) -> DataFrame:
    """The filtered rows and the named columns, for deeper analysis."""
    return df.where(where).select(*fields)


def time_range(ts: Column | str, start: str, end: str) -> Column:
    """Both ends included, times without zone."""
    return as_col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))


def count_filtered(df: DataFrame, filters: Filters, fields: Fields, cap: int | None = None) -> DataFrame:
    """Matching rows, and whether there is something to analyse (and, with ``cap``, not too much of it)."""
    n = F.col("count")
    able = n > 0 if cap is None else (n > 0) & (n <= cap)
    return df.where(compile_filters(filters, fields)).agg(F.count("*").alias("count")).withColumn("can_analyze", able)


def drill_rows(
    df: DataFrame, filters: Filters, fields: Fields, columns: list[str], order: list[Column], limit: int = 10
) -> DataFrame:
    """First rows in the given order with the total number of hits beside them."""
    hits = df.where(compile_filters(filters, fields))
    total = hits.agg(F.count("*").alias("num_found")).scalar()
    named = [fields.column(c).alias(c) for c in columns]
    return hits.select(*named).orderBy(*order).limit(limit).withColumn("num_found", total)
