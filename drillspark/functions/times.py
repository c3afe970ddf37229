"""Time functions: parts, keys, formats, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col


def hour_of(ts: Column | str) -> Column:
    return F.hour(as_col(ts))


def weekday(ts: Column | str, convention: str = "sun1") -> Column:
    """Day of week: ``sun1`` 1=Sunday..7=Saturday, ``mon1`` 1=Monday..7=Sunday, ``mon0`` 0=Monday..6=Sunday."""
    if convention == "sun1":
        return F.dayofweek(as_col(ts))
    if convention == "mon1":
        return F.weekday(as_col(ts)) + 1
    if convention == "mon0":
        return F.weekday(as_col(ts))
    raise ValueError(f"unknown weekday convention: {convention}")


def day_of(ts: Column | str) -> Column:
    return F.to_date(as_col(ts))


def month_key(ts: Column | str) -> Column:
    """``yyyyMM``; reckoned, not formatted, for years of four digits."""
    return (F.year(as_col(ts)) * 100 + F.month(as_col(ts))).cast("string")


def hour_start(ts: Column | str) -> Column:
    return F.date_trunc("hour", as_col(ts))


def fmt_ts(ts: Column | str, pattern: str = "yyyy-MM-dd") -> Column:
    return F.date_format(as_col(ts), pattern)


def iso_z(ts: Column | str) -> Column:
    """``2023-01-09T14:32:00Z``."""
    return F.date_format(as_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def minutes_elapsed(start: Column | str, end: Column | str) -> Column:
    """Fractional minutes between two times; times without a zone stay without one, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", as_col(start), as_col(end)) / F.lit(60_000_000.0)


def minute_boundaries(start: Column | str, end: Column | str) -> Column:
    """Number of full-minute marks crossed, seconds ignored; as in ``minutes_elapsed``, without the session's zone."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    minutes = [F.floor(F.timestamp_diff("MICROSECOND", epoch, as_col(c)) / F.lit(60_000_000.0)) for c in (start, end)]
    return minutes[1] - minutes[0]


def parse_iso(text: Column | str) -> Column:
    """Timestamp from the first 19 characters of ISO text; shorter or wrong text gives null."""
    c = as_col(text)
    joined = F.concat(F.substring(c, 1, 10), F.lit(" "), F.substring(c, 12, 8))
    return F.when(F.length(c) >= 19, F.try_to_timestamp(joined, F.lit("yyyy-MM-dd HH:mm:ss")))


def from_epoch_ms(ms: Column | str) -> Column:
    return F.timestamp_millis(as_col(ms))
