"""Readable numbers, labels and bands for display."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_col


def _fixed(x: Column, places: int) -> Column:
    """Text with a fixed number of decimals, exact halves to even."""
    scale = float(10**places)
    return (F.rint(x * scale) / scale).cast(f"decimal(38,{places})").cast("string")


def fmt_num(value: Column | str) -> Column:
    """``7310000000`` -> ``7.31 G``; units T, G, M, K; four decimals below one."""
    v = as_col(value).cast("double")
    size = F.abs(v)
    sign = F.when(v < 0, "-").otherwise("")

    def scaled(step: float, unit: str) -> Column:
        return F.concat(sign, _fixed(size / step, 2), F.lit(f" {unit}"))

    return (
        F.when(size >= 1e12, scaled(1e12, "T"))
        .when(size >= 1e9, scaled(1e9, "G"))
        .when(size >= 1e6, scaled(1e6, "M"))
        .when(size >= 1e3, scaled(1e3, "K"))
        .when((size >= 1) | (size == 0), _fixed(v, 2))
        .otherwise(_fixed(v, 4))
    )


def compact(count: Column | str) -> Column:
    """``1200000`` -> ``1.2M``, ``12345`` -> ``12k``, below 1000 as is."""
    n = as_col(count).cast("double")
    millions = (F.floor(n / 1e6 * 10 + 0.5) / F.lit(10.0)).cast("decimal(38,1)").cast("string")
    thousands = F.floor(n / 1e3 + 0.5).cast("string")
    return (
        F.when(n >= 1e6, F.concat(millions, F.lit("M")))
        .when(n >= 1e3, F.concat(thousands, F.lit("k")))
        .otherwise(as_col(count).cast("bigint").cast("string"))
    )


def readable_bytes(size: Column | str) -> Column:
    """``1536`` -> ``1.50 KiB``."""
    n = as_col(size).cast("double")
    steps = [("TiB", 4), ("GiB", 3), ("MiB", 2), ("KiB", 1)]
    text = F.concat(_fixed(n, 2), F.lit(" B"))
    for unit, power in reversed(steps):
        step = float(1024**power)
        text = F.when(n >= step, F.concat(_fixed(n / step, 2), F.lit(f" {unit}"))).otherwise(text)
    return text


def bucket_label(low: Column | str, gap: int, style: str) -> Column:
    """``money`` gives ``$0-10``, ``ms`` gives ``0-200ms``, ``hour`` gives ``07:00``."""
    lo = as_col(low).cast("bigint")
    high = (lo + F.lit(gap)).cast("string")
    if style == "money":
        return F.concat(F.lit("$"), lo.cast("string"), F.lit("-"), high)
    if style == "ms":
        return F.concat(lo.cast("string"), F.lit("-"), high, F.lit("ms"))
    if style == "hour":
        return F.concat(F.lpad(lo.cast("string"), 2, "0"), F.lit(":00"))
    raise ValueError(f"unknown label style: {style}")


def shorten(text: Column | str, width: int = 15) -> Column:
    """Text longer than ``width`` keeps ``width - 3`` characters and three dots."""
    c = as_col(text)
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)


def strip_domain(host: Column | str, domain: str) -> Column:
    return F.replace(as_col(host), F.lit(domain), F.lit(""))


def band(value: Column | str, bounds: list[float], labels: list[str]) -> Column:
    """Label of the first bound the value lies below; the last label beyond all bounds."""
    v = as_col(value)
    pairs = list(zip(bounds, labels))
    return reduce(lambda rest, p: F.when(v < p[0], p[1]).otherwise(rest), reversed(pairs), F.lit(labels[-1]))


def status_band(value: Column | str, steps: list[tuple[float | None, str]]) -> Column:
    """Colour of the highest step whose start is reached; the step without a start is the base colour."""
    v = as_col(value)
    base = next(colour for start, colour in steps if start is None)
    starts = sorted(((start, colour) for start, colour in steps if start is not None), reverse=True)
    return reduce(lambda rest, s: F.when(v >= s[0], s[1]).otherwise(rest), reversed(starts), F.lit(base))


def encode_status(colour: Column | str, value: Column | str) -> Column:
    """Aggregate: green flags count 1, yellow 2, red 3, summed over the rows of a group."""
    weight = F.when(as_col(colour) == "green", 1).when(as_col(colour) == "yellow", 2).when(as_col(colour) == "red", 3)
    return F.sum(weight * as_col(value))


def to_bits(bytes_: Column | str) -> Column:
    return as_col(bytes_) * 8


def make_id(*parts: Column | str) -> Column:
    """Key parts joined with ``_``: the same row always gets the same id, so writing twice is harmless."""
    return F.concat_ws("_", *[as_col(p) for p in parts])


def row_id(*parts: Column | str) -> Column:
    """A fixed-length id of any columns, for rows without a short key."""
    return F.sha2(F.to_json(F.struct(*[as_col(p) for p in parts])), 256)
