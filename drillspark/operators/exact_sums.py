"""Sums of any doubles, rounded once: the same digits whatever the order of rows, and nothing cut off.

A double is split into whole digits to the base 2**21 at fixed places, four at most. Digits are added as integers, by the
place of a value's first digit, with a map-side part; 2**40 rows a group do not overflow. The few sums of a group are then
carried into one number, and its first 63 bits, with a mark for anything below, become the nearest double.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 21
DIGITS = 4
_BASE = 1 << BITS


def _power(exponent: Column) -> tuple[Column, Column]:
    """Two powers of two whose product is 2**exponent; each is a double where the product may not be."""
    half = F.floor(exponent / 2).cast("int")
    return F.pow(F.lit(2.0), half), F.pow(F.lit(2.0), exponent - half)


def _carried(limbs: Column, sign: Column) -> Column:
    """Struct (carry, digits): the sums of all places, times ``sign``, with every digit between 0 and the base."""
    places = F.sequence(F.array_min(limbs["place"]), F.array_max(limbs["place"]) + 4)

    def add(state: Column, place: Column) -> Column:
        here = F.filter(limbs, lambda limb: limb["place"] == place)
        total = F.aggregate(here, state["carry"], lambda n, limb: n + limb["n"] * sign)
        return F.struct(F.shiftright(total, BITS).alias("carry"), F.concat(state["digits"], F.array(total.bitwiseAND(_BASE - 1))).alias("digits"))

    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("digits"))
    return F.aggregate(places, start, add)


def _rounded(limbs: str, digits: str) -> Column:
    """The nearest double of positive digits, lowest place first."""
    held = F.col(digits)
    top = F.array_max(F.transform(held, lambda d, i: F.when(d > 0, i)))
    digit = lambda k: F.coalesce(F.get(held, top - k), F.lit(0).cast("bigint"))
    size = F.length(F.bin(digit(0)))
    high = digit(0) * (_BASE * _BASE) + digit(1) * _BASE + digit(2)
    low = digit(3) * _BASE + digit(4)
    cut = F.pow(F.lit(2.0), F.lit(BITS) + size)
    below = (low % cut.cast("bigint") != 0) | F.exists(F.slice(held, F.lit(1), F.greatest(top - 4, F.lit(0))), lambda d: d != 0)
    first = high * F.pow(F.lit(2.0), F.lit(BITS) - size).cast("bigint") + F.floor(low / cut)
    first = first.bitwiseOR(F.when(below, 1).otherwise(0).cast("bigint")).cast("double")
    place = F.array_min(F.col(limbs)["place"]) + top - 2
    a, b = _power(place * BITS - (F.lit(BITS) - size))
    return F.when(top.isNull(), 0.0).otherwise(first * a * b)


def exact_sums(df: DataFrame, keys: list[str], sums: Mapping[str, str], counts: Mapping[str, str] | None = None) -> DataFrame:
    """Per ``keys``: for each name in ``sums`` the sum of a column, for each in ``counts`` how many values it has.

    Sums are those of exact arithmetic, rounded to the nearest double (results below 2.3e-308 may be rounded twice).
    Missing values are left out, a sum of none is missing; NaN and infinities give what adding doubles gives. An empty
    table gives no rows, and without keys one row.
    """
    columns = list(dict.fromkeys([*sums.values(), *(counts or {}).values()]))
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])).alias("one")
    rows = df.select(*keys, one).select(*keys, "one.m", "one.v")
    v = F.col("v")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    place = F.when(finite & (v != 0), F.floor(F.log2(F.abs(v)) / BITS).cast("int"))
    rows = rows.withColumn("place", place)
    a, b = _power(-F.col("place") * BITS)
    rows = rows.withColumn("y0", v * a * b)
    for k in range(DIGITS):
        digit = F.col(f"y{k}").cast("bigint")
        rows = rows.withColumn(f"d{k}", digit).withColumn(f"y{k + 1}", (F.col(f"y{k}") - digit) * _BASE)
    by_place = rows.groupBy(*keys, "m", "place").agg(
        *[F.sum(f"d{k}").alias(f"d{k}") for k in range(DIGITS)], F.count("v").alias("n"), F.sum(F.when(~finite, v)).alias("special")
    )
    limbs = F.array(*[F.struct((F.col("place") - k).alias("place"), F.col(f"d{k}").alias("n")) for k in range(DIGITS)])
    whole = by_place.groupBy(*keys, "m").agg(
        F.flatten(F.collect_list(F.when(F.col("place").isNotNull(), limbs))).alias("limbs"),
        F.sum("n").alias("n"),
        F.sum("special").alias("special"),
    )
    plus = F.lit(1).cast("bigint")
    whole = whole.withColumn("carried", F.when(F.size("limbs") > 0, _carried(F.col("limbs"), plus)))
    whole = whole.withColumn("sign", F.when(F.col("carried.carry") < 0, -plus).otherwise(plus))
    turned = F.when(F.col("sign") < 0, _carried(F.col("limbs"), F.col("sign"))["digits"]).otherwise(F.col("carried.digits"))
    whole = whole.withColumn("digits", turned)
    number = F.when(F.size("limbs") == 0, 0.0).otherwise(F.col("sign") * _rounded("limbs", "digits"))
    total = F.when(F.col("special").isNotNull(), F.col("special")).when(F.col("n") > 0, number)
    whole = whole.select(*keys, "m", "n", total.alias("total"))
    wide = [F.max(F.when(F.col("m") == columns.index(c), F.col("total"))).alias(name) for name, c in sums.items()]
    wide += [F.coalesce(F.max(F.when(F.col("m") == columns.index(c), F.col("n"))), F.lit(0)).alias(name) for name, c in (counts or {}).items()]
    return whole.groupBy(*keys).agg(*wide)
