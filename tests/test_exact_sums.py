"""Sums rounded once, against exact arithmetic."""

import math
import random
from fractions import Fraction

import pytest

from drillspark.operators.exact_sums import exact_sums


def groups():
    rnd = random.Random(11)
    out = {
        "tiny": [4e-7] * 10,
        "large": [1e13, 1e13],
        "cancel": [1e300, 1.0, -1e300],
        "negative": [-0.1] * 7,
        "half": [2.0**53, 1.0, 1e-30],
        "even": [2.0**53, 1.0],
        "zero": [0.0, -0.0],
        "gone": [5.0, -5.0],
        "small": [2.0**-1060, 2.0**-1074, 3e-310],
        "missing": [None, None],
        "some": [None, 2.5],
        "powers": [2.0**k for k in range(-200, 200, 7)],
    }
    for i in range(60):
        spread = rnd.choice([1, 20, 200])
        out[f"r{i}"] = [rnd.choice([-1, 1]) * rnd.random() * 2.0 ** rnd.randint(-spread, spread) for _ in range(rnd.randint(1, 60))]
    for i in range(10):
        out[f"cents{i}"] = [round(rnd.uniform(-5, 900), 2) for _ in range(rnd.randint(1, 300))]
    return out


def test_sums_are_those_of_exact_arithmetic(spark):
    given = groups()
    rows = [(name, v, 1.0) for name, values in given.items() for v in values]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(7)
    got = {r.k: r for r in exact_sums(df, ["k"], {"s": "v", "w": "w"}, {"n": "v"}).collect()}
    assert set(got) == set(given)
    for name, values in given.items():
        present = [v for v in values if v is not None]
        want = float(sum(map(Fraction, present), Fraction(0))) if present else None
        assert got[name].s == want and got[name].n == len(present) and got[name].w == len(values), name


def test_special_values_add_as_doubles_do(spark):
    inf, nan = math.inf, math.nan
    rows = [("i", inf), ("i", 1.0), ("n", -inf), ("b", inf), ("b", -inf), ("x", nan), ("x", 1.0)]
    got = {r.k: r.s for r in exact_sums(spark.createDataFrame(rows, "k string, v double"), ["k"], {"s": "v"}).collect()}
    assert got["i"] == inf and got["n"] == -inf and math.isnan(got["b"]) and math.isnan(got["x"])


def test_keys_may_be_missing_and_tables_empty(spark):
    df = spark.createDataFrame([(None, 1.5), (None, 2.0), ("a", None)], "k string, v double")
    assert {(r.k, r.s) for r in exact_sums(df, ["k"], {"s": "v"}).collect()} == {(None, 3.5), ("a", None)}
    assert not exact_sums(df.limit(0), ["k"], {"s": "v"}).collect()
    assert [tuple(r) for r in exact_sums(df.limit(0), [], {"s": "v"}, {"n": "v"}).collect()] == [(None, 0)]
    assert exact_sums(df, [], {"s": "v"}).first().s == 3.5


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_order_does_not_matter(spark, parts):
    rnd = random.Random(5)
    df = spark.createDataFrame([(rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-12, 12),) for _ in range(5000)], "v double")
    want = math.fsum(r.v for r in df.collect())
    assert exact_sums(df.repartition(parts), [], {"s": "v"}).first().s == want
