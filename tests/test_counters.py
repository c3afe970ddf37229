"""Growth over overlapping ranges against a plain version."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from drillspark.operators import counters


def readings(seed, value):
    rnd = random.Random(seed)
    out = []
    for name, n in [("hot", 700), ("rare", 25), ("once", 1), (None, 40)]:
        t, v = 1_699_999_000, value(rnd)
        for _ in range(n):
            t += rnd.choice([0, 1, 15, 15, 30, 700, 90_000 if rnd.random() < 0.1 else 60])
            v = value(rnd) * 0 if rnd.random() < 0.05 else v + value(rnd)
            out.append((name, t, len(out), None if rnd.random() < 0.03 else v))
    return out


def plain(rows, length, step, entering):
    """Increase for each series and end of a range, from the readings of the range."""
    by = defaultdict(list)
    for name, t, i, v in rows:
        if v is not None:
            by[name].append((t, i, v))
    out = {}
    for name, points in by.items():
        points.sort()
        ends = {e for t, _, _ in points for e in range((t // step + 1) * step, t + length + 1, step)}
        for end in ends:
            inside = [k for k, (t, _, _) in enumerate(points) if end - length <= t < end]
            if entering and inside[0] > 0:
                inside.insert(0, inside[0] - 1)
            if len(inside) < 2 and not entering:
                continue
            values = [points[k][2] for k in inside]
            out[name, end] = sum(b if b < a else b - a for a, b in zip(values, values[1:]))
    return out


@pytest.mark.parametrize("length, step", [(300, 60), (60, 300), (3600, 900), (100, 70), (86_400, 3600), (250_000, 50_000), (1, 1)])
@pytest.mark.parametrize("entering", [False, True])
def test_ranges(spark, length, step, entering):
    rows = readings(length, lambda r: r.randrange(9))
    df = spark.createDataFrame(rows, "s string, t bigint, i int, v bigint").withColumn("ts", F.timestamp_seconds("t")).repartition(5)
    got = counters.counter_ranges(df, ["s"], length, step, value="v", ties=("i",), entering=entering)
    assert got.columns == ["s", "range_end", "increase"]
    assert {(r.s, r.range_end): r.increase for r in got.collect()} == plain(rows, length, step, entering)


def test_ranges_of_fractions_lose_no_digits_to_history(spark):
    rows = [("a", 1_000_000 + 60 * i, i, 1e15 + i if i < 5000 else 0.25 * (i - 5000)) for i in range(8000)]
    df = spark.createDataFrame(rows, "s string, t bigint, i int, v double").withColumn("ts", F.timestamp_seconds("t"))
    late = counters.counter_range_rates(df, ["s"], 300, 60, value="v").where("range_end > 1400000")
    assert {r.rate for r in late.collect()} <= {1.0 / 300, 0.75 / 300, 0.5 / 300, 0.25 / 300}


def test_utilisation_over_ranges(spark):
    rows = [(node, cpu, 60 * k, 30.0 * k) for node in "ab" for cpu in range(2) for k in range(20)]
    df = spark.createDataFrame(rows, "node string, cpu int, t bigint, value double").withColumn("ts", F.timestamp_seconds("t"))
    got = counters.cpu_utilisation_ranges(df, "node", ["cpu"], 300, 60).where("range_end between 300 and 1200").collect()
    assert len(got) == 32 and {round(r.utilisation, 9) for r in got} == {round(1 - 120 / 300, 9)}


def test_empty_and_wrong_sizes(spark):
    empty = spark.createDataFrame([], "s string, ts timestamp, value double")
    assert not counters.counter_ranges(empty, ["s"], 300, 60).collect()
    with pytest.raises(ValueError):
        counters.counter_ranges(empty, ["s"], 0, 60)


def test_a_hot_series_is_sorted_by_pane(spark):
    df = spark.range(10).selectExpr("1 AS s", "timestamp_seconds(id) AS ts", "id AS value")
    plan = counters.counter_ranges(df, ["s"], 3600, 60)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("pane" in w or "_block" in w for w in windows)
