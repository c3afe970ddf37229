"""Properties that must hold for any input."""

from collections import Counter
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from drillspark.operators import facets, packed
from drillspark.operators.filters import TRIP_FIELDS, compile_filters, selection_to_filters
from trips_data import SCHEMA, make_trips

POINTS = st.lists(
    st.tuples(
        st.sampled_from(["h1", "h2"]),
        st.sampled_from(["p", None]),
        st.integers(-(10**13), 10**13),
        st.floats(allow_nan=False, width=64),
    ),
    max_size=60,
)


@given(POINTS, st.integers(1, 7), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_packing_keeps_every_point(points, most, at_once):
    """Documents end where they should, whatever the size of the batches that points come in."""
    points = sorted(points, key=lambda p: (p[0], p[1] or "", p[2]))
    days = [p[2] // packed.DAY_MS for p in points]
    seen = Counter()
    numbers = []
    for p, day in zip(points, days):
        numbers.append(seen[p[0], p[1], day] // most)
        seen[p[0], p[1], day] += 1
    batch = pa.RecordBatch.from_arrays(
        [
            pa.array([p[0] for p in points], pa.string()),
            pa.array([p[1] for p in points], pa.string()),
            pa.array(["g"] * len(points), pa.string()),
            pa.array(["m"] * len(points), pa.string()),
            pa.array([p[2] for p in points], pa.int64()),
            pa.array([p[3] for p in points], pa.float64()),
            pa.array(days, pa.int64()),
            pa.array(numbers, pa.int64()),
        ],
        ["host", "process", "metricGroup", "metricName", "timestamp_ms", "value", "_day", "_document"],
    )
    batches = [batch.slice(i, at_once) for i in range(0, len(points), at_once)]
    docs = list(packed._pack(iter(batches)))
    assert [d.to_pylist() for d in docs] == [d.to_pylist() for d in packed._pack(iter([batch]))]
    for d in docs:
        rows = d.to_pylist()
        assert all(0 < r["ts_data_amountValues"] <= most for r in rows)
        assert all(r["ts_start"] // packed.DAY_MS == r["ts_end"] // packed.DAY_MS for r in rows)
    back = [tuple(r[c] for c in ("host", "process", "timestamp_ms", "value")) for b in packed._unpack(iter(docs), most) for r in b.to_pylist()]
    assert all(b.num_rows <= most for b in packed._unpack(iter(docs), most))
    assert sorted(back, key=repr) == sorted(points, key=repr)


@given(st.lists(st.text(max_size=12)))
def test_any_selection_can_be_read(items):
    chosen = selection_to_filters(items)
    assert sum(map(len, chosen.values())) == sum(":" in i for i in items)


NAMES = ["pickup_hour", "pickup_dayofweek", "payment_type", "DOLocationID"]


@pytest.mark.parametrize("seed", range(6))
def test_facet_counts_add_up(spark, seed):
    """The counts of a field add up to the rows under the other fields' filters."""
    rnd = random.Random(seed)
    trips = spark.createDataFrame(make_trips(800, seed), SCHEMA)
    chosen = {
        "pickup_hour": rnd.sample(range(24), rnd.randrange(1, 12)),
        "payment_type": rnd.sample(range(1, 7), rnd.randrange(1, 4)),
        "total_amount": [f"[{rnd.randrange(0, 30)} TO {rnd.choice(['*', 50, 70])}]", f"[* TO {rnd.randrange(-5, 10)}]"],
    }
    for name in rnd.sample(list(chosen), rnd.randrange(0, 3)):
        del chosen[name]
    sums = facets.facets(trips, chosen, NAMES, TRIP_FIELDS, limit=None).groupBy("field").agg(F.sum("count").alias("n"))
    got = {r.field: r.n for r in sums.collect()}
    expected = {"*": trips.where(compile_filters(chosen, TRIP_FIELDS)).count()}
    for name in NAMES:
        expected[name] = trips.where(compile_filters(chosen, TRIP_FIELDS, exclude=name)).count()
    assert got == {k: v for k, v in expected.items() if v or k == "*"}
