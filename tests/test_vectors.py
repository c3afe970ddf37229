"""Vector matching in one shuffle."""

import pytest
from pyspark.errors import PySparkException

from drillspark.operators import vectors


def vector(spark, rows):
    return spark.createDataFrame(rows, "host string, t int, value double")


def test_all_operations_at_once(spark, rows):
    a = vector(spark, [("x", 1, 6.0), ("y", 1, 8.0), ("z", 1, 1.0), (None, 1, 2.0), ("v", 1, None)])
    b = vector(spark, [("x", 1, 3.0), ("y", 1, 0.0), (None, 1, 4.0), ("w", 1, 4.0), ("v", 1, 1.0)])
    got = vectors.vector_binaries(a, b, ["host", "t"], {"d": "div", "s": "sub", "h": "share", "u": "used"})
    assert rows(got) == rows(
        spark.createDataFrame(
            [
                ("x", 1, 2.0, 3.0, 6 / 9, -1.0),
                ("y", 1, None, 8.0, 1.0, None),
                (None, 1, 0.5, -2.0, 2 / 6, 0.5),
                ("v", 1, None, None, None, None),
            ],
            "host string, t int, d double, s double, h double, u double",
        )
    )


@pytest.mark.parametrize("side", [0, 1])
def test_a_repeated_label_set_is_refused(spark, side):
    sides = [vector(spark, [("x", 1, 1.0)]), vector(spark, [("x", 1, 2.0)])]
    sides[side] = sides[side].unionByName(sides[side])
    with pytest.raises(PySparkException, match="repeated"):
        vectors.vector_binary(*sides, ["host", "t"], "div").collect()


def test_one_exchange(spark):
    a = vector(spark, [("x", 1, 1.0)])
    plan = vectors.vector_binaries(a, a, ["host", "t"], {"d": "div", "s": "sub"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    many = vectors.vector_aggs(a, {"sum": "sum", "max": "max"}, by=["t"])._jdf.queryExecution().executedPlan().toString()
    assert many.count("Exchange hashpartitioning") == 1


def test_aggregates(spark, rows):
    a = vector(spark, [("x", 1, 1.0), ("y", 1, 3.0), ("x", 2, 5.0)])
    assert rows(vectors.vector_aggs(a, {"n": "count", "m": "avg"}, without=["host"])) == [(1, 2, 2.0), (2, 1, 5.0)]
    assert rows(vectors.vector_agg(a, "max")) == [(5.0,)]
