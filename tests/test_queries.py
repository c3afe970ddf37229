"""Every named query against its SQL, and the shape of the plans."""

import duckdb
import pytest

import __spark_entry__ as entry
import check
from drillspark.plans import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON_ALLOWED = {"decode_series", "merged_series", "merged_series_flat", "merged_series_points"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    result = check.compare(spark, con, name, SF)
    assert result.startswith("ok") or result.startswith("EMPTY")


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", list(QUERIES))
def test_plan(spark, name):
    """No pairwise joins, and Python only where series are packed or decoded."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON_ALLOWED:
        assert "Python" not in plan and "MapInArrow" not in plan


ONE_SCAN = ["facets_multi", "overall_stats", "rollup_daily", "null_profile", "corr_matrix", "clean_report", "by_month"]


@pytest.mark.parametrize("name", ONE_SCAN)
def test_one_scan(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_facets_cut_their_lists_before_the_shuffle(spark):
    plan = entry.queries()["facets_multi"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_columns_are_pruned(spark):
    plan = entry.queries()["bench_top_locations"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_suppkey:bigint>" in plan


@pytest.mark.parametrize("name", ["zscore", "dimensional", "label_catalogue", "zone_lookup", "counter_rate", "host_comparison"])
def test_results_without_any_broadcast(spark, con, name):
    """What is too large to broadcast is joined by shuffle, with the same result."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert check.compare(spark, con, name, SF).startswith("ok")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
