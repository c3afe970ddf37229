import datetime as dt
import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from drillspark.operators import dimensional, rollups, routes
from drillspark.sources import documents, serving, shards, snapshots, tables, trips as trip_files, workingset
from drillspark.streaming import ingest, rollup
from trips_data import SCHEMA, make_trips

DATA = make_trips(2000, seed=2)


@pytest.fixture(scope="module")
def trips(spark):
    return spark.createDataFrame(DATA, SCHEMA).cache()


def plan(df):
    """The physical plan with whole lists, not shortened ones."""
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_harmonise(spark):
    a = spark.createDataFrame([(1, 2, "Y", 3.0, 9)], "VendorID int, passenger_count bigint, store_and_fwd_flag string, airport_fee double, only_a int")
    b = spark.createDataFrame([(5.0, "N", 6, 7)], "Airport_fee double, store_and_fwd_flag string, passenger_count int, VendorID int")
    both = trip_files.union_months([a, b])
    assert dict(both.dtypes) == {
        "VendorID": "double", "airport_fee": "double", "passenger_count": "double", "store_and_fwd_flag": "string",
    }
    assert both.columns == sorted(both.columns)
    assert {(r.VendorID, r.airport_fee, r.store_and_fwd_flag) for r in both.collect()} == {(1.0, 3.0, "Y"), (7.0, 5.0, "N")}


@pytest.mark.parametrize("target", ["path", "table"])
def test_load_if_empty(spark, trips, tmp_path, target):
    name = str(tmp_path / "t") if target == "path" else "trips_loaded_once"
    assert tables.load_if_empty(trips, name)
    assert not tables.load_if_empty(trips, name)
    loaded = spark.read.parquet(name) if target == "path" else spark.table(name)
    assert loaded.count() == len(DATA)


def test_monthly_table_prunes_and_pushes_down(spark, trips, tmp_path):
    path = str(tmp_path / "monthly")
    tables.write_trips(trips, path)
    week = tables.read_months(spark, path, "2023-01-09", "2023-01-16")
    found = week.where(F.col("PULocationID") == 1).select("id", "total_amount")
    text = plan(found)
    assert "PartitionFilters: [" in text and "month" in text.split("PartitionFilters: [")[1].split("]")[0]
    pushed = text.split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(pickup_date,2023-01-09)" in pushed and "EqualTo(PULocationID,1)" in pushed
    columns = "id:int,tpep_pickup_datetime:timestamp_ntz,PULocationID:bigint,total_amount:double,pickup_date:date"
    assert f"ReadSchema: struct<{columns}>" in text
    low, high = dt.datetime(2023, 1, 9), dt.datetime(2023, 1, 16)
    assert found.count() == sum(low <= r[1] <= high and r[5] == 1 for r in DATA)
    assert tables.read_months(spark, path).count() == len(DATA)


def test_describe_and_profile(spark, trips, tmp_path):
    cells = tables.describe_table(trips, ["id"], 2).collect()
    assert len(cells) == 2 * len(trips.columns)
    assert ("PULocationID", "bigint") in {(c.column, c.type) for c in cells}
    path = str(tmp_path / "p")
    trips.repartition(3).write.parquet(path)
    profile = tables.dataset_profile(spark.read.parquet(path)).first()
    sizes = [os.path.getsize(f"{path}/{name}") for name in os.listdir(path) if name.endswith(".parquet")]
    assert (profile.rows, profile.files, profile.bytes) == (len(DATA), 3, sum(sizes))


def test_shards(spark, trips, tmp_path):
    root = str(tmp_path / "shards")
    written = {r.shard: r.docs for r in shards.write_shards(trips, root, 5, F.col("id")).collect()}
    assert written == Counter(r[0] % 5 for r in DATA)
    assert {r.shard: r.docs for r in shards.shard_stats(spark, root).collect()} == written
    stats = {r.node: r for r in shards.import_stats(shards.shard_stats(spark, root), ["n1", "n2"]).collect()}
    assert (stats["n1"].shards, stats["n2"].shards) == (3, 2)
    assert stats["n1"].targets == "shard0, shard2, shard4"
    assert stats["n1"].docs + stats["n2"].docs == len(DATA)
    schema = "id int, PULocationID bigint, tpep_pickup_datetime string"
    found = shards.read_shards(spark, root, schema, F.col("PULocationID") == 1, ["id", "tpep_pickup_datetime"], [0, 3])
    expected = {r[0]: r[1].strftime("%Y-%m-%dT%H:%M:%SZ") for r in DATA if r[5] == 1 and r[0] % 5 in (0, 3)}
    assert {r.id: r.tpep_pickup_datetime for r in found.collect()} == expected
    assert shards.read_shards(spark, root, schema, F.col("PULocationID") == 99).isEmpty()


@pytest.mark.parametrize("file_format", ["json", "parquet"])
def test_rejected_rows_stand_beside_the_shards(spark, tmp_path, file_format):
    root = str(tmp_path / "shards")
    df = spark.createDataFrame([(1, 5.0), (9, 1.0), (None, 2.0), (4, None), (13, -1.0), (5, 3.0)], "id bigint, fare double")
    written = shards.write_shards(df.repartition(3), root, 4, F.col("id"), file_format=file_format, valid=F.col("fare") > 0)
    assert {r.shard: r.docs for r in written.collect()} == {0: 0, 1: 3, 2: 0, 3: 0, None: 3}
    schema = "id bigint, fare double"
    back = shards.read_rejected(spark, root, schema, file_format)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted([(None, 2.0), (4, None), (13, -1.0)], key=repr)
    assert {r.id for r in shards.read_shards(spark, root, schema, file_format=file_format).collect()} == {1, 9, 5}
    assert [tuple(r) for r in shards.shard_stats(spark, root, file_format).select("shard", "docs").collect()] == [(1, 3)]
    nodes = {r.node: (r.shards, r.docs) for r in shards.import_stats(written, ["a", "b"]).collect()}
    assert nodes == {"a": (2, 0), "b": (2, 3)}


def test_parquet_shards_push_filters_down(spark, trips, tmp_path):
    root = str(tmp_path / "shards")
    shards.write_shards(trips, root, 3, F.col("id"), file_format="parquet")
    assert {r.shard: r.docs for r in shards.shard_stats(spark, root, "parquet").collect()} == Counter(r[0] % 3 for r in DATA)
    found = shards.read_shards(
        spark, root, "id int, PULocationID bigint", F.col("PULocationID") == 1, ["id"], [1], file_format="parquet"
    )
    assert "EqualTo(PULocationID,1)" in plan(found) and "(shard#" in plan(found).split("PartitionFilters: [")[1]
    assert {r.id for r in found.collect()} == {r[0] for r in DATA if r[5] == 1 and r[0] % 3 == 1}


def test_one_hot_shard_is_split(spark, tmp_path):
    root = str(tmp_path / "hot")
    rows = spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("pad"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        shards.write_shards(rows.repartition(8), root, 4, F.lit(2))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stats = shards.shard_stats(spark, root).collect()
    assert [(r.shard, r.docs) for r in stats] == [(2, 60_000)] and stats[0].files > 1


def test_documents(spark):
    df = spark.createDataFrame(
        [(dt.date(2023, 1, 9), dt.datetime(2023, 1, 9, 5, 6, 7), float("nan"), [3, 4], [])],
        "d date, t timestamp_ntz, x double, many array<int>, none array<int>",
    )
    r = documents.unwrap(documents.to_documents(df)).first()
    assert tuple(r) == ("2023-01-09", "2023-01-09T05:06:07Z", None, 3, None)


def test_publishing_replaces_the_table(spark, trips, tmp_path):
    path = str(tmp_path / "daily")
    serving.publish(rollups.rollup_daily(trips), path)
    serving.publish(rollups.rollup_daily(trips), path)
    daily = serving.read_serving(spark, path, ["pickup_date"], ["trip_count", "day_name"])
    days = sorted({r[1].strftime("%Y-%m-%d") for r in DATA})
    got = daily.collect()
    assert [r.pickup_date for r in got] == days
    assert dict(daily.dtypes)["trip_count"] == "double" and {r.day_name for r in got} == {None}
    table = spark.read.parquet(path)
    assert [r.pickup_date for r in serving.serving_last_days(table, 3).collect()] == days[::-1][:3]
    assert sum(r.days for r in serving.serving_dow(table).collect()) == len(days)


def test_working_set(trips):
    held = workingset.WorkingSet(lambda: trips.where("id < 100"))
    assert not held.valid() and held.info() == {"loaded": False}
    assert routes.top_routes(held.get(), n=1).count() == 1
    assert held.valid() and held.info()["rows"] == 100
    assert held.info_frame().first().rows == 100
    held.invalidate()
    assert not held.valid()


def test_snapshots(spark, tmp_path):
    answers = [
        {"status": "success", "data": [{"__name__": "a", "job": "j"}, {"__name__": "b"}]},
        {"status": "error", "data": [{"__name__": "lost"}]},
    ]
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(map(json.dumps, answers)))
    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps(answers[0], indent=2))
    expected = [{"__name__": "a", "job": "j"}, {"__name__": "b"}]
    for path, by_line in ((lines, True), (whole, False)):
        got = [r.labels for r in snapshots.read_series(spark, str(path), by_line).collect()]
        assert sorted(got, key=lambda m: m["__name__"]) == expected
    from drillspark.operators.catalogue import first_types

    meta = tmp_path / "meta.json"
    meta.write_text(json.dumps({"status": "success", "data": {"a": [{"type": "counter", "help": "h"}, {"type": "gauge", "help": ""}]}}))
    types = first_types(snapshots.read_metadata(spark, str(meta), lines=False)).collect()
    assert [tuple(r) for r in types] == [("a", "counter")]


def test_csv(spark, tmp_path):
    rows = [("p", "", "cluster", "h", g, m) for g in ("g2", "g1") for m in ("b,c", 'a"q', "z")]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in dimensional.COLUMNS))
    path = str(tmp_path / "csv")
    snapshots.write_csv(df, path, dimensional.COLUMNS, ["MetricGroup", "Metric"])
    got = [tuple(r) for r in snapshots.read_csv(spark, path, dimensional.COLUMNS).collect()]
    assert sorted(got) == sorted(rows)
    described = str(tmp_path / "described")
    snapshots.write_described_csv(df, described, dimensional.COLUMNS, ["x"] * 6, ["MetricGroup", "Metric"], 100)
    text = "\n".join(r.value for r in spark.read.text(described).collect()).splitlines()
    assert text[0] == "# x,x,x,x,x,x" and text[1] == ",".join(dimensional.COLUMNS) and len(text) == 8
    with pytest.raises(ValueError):
        snapshots.write_described_csv(df, described, dimensional.COLUMNS, ["x"] * 6, ["MetricGroup"], 3)


@pytest.fixture(scope="module")
def trip_folder(trips, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("arriving") / "trips")
    trips.repartition(6).write.parquet(path)
    return path


def test_streamed_rollup_equals_batch(spark, trips, trip_folder, tmp_path, rows):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    stream = ingest.file_stream(spark, trip_folder, trips.schema, files_per_batch=2)
    rollup.start_hourly_rollup(stream, out, checkpoint).awaitTermination()
    assert [(p.first, p.last) for p in rollup.rollup_table(spark, out).manifest().parts] == [(0, 0), (1, 1), (2, 2)]
    batch = rollup.hourly_partials(trips).withColumns(
        {"revenue": F.col("revenue").cast("double"), "distance": F.col("distance").cast("double")}
    )
    assert rows(rollup.read_rollup(spark, out)) == rows(batch)
    hours = rollup.first_hours(spark, out, 5).collect()
    expected = Counter(r[1].replace(minute=0, second=0) for r in DATA)
    assert [(r.hour, r.total_trips) for r in hours] == sorted(expected.items())[:5]
    compacted = str(tmp_path / "compacted")
    assert rollup.compact_rollup(spark, out, compacted) == 1
    assert rows(rollup.read_rollup(spark, compacted)) == rows(batch)
    assert rollup.compact_rollup(spark, out) == 1
    assert rows(rollup.read_rollup(spark, out)) == rows(batch)


def test_a_repeated_batch_counts_once(spark, trips, trip_folder, tmp_path, rows):
    """The last batch runs again after its commit was lost."""
    out, checkpoint = str(tmp_path / "out"), tmp_path / "cp"
    stream = lambda: ingest.file_stream(spark, trip_folder, trips.schema, files_per_batch=3)
    rollup.start_hourly_rollup(stream(), out, str(checkpoint)).awaitTermination()
    before = rows(rollup.read_rollup(spark, out))
    for commit in (checkpoint / "commits").glob("*1*"):
        commit.unlink()
    rollup.start_hourly_rollup(stream(), out, str(checkpoint)).awaitTermination()
    assert rows(rollup.read_rollup(spark, out)) == before


def test_ingest_loads_new_files_only(spark, trips, trip_folder, tmp_path):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "cp")
    for _ in range(2):
        stream = ingest.file_stream(spark, trip_folder, trips.schema)
        ingest.ingest_stream(stream, table, checkpoint).awaitTermination()
    assert tables.read_months(spark, table).count() == len(DATA)


def test_arriving_trips_are_not_shuffled(spark, tmp_path, rows):
    """A part of the trips is written by the tasks that read them, and the parts together are all trips."""
    from drillspark import fixtures
    from drillspark.plans import table_queries

    copies = 3
    lines = spark.createDataFrame(
        [(i // 3, i % 3 if i % 11 else None, i % 7) for i in range(300)], "l_orderkey long, l_linenumber int, l_partkey long"
    ).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "1L AS l_suppkey", "CAST(2 AS DOUBLE) AS l_quantity", "CAST(400 AS DOUBLE) AS l_extendedprice",
        "CAST(0 AS DOUBLE) AS l_discount", "CAST(0 AS DOUBLE) AS l_tax", "'N' AS l_returnflag", "DATE'2024-01-01' AS l_shipdate",
    )
    lines.repartition(copies).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        for arrival in range(4):
            table_queries._arrive(spark, str(tmp_path), f"{tmp_path}/arrived", arrival)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows(spark.read.parquet(f"{tmp_path}/arrived")) == rows(fixtures.trips(spark, str(tmp_path)))
    assert len(list((tmp_path / "arrived").glob("*.parquet"))) > 4  # a file for each task, not one for each part
