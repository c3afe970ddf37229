"""Tables that grow by parts and stay compact."""

import os

import pytest
from pyspark.sql import functions as F

from drillspark.streaming import ingest, rollup
from drillspark.streaming.levels import LeveledTable
from drillspark.sources import serving, tables
from trips_data import SCHEMA, make_trips

DATA = make_trips(2000, seed=2)


def table(spark, root, **more):
    return LeveledTable(spark, str(root), "k long, n long", lambda df: df.groupBy("k").agg(F.sum("n").alias("n")), **more)


def batch(spark, i):
    return spark.createDataFrame([(i % 3, 1), (7, 10)], "k long, n long")


def total(t):
    return {r.k: r.n for r in t.combine(t.read()).collect()}


def test_levels_stay_few(spark, tmp_path):
    t = table(spark, tmp_path / "t", fan_in=3, keep=2)
    for i in range(20):
        assert t.add(batch(spark, i), i)
        parts = t.manifest().parts
        assert len(parts) <= 2 * 3  # less than fan_in parts on each of three levels
        assert parts[0].first == 0 and parts[-1].last == i and all(a.last + 1 == b.first for a, b in zip(parts, parts[1:]))
    assert total(t) == {0: 7, 1: 7, 2: 6, 7: 200}
    folders = os.listdir(tmp_path / "t/parts")
    assert len(folders) == len(t.manifest().parts) + len(t.manifest().replaced) and len(folders) < 12
    assert len([f for f in os.listdir(tmp_path / "t/manifest") if f.endswith(".json") and f[0] != "."]) == 2
    assert t.merge(everything=True) == 1 and total(t)[7] == 200


def test_a_batch_counts_once_and_failed_writes_not_at_all(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    t.add(batch(spark, 0), 0)
    assert not t.add(batch(spark, 0), 0)
    monkeypatch.setattr(LeveledTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.add(batch(spark, 1), 1)
    monkeypatch.undo()
    assert total(t) == {0: 1, 7: 10}  # the rows are there, but do not count
    t.add(batch(spark, 1), 1)
    assert total(t) == {0: 1, 1: 1, 7: 20}
    assert t.sweep() == 1 and t.sweep() == 0 and total(t) == {0: 1, 1: 1, 7: 20}


def test_readers_keep_what_they_began_to_read(spark, tmp_path):
    t = table(spark, tmp_path / "t", fan_in=2, keep=3)
    t.add(batch(spark, 0), 0)
    seen = t.read()
    t.add(batch(spark, 1), 1)  # replaces both parts by one
    assert len(t.manifest().parts) == 1 and seen.count() == 2


def test_a_second_writer_is_refused(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    before = t.manifest()
    t.add(batch(spark, 0), 0)
    with pytest.raises(RuntimeError):
        t._commit(before, [])


def test_empty_table_and_wrong_sizes(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read().columns == ["k", "n"] and not t.read().collect() and t.merge() == 0 and t.sweep() == 0
    with pytest.raises(ValueError):
        table(spark, tmp_path / "t", fan_in=1)


def test_compaction_in_the_middle_of_a_stream(spark, tmp_path, rows):
    """Batches before and after a compaction, one of them run twice, give what one batch gives."""
    trips = spark.createDataFrame(DATA, SCHEMA)
    out, checkpoint, source = str(tmp_path / "out"), tmp_path / "cp", str(tmp_path / "in")
    stream = lambda: ingest.file_stream(spark, source, trips.schema, files_per_batch=1)
    for turn in range(3):
        trips.where(F.pmod(F.hash("tpep_pickup_datetime"), F.lit(3)) == turn).repartition(3).write.mode("append").parquet(source)
        rollup.start_hourly_rollup(stream(), out, str(checkpoint), fan_in=4).awaitTermination()
        if turn == 0:
            assert rollup.compact_rollup(spark, out) == 1
        if turn == 1:
            commits = sorted((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
            for file in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
                file.unlink()
    assert len(rollup.rollup_table(spark, out).manifest().parts) < 6
    whole = rollup.hourly_partials(trips).withColumns({c: F.col(c).cast("double") for c in ("revenue", "distance")})
    assert rows(rollup.read_rollup(spark, out)) == rows(whole)
    assert rollup.first_hours(spark, out, None).count() == whole.select("hour").distinct().count()


def test_loaded_months_are_sorted_and_not_cut_up(spark, tmp_path):
    trips = spark.createDataFrame(DATA, SCHEMA)
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    trips.repartition(6).write.parquet(source)
    ingest.ingest_stream(ingest.file_stream(spark, source, trips.schema), target, str(tmp_path / "cp")).awaitTermination()
    loaded = tables.read_months(spark, target)
    assert loaded.count() == len(DATA)
    files = loaded.withColumn("file", F.input_file_name()).groupBy("month").agg(F.countDistinct("file").alias("n"))
    assert {r.n for r in files.collect()} == {1}


def test_a_serving_table_outlives_its_query(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([("a", 1)], "id string, n long")

    path = str(tmp_path / "serving")
    for _ in range(3):
        got = serving.publish_once(spark, path, build)
        assert [tuple(r) for r in got.select("id", "n").collect()] == [("a", 1)]
    assert built == [1]
    serving.publish_once(spark, path, build, fresh=True)
    assert built == [1, 1]
