import base64
import math
import random
import struct
import subprocess
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from drillspark.operators import catalogue, counters, dimensional, packed, series, vectors

SCHEMA = "host string, process string, metricGroup string, metricName string, timestamp_ms bigint, value double"


def make_samples(n=4000):
    """A third of all points belongs to one series."""
    rnd = random.Random(11)
    rows = []
    for i in range(n):
        process = "hot" if i % 3 == 0 else f"p{rnd.randrange(6)}"
        value = rnd.choice([rnd.gauss(50, 5), rnd.gauss(50, 5), rnd.gauss(50, 5), -1.0])
        if i % 50 == 0:
            value = rnd.choice([math.nan, math.inf, -math.inf])
        if i % 501 == 0:
            value = 500.0
        rows.append((f"h{len(process) % 2}", process, "g", rnd.choice(["load", "cpu_seconds_total"]), 1_700_000_000_000 + i * 60_000, value))
    return rows


DATA = make_samples()
GOOD = [r for r in DATA if math.isfinite(r[5])]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(DATA, SCHEMA).repartition(7).cache()


def key(r):
    return tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r)


def test_packing_and_decoding_give_the_points_back(samples):
    docs = packed.pack_series(samples)
    assert sorted(map(key, packed.decode_series(docs).collect()), key=repr) == sorted(map(key, DATA), key=repr)
    for d in docs.collect():
        raw = base64.b64decode(d.ts_data)
        assert len(raw) == 16 * d.ts_data_amountValues
        times = [struct.unpack(">dq", raw[i : i + 16])[1] for i in range(0, len(raw), 16)]
        assert times == sorted(times) and (times[0], times[-1]) == (d.ts_start, d.ts_end)
        assert times[0] // 86_400_000 == times[-1] // 86_400_000


def test_broken_documents(spark):
    good = base64.b64encode(struct.pack(">dqdqdq", 1.5, 10, 9.9, 2**62, 2.5, 20) + b"tail").decode()
    docs = spark.createDataFrame(
        [("h", "p", "g", "m", text) for text in (good, "A", "", None)],
        "ts_host string, ts_process string, ts_metricGroup string, ts_metricName string, ts_data string",
    )
    assert sorted((r.timestamp_ms, r.value) for r in packed.decode_series(docs).collect()) == [(10, 1.5), (20, 2.5)]


def test_executors_need_not_have_the_package(tmp_path):
    from pyspark import cloudpickle

    for function in (packed._pack, packed._unpack):
        path = tmp_path / "function"
        path.write_bytes(cloudpickle.dumps(function))
        code = f"import pickle; print(list(pickle.load(open({str(path)!r}, 'rb'))(iter([]))))"
        run = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True, timeout=60)
        assert run.stdout.strip() == "[]", run.stderr


def test_one_hot_day_of_one_series_is_packed_by_many_tasks(spark):
    points = spark.range(200_000).selectExpr(
        "'h' AS host", "'p' AS process", "'g' AS metricGroup", "'m' AS metricName",
        "1700006400000 + id * 100 AS timestamp_ms", "rand(1) AS value",
    )
    name = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    spark.conf.set(name, "10k")
    try:
        docs = packed.pack_series(points.repartition(16), most=5000).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        spark.conf.unset(name)
    assert len({d.task for d in docs}) > 4
    assert [d.ts_data_amountValues for d in docs] == [5000] * 40


def test_documents_do_not_depend_on_batches(spark, samples):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    found = []
    for size in ("7", "10000"):
        before = spark.conf.get(name)
        spark.conf.set(name, size)
        try:
            docs = packed.pack_series(samples.repartition(int(size) % 5 + 2), most=10)
            found.append(sorted(map(tuple, docs.collect()), key=repr))
        finally:
            spark.conf.set(name, before)
    assert found[0] == found[1] and max(d[6] for d in found[0]) == 10


def test_merged_points_are_numbered_in_time_order(samples):
    got = defaultdict(list)
    for r in packed.merged_points(packed.pack_series(samples, most=9)).collect():
        got[tuple(r)[:4]].append((r.position, r.timestamp_ms, r.value))
    want = defaultdict(list)
    for r in sorted(GOOD, key=lambda r: r[4:6]):
        want[r[:4]].append((len(want[r[:4]]), r[4], r[5]))
    assert {k: sorted(v) for k, v in got.items()} == dict(want)


def test_decoding_gives_bounded_batches():
    """Documents of 200 million points are planned, not built: each batch is taken before the next document is read."""
    import pyarrow as pa

    points = 20_000
    text = base64.b64encode(b"".join(struct.pack(">dq", 1.0, i) for i in range(points))).decode()
    columns = [pa.array(["x"] * 100, pa.string())] * 4 + [pa.DictionaryArray.from_arrays([0] * 100, [text]).cast(pa.string())]
    batch = pa.RecordBatch.from_arrays(columns, ["ts_host", "ts_process", "ts_metricGroup", "ts_metricName", "ts_data"])
    sizes = [b.num_rows for b in packed._unpack(iter([batch] * 5))]
    assert max(sizes) == packed.DECODED and sum(sizes) == 5 * 100 * points


def test_short_documents_share_batches():
    """Thousands of documents of one point each leave in a few batches, and come back in order."""
    import pyarrow as pa

    n = 5000
    names = ["host", "process", "metricGroup", "metricName", "timestamp_ms", "value", "_day", "_document"]
    texts = [pa.array([f"{c}{i}" if i % 7 else None for i in range(n)], pa.string()) for c in "hpgm"]
    rows = pa.RecordBatch.from_arrays([*texts, pa.array(range(n)), pa.array([1.0] * n), pa.array([0] * n), pa.array(range(n))], names)
    docs = list(packed._pack(rows.slice(at, 700) for at in range(0, n, 700)))
    assert [d.num_rows for d in docs] == [packed.PACKED] * 4 + [n - 4 * packed.PACKED]
    back = pa.Table.from_batches(packed._unpack(iter(docs)))
    assert back.select(names[:6]).to_pylist() == pa.Table.from_batches([rows]).select(names[:6]).to_pylist()


def test_merging_cleans_and_recounts(samples, rows):
    docs = packed.pack_series(samples)
    counts = defaultdict(int)
    for r in GOOD:
        counts[r[:4]] += 1
    got = {tuple(r)[:4]: r.ts_data_amountValues for r in packed.merged_catalogue(docs).collect()}
    assert got == counts
    again = packed.decode_series(packed.compact_segments(docs, "sentinel"))
    assert sorted(map(key, again.collect()), key=repr) == sorted((key(r) for r in DATA if r[5] != -1.0), key=repr)


def test_series_statistics(samples):
    good = series.finite(samples)
    groups = defaultdict(list)
    for r in GOOD:
        groups[r[:4]].append(r[5])
    for r in series.series_stats(good).collect():
        values = groups[tuple(r)[:4]]
        mean = sum(values) / len(values)
        assert (r.n, r.min, r.max) == (len(values), min(values), max(values))
        assert r.mean == pytest.approx(mean)
        assert r.stddev == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)))


def test_zscore_equals_the_window_form(samples):
    from pyspark.sql import Window

    good = series.finite(samples)
    w = Window.partitionBy(*series.METRIC)
    plain = good.withColumn("m", F.avg("value").over(w)).withColumn("s", F.stddev("value").over(w))
    plain = plain.withColumn("z", F.abs(F.col("value") - F.col("m")) / F.col("s"))
    expected = {(r.process, r.timestamp_ms): r.z for r in plain.collect()}
    got = {(r.process, r.timestamp_ms): r.z_score for r in series.with_zscore(good).collect()}
    assert got.keys() == expected.keys()
    assert all(got[k] == pytest.approx(expected[k], abs=1e-9) for k in got)
    far = series.anomalies(good, 3.0, 5).collect()
    assert far[0].anomaly_count == sum(z > 3 for z in expected.values())
    assert [r.z_score for r in far] == pytest.approx(sorted(expected.values(), reverse=True)[:5])


def test_points_without_a_host_are_kept(spark):
    df = spark.createDataFrame([(None, "p", "g", "m", i, float(i)) for i in range(5)], SCHEMA)
    assert [r.mean for r in series.with_zscore(df).collect()] == [2.0] * 5
    assert series.host_comparison(df).first().median == 2.0


def test_constant_series_has_no_anomalies(spark):
    flat = spark.createDataFrame([("h", "p", "g", "m", i, 4.0) for i in range(20)], SCHEMA)
    assert {r.z_score for r in series.with_zscore(flat).collect()} == {0.0}


def test_pick_series_prefers_patterns(samples):
    good = series.finite(samples)
    picked = series.pick_series(good, ["nothing", "cpu_seconds_total"], n_processes=2).collect()
    assert {r.metricName for r in picked} == {"cpu_seconds_total"}
    assert {r.process for r in picked} == {"hot", "p0"}
    assert [r.timestamp_ms for r in picked] == sorted(r.timestamp_ms for r in picked)
    expected = [r for r in GOOD if r[3] == "cpu_seconds_total" and r[1] in ("hot", "p0")]
    assert len(picked) == len(expected)
    largest = series.top_metrics(good, 1).first().metricName
    assert {r.metricName for r in series.pick_series(good, ["nothing"]).collect()} == {largest}


def test_last_value(samples):
    latest = {}
    for r in DATA:
        if r[4] >= latest.get(r[:4], (0, 0))[0]:
            latest[r[:4]] = (r[4], r[5])
    got = {tuple(r)[:4]: (r.timestamp_ms, r.value) for r in series.last_value_per_series(samples).collect()}
    assert {k: key(v) for k, v in got.items()} == {k: key(v) for k, v in latest.items()}


@pytest.mark.parametrize("window", [60, 300, 3600, 86_400, 200_000])
def test_counter_increase(spark, window):
    rnd = random.Random(window)
    readings = []
    for name, n in [("hot", 900), ("rare", 20), ("once", 1), (None, 30)]:
        t, v = 1_700_000_000, rnd.randrange(50)
        for _ in range(n):
            t += rnd.choice([15, 15, 30, 700, 90_000 if rnd.random() < 0.1 else 60])
            v = 0 if rnd.random() < 0.05 else v + rnd.randrange(9)
            readings.append((name, t, v))
    expected = defaultdict(int)
    previous = {}
    for name, t, v in readings:
        last = previous.get(name)
        expected[name, t - t % window] += 0 if last is None else v if v < last else v - last
        previous[name] = v
    rnd.shuffle(readings)
    df = spark.createDataFrame(readings, "instance string, t bigint, value bigint").withColumn("ts", F.timestamp_seconds("t"))
    got = {(r.instance, r.window_start): r.increase for r in counters.counter_increase(df, ["instance"], window).collect()}
    assert got == dict(expected)
    rates = {(r.instance, r.window_start): r.rate for r in counters.counter_rate(df, ["instance"], window).collect()}
    assert rates == pytest.approx({k: v / window for k, v in expected.items()})


def test_vectors(spark, rows):
    a = spark.createDataFrame([("x", "1", 6.0), ("y", "1", 8.0), ("z", "1", 1.0)], "host string, t string, value double")
    b = spark.createDataFrame([("x", "1", 3.0), ("y", "1", 0.0)], "host string, t string, value double")
    assert rows(vectors.vector_binary(a, b, ["host", "t"], "sub")) == [("x", "1", 3.0), ("y", "1", 8.0)]
    assert rows(vectors.vector_binary(a, b, ["host", "t"], "div")) == [("x", "1", 2.0), ("y", "1", None)]
    assert rows(vectors.vector_binary(a, b, ["host", "t"], "used").where("host = 'x'")) == [("x", "1", -1.0)]
    assert rows(vectors.vector_binary(a, b, ["host", "t"], "share").where("host = 'x'")) == [("x", "1", 6 / 9)]
    assert rows(vectors.vector_agg(a, "sum")) == [(15.0,)]
    assert rows(vectors.vector_agg(a, "max", by=["t"])) == [("1", 8.0)]
    assert rows(vectors.vector_agg(a, "count", without=["host"])) == [("1", 3)]
    assert vectors.above(a, 1.0).count() == 2


def frame(spark, labels):
    return spark.createDataFrame([(m,) for m in labels], "labels map<string,string>")


def test_label_matchers(spark):
    s = frame(spark, [{"device": "lo"}, {"device": "eth0"}, {"device": "docker1"}, {"other": "x"}])
    kept = vectors.match_labels(s, nre={"device": "lo|docker.*|veth.*"}).collect()
    assert [r.labels for r in kept] == [{"device": "eth0"}, {"other": "x"}]
    assert vectors.match_labels(s, re={"device": "eth"}).count() == 0
    assert vectors.match_labels(s, eq={"device": ""}).count() == 1
    lines = frame(spark, [{"device": "a\n"}, {"device": "a"}, {"device": "b\nc"}])
    assert vectors.match_labels(lines, re={"device": "a"}).count() == 1
    assert vectors.match_labels(lines, re={"device": "b.c"}).count() == 1


def mapped(spark, labels, threshold=100):
    return {tuple(r) for r in dimensional.to_dimensional(frame(spark, labels), threshold).collect()}


def test_mapping_of_worked_examples(spark):
    node = {"instance": "node1.cloud.local:9100", "job": "node", "__name__": "node_cpu_seconds_total"}
    go = {"instance": "node0.cloud.local:9090", "job": "prometheus"}
    labels = [
        {**node, "cpu": "0", "mode": "idle"},
        {**node, "cpu": "0", "mode": "user"},
        {"__name__": "jvm_memory_bytes_used", "area": "heap", "instance": "node0.cloud.local:9404", "job": "spark"},
        {"__name__": "avg_latency", "instance": "node1.cloud.local:7070", "job": "zookeeper"},
        {**go, "__name__": "go_gc_duration_seconds", "quantile": "0.5"},
        {**go, "__name__": "go_gc_duration_seconds_sum"},
        {**go, "__name__": "go_build_info"},
        {"__name__": "lonely_metric"},
        {
            "__name__": "search_metrics_core_errors_total", "base_url": "http://x", "category": "QUERY", "cluster_id": "c",
            "collection": "rides", "core": "k", "handler": "/select", "instance": "node1.cloud.local:9854",
            "internal": "false", "job": "search", "replica": "replica_n1", "shard": "shard1",
        },
    ]
    long = "metrics_core_errors_total_category_QUERY_collection_rides_handler__select_internal_false_replica_replica_n1_shard_shard1"
    assert mapped(spark, labels) == {
        ("node", "node1.cloud.local:9100", "cluster", "node1", "node", "cpu_seconds_total_cpu_0_mode_idle"),
        ("node", "node1.cloud.local:9100", "cluster", "node1", "node", "cpu_seconds_total_cpu_0_mode_user"),
        ("spark", "node0.cloud.local:9404", "cluster", "node0", "spark", "jvm_memory_bytes_used_area_heap"),
        ("zookeeper", "node1.cloud.local:7070", "cluster", "node1", "zookeeper", "avg_latency"),
        ("prometheus", "node0.cloud.local:9090", "cluster", "node0", "prometheus", "go_gc_duration_seconds_p50"),
        ("prometheus", "node0.cloud.local:9090", "cluster", "node0", "prometheus", "go_gc_duration_seconds_sum"),
        ("", "", "cluster", "", "lonely", "lonely_metric"),
        ("search", "node1.cloud.local:9854", "cluster", "node1", "search", long),
    }


def test_groups_grow_while_prefixes_are_crowded(spark):
    """101 series share metrics_core, one of them has a name of its own below metrics."""
    labels = [{"__name__": f"search_metrics_core_m{i}_total", "job": "search", "instance": "n:1"} for i in range(101)]
    labels.append({"__name__": "search_metrics_jvm_x", "job": "search", "instance": "n:1"})
    got = {(r[4], r[5]) for r in mapped(spark, labels)}
    assert ("search_metrics_core", "m7_total") in got and ("search_metrics", "jvm_x") in got and len(got) == 102
    at_limit = {(r[4], r[5]) for r in mapped(spark, labels[:100])}
    assert at_limit == {("search", f"metrics_core_m{i}_total") for i in range(100)}


def test_the_last_part_never_moves_into_the_group(spark):
    labels = [{"__name__": "j_a_b", "job": "j", "instance": f"n{i}"} for i in range(5)]
    assert {(r[4], r[5]) for r in mapped(spark, labels, 2)} == {("j_a", "b")}
    assert {(r[4], r[5]) for r in mapped(spark, [{"__name__": "single", "job": "", "i": str(i)} for i in range(5)], 2)} == {
        ("single", f"single_i_{i}") for i in range(5)
    }


def test_duplicates_collapse_only_when_asked(spark):
    labels = [{"__name__": "x", "job": "j", "instance": "n", "core": str(i)} for i in range(4)]
    s = frame(spark, labels)
    assert dimensional.to_dimensional(s).count() == 1
    assert dimensional.to_dimensional(s, distinct=False).count() == 4


def test_prefix_counts_and_hot_prefixes(spark, rows):
    s = frame(spark, [{"__name__": "a_b", "job": ""}, {"__name__": "a_c", "job": ""}, {"__name__": "a_b_info", "job": ""}])
    counts = dimensional.prefix_counts(s)
    assert rows(counts) == [("", "a", 2), ("", "a_b", 1), ("", "a_c", 1)]
    assert rows(dimensional.hot_prefixes(counts, 1)) == [("", "a", 2)]


def test_label_catalogue(spark, rows):
    s = frame(
        spark,
        [
            {"__name__": "m", "job": "a", "instance": "i1", "mode": "user"},
            {"__name__": "m", "job": "a", "instance": "i2", "mode": "idle"},
            {"__name__": "m", "job": "a", "instance": "i3", "mode": "nice"},
            {"__name__": "plain", "job": "b"},
            {"job": "c", "mode": "x"},
        ],
    )
    meta = spark.createDataFrame([("m", "counter"), ("plain", "")], "metric_name string, type string")
    assert rows(catalogue.label_catalogue(s, meta).select(*catalogue.COLUMNS)) == [
        ("m", "counter", "a", "i1, i2, ...", "mode", "3", "idle, nice, ..."),
        ("plain", "n/a", "b", "", "", "", ""),
        ("unknown", "n/a", "c", "", "mode", "1", "x"),
    ]
