"""Metric samples, packed series, counters, vectors and mapped label sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..functions import formats, labels
from ..operators import catalogue, counters, dimensional, packed, series, vectors
from ..session import new_path, stage_table
from ..sources import snapshots
from .registry import query

S = ("samples",)
P = ("prom",)
KEYS = "host, process, metricGroup, metricName"
FINITE = "NOT isnan(value) AND abs(value) < 'Infinity'::DOUBLE"
CLEAN = f"m AS (SELECT * FROM samples WHERE {FINITE})"


def _clean(spark, sf):
    return series.finite(fixtures.samples(spark, sf))


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("finite_points", f"{CLEAN} SELECT {KEYS}, timestamp_ms, value FROM m", S)
def finite_points(spark, sf):
    return _clean(spark, sf)


SHOWN = "CASE WHEN isfinite(value) THEN value END AS value, isnan(value) AS is_nan, isinf(value) AS is_infinite"


def _shown(df):
    """Non-finite values as flags, so that any reader can compare them."""
    v = F.col("value")
    return df.withColumns(
        {
            "is_nan": F.isnan(v),
            "is_infinite": F.abs(v) == float("inf"),
            "value": F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v),
        }
    )


@query("sentinel_points", f"SELECT {KEYS}, timestamp_ms, {SHOWN} FROM samples WHERE value <> -1.0", S)
def sentinel_points(spark, sf):
    return _shown(series.drop_sentinel(fixtures.samples(spark, sf)))


@query(
    "series_overview",
    f"{CLEAN} SELECT host, metricGroup, count(DISTINCT process) AS series, count(*) AS points FROM m GROUP BY 1, 2",
    S,
)
def series_overview(spark, sf):
    return series.series_overview(_clean(spark, sf))


@query(
    "series_stats",
    f"""{CLEAN} SELECT {KEYS}, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
      round(stddev_pop(value), 6) AS stddev FROM m GROUP BY ALL""",
    S,
)
def series_stats(spark, sf):
    return _rounded(series.series_stats(_clean(spark, sf)), "mean", "stddev")


@query(
    "series_hourly",
    f"""{CLEAN} SELECT host, metricGroup, CAST(hour(make_timestamp(timestamp_ms * 1000)) AS INTEGER) AS hour,
      count(*) AS count, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value
    FROM m GROUP BY ALL""",
    S,
)
def series_hourly(spark, sf):
    return _rounded(series.series_hourly(_clean(spark, sf)), "avg_value")


@query(
    "host_comparison",
    f"""{CLEAN} SELECT host, metricGroup, count(*) AS datapoints, round(avg(value), 6) AS avg,
      round(stddev_samp(value), 6) AS stddev, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95,
      quantile_disc(value, 0.99) AS p99 FROM m GROUP BY 1, 2""",
    S,
)
def host_comparison(spark, sf):
    return _rounded(series.host_comparison(_clean(spark, sf)), "avg", "stddev")


TOP_METRICS = "SELECT metricGroup, metricName, count(*) AS points FROM m GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 10"


@query("top_metrics", f"{CLEAN} {TOP_METRICS}", S)
def top_metrics(spark, sf):
    return series.top_metrics(_clean(spark, sf))


@query(
    "picked_series",
    f"""{CLEAN}, g AS (SELECT metricGroup, metricName, count(*) AS points FROM m GROUP BY 1, 2),
    best AS (SELECT metricGroup, metricName FROM g ORDER BY CASE WHEN contains(metricName, 'cpu_seconds_total') THEN 0
      WHEN contains(metricName, 'requests_total') THEN 1 WHEN contains(metricName, 'alu') THEN 2 ELSE 3 END,
      points DESC, metricGroup, metricName LIMIT 1)
    SELECT {KEYS}, timestamp_ms, value FROM m SEMI JOIN best USING (metricGroup, metricName)""",
    S,
)
def picked_series(spark, sf):
    return series.pick_series(_clean(spark, sf), ["cpu_seconds_total", "requests_total", "alu"])


ZSCORE = f"""{CLEAN}, s AS (SELECT host, metricGroup, metricName, avg(value) AS mean, stddev_samp(value) AS stddev
    FROM m GROUP BY 1, 2, 3),
  z AS (SELECT m.*, mean, stddev, CASE WHEN stddev > 0 THEN abs(value - mean) / stddev ELSE 0 END AS z_score
    FROM m JOIN s USING (host, metricGroup, metricName))"""


@query(
    "zscore",
    f"""{ZSCORE} SELECT {KEYS}, timestamp_ms, value, round(mean, 6) AS mean, round(stddev, 6) AS stddev,
      round(z_score, 6) AS z_score FROM z""",
    S,
)
def zscore(spark, sf):
    return _rounded(series.with_zscore(_clean(spark, sf)), "mean", "stddev", "z_score")


@query(
    "anomalies",
    f"""{ZSCORE} SELECT {KEYS}, timestamp_ms, value, round(mean, 6) AS mean, round(z_score, 6) AS z_score,
      (SELECT count(*) FROM z WHERE z_score > 3) AS anomaly_count
    FROM z WHERE z.z_score > 3 ORDER BY z.z_score DESC, {KEYS}, timestamp_ms LIMIT 20""",
    S,
)
def anomalies(spark, sf):
    return _rounded(series.anomalies(_clean(spark, sf)), "mean", "z_score")


@query(
    "last_not_null",
    f"""{CLEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY timestamp_ms DESC, value DESC) AS n FROM m)
    SELECT {KEYS}, timestamp_ms, value FROM r WHERE n = 1""",
    S,
)
def last_not_null(spark, sf):
    return series.last_value_per_series(_clean(spark, sf))


def _documents(spark, sf):
    """Packed documents of all samples, written once, as a decoder finds them."""
    return stage_table(packed.pack_series(fixtures.samples(spark, sf)), "series-documents")


@query("decode_series", f"SELECT {KEYS}, timestamp_ms, {SHOWN} FROM samples", S)
def decode_series(spark, sf):
    return _shown(packed.decode_series(_documents(spark, sf)))


@query(
    "merged_series",
    f"""{CLEAN} SELECT {KEYS}, min(timestamp_ms) AS ts_start, max(timestamp_ms) AS ts_end,
      count(*) AS "ts_data_amountValues" FROM m GROUP BY ALL""",
    S,
)
def merged_series(spark, sf):
    return packed.merged_catalogue(_documents(spark, sf))


@query(
    "merged_series_points",
    f"""{CLEAN} SELECT {KEYS}, timestamp_ms, value, row_number() OVER (PARTITION BY {KEYS} ORDER BY timestamp_ms, value) - 1
      AS position FROM m""",
    S,
)
def merged_series_points(spark, sf):
    return packed.merged_points(_documents(spark, sf))


@query("merged_series_flat", f"SELECT {KEYS}, timestamp_ms, {SHOWN} FROM samples WHERE value <> -1.0", S)
def merged_series_flat(spark, sf):
    """Segments merged, cleaned and packed again, then flattened."""
    return _shown(packed.decode_series(packed.compact_segments(_documents(spark, sf), "sentinel")))


C = ("counters",)
STEPS = """s AS (SELECT user_id, epoch_us(ts)//1000000 AS t, value,
    lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM counters),
  w AS (SELECT user_id, t - t % 3600 AS window_start,
    CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value ELSE value - before END AS step FROM s),
  i AS (SELECT user_id, window_start, CAST(sum(step) AS BIGINT) AS increase FROM w GROUP BY 1, 2)"""


@query("counter_increase", f"{STEPS} SELECT user_id, window_start, increase FROM i", C)
def counter_increase(spark, sf):
    return counters.counter_increase(fixtures.counters(spark, sf), ["user_id"], 3600, ties=("event_id",))


@query("counter_rate", f"{STEPS} SELECT user_id, window_start, increase / 3600.0::DOUBLE AS rate FROM i", C)
def counter_rate(spark, sf):
    return counters.counter_rate(fixtures.counters(spark, sf), ["user_id"], 3600, ties=("event_id",))


@query(
    "cpu_utilisation",
    f"""{STEPS} SELECT 'node' || (user_id % 5) AS instance, window_start,
      round(1 - avg(increase / 3600.0::DOUBLE), 6) AS utilisation FROM i GROUP BY 1, 2""",
    C,
)
def cpu_utilisation(spark, sf):
    rows = fixtures.counters(spark, sf).withColumn("instance", F.concat(F.lit("node"), (F.col("user_id") % 5).cast("string")))
    used = counters.cpu_utilisation(rows, "instance", ["user_id"], 3600, ties=("event_id",))
    return _rounded(used, "utilisation")


def _ranges(length: int, step: int) -> str:
    """Every reading in every range that holds it; steps are taken anew in each range."""
    return f"""e AS (SELECT user_id, ts, event_id, value, unnest(range(
      (epoch_us(ts)//1000000//{step} + 1) * {step}, epoch_us(ts)//1000000 + {length} + 1, {step})) AS range_end FROM counters),
  s AS (SELECT user_id, range_end, value, lag(value) OVER (PARTITION BY user_id, range_end ORDER BY ts, event_id) AS before FROM e),
  i AS (SELECT user_id, range_end, CAST(sum(CASE WHEN before IS NULL THEN 0 WHEN value < before THEN value
    ELSE value - before END) AS BIGINT) AS increase FROM s GROUP BY 1, 2 HAVING count(*) > 1)"""


@query("counter_increase_sliding", f"{_ranges(86400, 3600)} SELECT user_id, range_end, increase FROM i", C)
def counter_increase_sliding(spark, sf):
    """The growth of the last day, every hour."""
    return counters.counter_ranges(fixtures.counters(spark, sf), ["user_id"], 86400, 3600, ties=("event_id",))


@query("counter_rate_sliding", f"{_ranges(300, 60)} SELECT user_id, range_end, increase / 300.0::DOUBLE AS rate FROM i", C)
def counter_rate_sliding(spark, sf):
    """The rate of the last five minutes, every minute."""
    return counters.counter_range_rates(fixtures.counters(spark, sf), ["user_id"], 300, 60, ties=("event_id",))


@query(
    "cpu_utilisation_sliding",
    f"""{_ranges(3600, 900)} SELECT 'node' || (user_id % 5) AS instance, range_end,
      round(1 - avg(increase / 3600.0::DOUBLE), 6) AS utilisation FROM i GROUP BY 1, 2""",
    C,
)
def cpu_utilisation_sliding(spark, sf):
    """Utilisation over the last hour, every quarter of an hour."""
    rows = fixtures.counters(spark, sf).withColumn("instance", F.concat(F.lit("node"), (F.col("user_id") % 5).cast("string")))
    used = counters.cpu_utilisation_ranges(rows, "instance", ["user_id"], 3600, 900, ties=("event_id",))
    return _rounded(used, "utilisation")


M = ("monitoring",)
VECTOR = """v AS (SELECT host, strftime(date_trunc('hour', event_ts), '%Y-%m-%d %H:%M') AS instant,
  avg(cpu_percent) AS cpu, avg(memory_percent) AS memory FROM monitoring GROUP BY 1, 2)"""


def _vectors(spark, sf):
    """Average cpu and memory per host and hour, as two instant vectors."""
    instant = F.date_format(F.date_trunc("hour", "event_ts"), "yyyy-MM-dd HH:mm").alias("instant")
    both = fixtures.monitoring(spark, sf).groupBy("host", instant).agg(
        F.avg("cpu_percent").alias("cpu"), F.avg("memory_percent").alias("memory")
    )
    cpu = both.where("cpu IS NOT NULL").select("host", "instant", F.col("cpu").alias("value"))
    return cpu, both.select("host", "instant", F.col("memory").alias("value"))


@query(
    "utilisation_ratio",
    f"""{VECTOR} SELECT host, instant, cpu / memory AS div, cpu - memory AS sub, cpu / (cpu + memory) AS share,
      1 - cpu / memory AS used FROM v WHERE cpu IS NOT NULL""",
    M,
)
def utilisation_ratio(spark, sf):
    return vectors.vector_binaries(*_vectors(spark, sf), ["host", "instant"], {op: op for op in ("div", "sub", "share", "used")})


@query("vector_filter", f"{VECTOR} SELECT host, instant, memory AS value FROM v WHERE memory > 60", M)
def vector_filter(spark, sf):
    return vectors.above(_vectors(spark, sf)[1], 60.0)


@query(
    "vector_sum_by",
    f"""{VECTOR} SELECT instant, round(sum(memory), 6) AS sum, round(avg(memory), 6) AS avg, max(memory) AS max
    FROM v GROUP BY 1""",
    M,
)
def vector_sum_by(spark, sf):
    found = vectors.vector_aggs(_vectors(spark, sf)[1], {op: op for op in ("sum", "avg", "max")}, by=["instant"])
    return _rounded(found, "sum", "avg")


@query("vector_count_without", f"{VECTOR} SELECT instant, count(*) AS value FROM v GROUP BY 1", M)
def vector_count_without(spark, sf):
    return vectors.vector_agg(_vectors(spark, sf)[1], "count", without=["host"])


def _flat(df):
    """Label maps as columns."""
    names = {"metric_name": "__name__", "job": "job", "instance": "instance", "brand": "brand", "size": "size"}
    flat = [F.element_at("labels", F.lit(label)).alias(name) for name, label in names.items()]
    return df.select(*flat, F.element_at("labels", F.lit("quantile")).alias("quantile"))


FLAT = "metric_name, job, instance, brand, size, quantile"


@query(
    "label_match",
    f"""SELECT {FLAT} FROM prom WHERE instance = 'node1.nodes.example:9100' AND regexp_full_match(brand, 'Brand#[12].*')
      AND NOT regexp_full_match(coalesce(quantile, ''), '0[.]99|1')""",
    P,
)
def label_match(spark, sf):
    found = vectors.match_labels(
        fixtures.prom_series(spark, sf),
        eq={"instance": "node1.nodes.example:9100"},
        re={"brand": "Brand#[12].*"},
        nre={"quantile": "0[.]99|1"},
    )
    return _flat(found)


@query("label_values", "SELECT DISTINCT brand AS value FROM prom WHERE metric_name = 'economy_red_widget'", P)
def label_values(spark, sf):
    return vectors.label_values(fixtures.prom_series(spark, sf), "economy_red_widget", "brand")


@query("read_series", f"SELECT {FLAT} FROM prom", P)
def read_series(spark, sf):
    """Series written as snapshot answers and read back."""
    path = new_path(spark, "snapshot")
    snapshots.write_series(fixtures.prom_series(spark, sf), path)
    return _flat(snapshots.read_series(spark, path))


STRIPPED = """n AS (SELECT job, instance, brand, size, quantile,
    CASE WHEN job <> '' AND starts_with(metric_name, job || '_') THEN substr(metric_name, length(job) + 2)
      ELSE metric_name END AS name FROM prom WHERE NOT suffix(metric_name, '_info')),
  parts AS (SELECT *, string_split(name, '_') AS p FROM n),
  cuts AS (SELECT job, name, unnest(range(1, len(p) + 1)) AS i, p FROM parts),
  pc AS (SELECT job, array_to_string(p[1:i], '_') AS prefix, count(*) AS n FROM cuts GROUP BY 1, 2)"""


@query("prefix_counts", f"{STRIPPED} SELECT * FROM pc", P)
def prefix_counts(spark, sf):
    return dimensional.prefix_counts(fixtures.prom_series(spark, sf))


@query("hot_prefixes", f"{STRIPPED} SELECT * FROM pc WHERE pc.n > 20 ORDER BY pc.n DESC, job, prefix LIMIT 15", P)
def hot_prefixes(spark, sf):
    return dimensional.hot_prefixes(dimensional.prefix_counts(fixtures.prom_series(spark, sf)), 20)


def _splits(threshold: int) -> str:
    """The first prefix that is not above the threshold ends the group."""
    return f"""{STRIPPED},
  d AS (SELECT DISTINCT job, name, p FROM parts),
  c AS (SELECT d.job, d.name, i, pc.n FROM (SELECT *, unnest(range(1, len(p))) AS i FROM d) d
    JOIN pc ON pc.job = d.job AND pc.prefix = array_to_string(d.p[1:i], '_')),
  f AS (SELECT job, name, min(i) AS first FROM c WHERE n <= {threshold} GROUP BY 1, 2),
  split AS (SELECT d.job, d.name, CAST(coalesce(f.first - 1, len(d.p) - 1) AS INTEGER) AS split, d.p
    FROM d LEFT JOIN f ON f.job = d.job AND f.name = d.name),
  m AS (SELECT job, name, split, array_to_string(p[1:split], '_') AS group_ext,
    array_to_string(p[split+1:len(p)], '_') AS metric FROM split)"""


def _metric_split(name: str, threshold: int):
    @query(name, f"{_splits(threshold)} SELECT * FROM m", P)
    def run(spark, sf):
        return dimensional.split_metric(fixtures.prom_series(spark, sf), threshold)


_metric_split("metric_split", 2)
_metric_split("metric_split_100", 100)


def _dimensions(threshold: int) -> str:
    return f"""{_splits(threshold)},
  dims AS (SELECT DISTINCT n.job AS "ProcessGroup", instance AS "Process", 'cluster' AS "HostGroup",
    string_split(instance, '.')[1] AS "Host",
    CASE WHEN group_ext <> '' AND n.job <> '' THEN n.job || '_' || group_ext WHEN group_ext <> '' THEN group_ext
      WHEN n.job <> '' THEN n.job ELSE string_split(n.name, '_')[1] END AS "MetricGroup",
    metric || '_brand_' || replace(replace(brand, '/', '_'), ' ', '_') || '_size_' || size
      || CASE WHEN quantile IS NULL THEN '' ELSE '_p99' END AS "Metric"
    FROM n JOIN m ON m.job = n.job AND m.name = n.name)"""


DIMENSIONS = '"ProcessGroup", "Process", "HostGroup", "Host", "MetricGroup", "Metric"'


@query("dimensional", f"{_dimensions(20)} SELECT {DIMENSIONS} FROM dims", P)
def to_dimensional(spark, sf):
    return dimensional.to_dimensional(fixtures.prom_series(spark, sf), 20)


@query("group_sizes", f'{_dimensions(20)} SELECT "MetricGroup", count(*) AS metrics FROM dims GROUP BY 1', P)
def group_sizes(spark, sf):
    return dimensional.group_sizes(dimensional.to_dimensional(fixtures.prom_series(spark, sf), 20))


@query("dim_csv", f"{_dimensions(2)} SELECT {DIMENSIONS} FROM dims", P)
def dim_csv(spark, sf):
    """The mapping as sorted CSV files, read back."""
    path = new_path(spark, "dimensional-csv")
    mapped = dimensional.to_dimensional(fixtures.prom_series(spark, sf), 2)
    snapshots.write_csv(mapped, path, dimensional.COLUMNS, ["MetricGroup", "Metric", "Process"])
    return snapshots.read_csv(spark, path, dimensional.COLUMNS)


@query(
    "label_catalogue",
    """l AS (SELECT metric_name, unnest(['job', 'instance', 'brand', 'size', 'quantile']) AS label,
        unnest([job, instance, brand, size, quantile]) AS v FROM prom),
    d AS (SELECT DISTINCT * FROM l WHERE v IS NOT NULL),
    f AS (SELECT metric_name, label, count(*) AS n, list(v ORDER BY v) AS vs FROM d GROUP BY 1, 2),
    t AS (SELECT metric_name, label, n, CASE WHEN n <= 2 THEN array_to_string(vs, ', ')
      ELSE vs[1] || ', ' || vs[2] || ', ...' END AS s FROM f)
    SELECT t.metric_name, CASE length(t.metric_name) % 3 WHEN 0 THEN 'counter' WHEN 1 THEN 'gauge' ELSE 'n/a' END AS _type,
      j.s AS job, i.s AS instance, t.label, CAST(t.n AS VARCHAR) AS count, t.s AS "values"
    FROM t JOIN t j ON j.metric_name = t.metric_name AND j.label = 'job'
      JOIN t i ON i.metric_name = t.metric_name AND i.label = 'instance'
    WHERE t.label NOT IN ('job', 'instance')""",
    P,
)
def label_catalogue(spark, sf):
    return catalogue.label_catalogue(fixtures.prom_series(spark, sf), fixtures.prom_metadata(spark, sf))


@query(
    "fn_hosts",
    """SELECT p_partkey, 'node' || (p_partkey % 5) AS host, split_part(p_name, ':', 1) AS bare,
      'node' || (p_partkey % 5) || ':9100' AS local,
      CASE WHEN starts_with(p_name, lower(p_brand) || '_') THEN '' ELSE p_name END AS stripped,
      array_to_string(list_transform(range(1, len(string_split(p_name, ' ')) + 1),
        lambda i: array_to_string(string_split(p_name, ' ')[1:i], '_')), ' ') AS prefixes,
      CASE WHEN p_size = 1 THEN '_p100' WHEN p_size = 10 THEN '_p10' ELSE '_p' || p_size END AS quantile
    FROM part""",
)
def fn_hosts(spark, sf):
    parts = fixtures.table(spark, sf, "part")
    instance = F.concat(F.lit("node"), (F.col("p_partkey") % 5).cast("string"), F.lit(".nodes.example:9100"))
    return parts.select(
        "p_partkey",
        labels.host_of(instance).alias("host"),
        labels.host_of("p_name").alias("bare"),
        formats.strip_domain(instance, ".nodes.example").alias("local"),
        labels.strip_job("p_name", F.lower("p_brand")).alias("stripped"),
        F.array_join(labels.name_prefixes(F.translate("p_name", " ", "_")), " ").alias("prefixes"),
        labels.quantile_suffix(F.col("p_size").cast("string")).alias("quantile"),
    )
