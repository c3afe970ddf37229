"""Analysis of metric samples: (host, process, metricGroup, metricName, timestamp_ms, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_finite
from ..functions.times import from_epoch_ms, hour_of
from ..session import stage_table
from .joins import join_on
from .quantiles import quantiles

SERIES = ["host", "process", "metricGroup", "metricName"]
METRIC = ["host", "metricGroup", "metricName"]
SENTINEL = -1.0


def finite(df: DataFrame, value: str = "value") -> DataFrame:
    """Without NaN, infinite and missing points."""
    return df.where(is_finite(value))


def drop_sentinel(df: DataFrame, sentinel: float = SENTINEL, value: str = "value") -> DataFrame:
    """Without points that only say that no answer came; missing values stay."""
    return df.where(~F.col(value).eqNullSafe(F.lit(sentinel)))


def with_time(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", from_epoch_ms("timestamp_ms"))


def series_overview(df: DataFrame) -> DataFrame:
    """Series and points per host and metric group."""
    per_series = df.groupBy(*SERIES).agg(F.count("*").alias("points"))
    return per_series.groupBy("host", "metricGroup").agg(
        F.count("*").alias("series"), F.sum("points").alias("points")
    )


def series_stats(df: DataFrame) -> DataFrame:
    """Points, range, mean and population deviation per series."""
    return df.groupBy(*SERIES).agg(
        F.count("value").alias("n"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("stddev"),
    )


def series_hourly(df: DataFrame) -> DataFrame:
    """Per host, metric group and hour of day."""
    hour = hour_of(from_epoch_ms("timestamp_ms")).alias("hour")
    return df.groupBy("host", "metricGroup", hour).agg(
        F.count("*").alias("count"),
        F.avg("value").alias("avg_value"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def host_comparison(df: DataFrame) -> DataFrame:
    """Per host and metric group: points, mean, sample deviation, median, p95 and p99."""
    keys = ["host", "metricGroup"]
    stats = df.groupBy(*keys).agg(
        F.count("*").alias("datapoints"), F.avg("value").alias("avg"), F.stddev_samp("value").alias("stddev")
    )
    ranked = quantiles(df, "value", [0.5, 0.95, 0.99], keys)
    wide = ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("p") == 0.95, F.col("value"))).alias("p95"),
        F.max(F.when(F.col("p") == 0.99, F.col("value"))).alias("p99"),
    )
    return join_on(stats, wide, keys, "left")


def top_metrics(df: DataFrame, n: int | None = 10) -> DataFrame:
    """Metrics with most points, or all of them."""
    counts = df.groupBy("metricGroup", "metricName").agg(F.count("*").alias("points"))
    counts = counts.orderBy(F.desc("points"), "metricGroup", "metricName")
    return counts if n is None else counts.limit(n)


def pick_series(df: DataFrame, patterns: list[str], n_processes: int | None = None, among: int | None = None) -> DataFrame:
    """Points of one metric: the first whose name holds an early pattern, else the largest.

    All metrics are looked at, or the ``among`` largest, and all processes are kept, or the first ``n_processes`` by
    name. One pass counts points per metric and process, a second one fetches the chosen points; one row, or at most
    ``n_processes``, is broadcast.
    """
    sizes = df.groupBy("metricGroup", "metricName", "process").agg(F.count("*").alias("points"))
    if n_processes is not None:
        sizes = stage_table(sizes, "metric-sizes")
    metrics = sizes.groupBy("metricGroup", "metricName").agg(F.sum("points").alias("points"))
    if among is not None:
        metrics = metrics.orderBy(F.desc("points"), "metricGroup", "metricName").limit(among)
    rank = F.lit(len(patterns))
    for i, pattern in reversed(list(enumerate(patterns))):
        rank = F.when(F.contains(F.col("metricName"), F.lit(pattern)), i).otherwise(rank)
    best = metrics.orderBy(rank, F.desc("points"), "metricGroup", "metricName").limit(1)
    metric = ["metricGroup", "metricName"]
    if n_processes is None:
        points = join_on(df, F.broadcast(best.select(*metric)), metric)
    else:
        shown = join_on(sizes, F.broadcast(best.select(*metric)), metric).orderBy("process").limit(n_processes)
        points = join_on(df, F.broadcast(shown.select(*metric, "process")), [*metric, "process"])
    return points.select(*SERIES, "timestamp_ms", "value").orderBy("timestamp_ms", "host", "process")


def with_zscore(df: DataFrame, keys: list[str] = METRIC) -> DataFrame:
    """Adds mean, sample deviation and ``z_score`` = |value - mean| / deviation (0 without deviation).

    The statistics are grouped first and joined back, so no metric has to fit into one task; being written, their
    size is known and Spark broadcasts them only while they are small.
    """
    stats = df.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("stddev"))
    z = F.when(F.col("stddev") > 0, F.abs(F.col("value") - F.col("mean")) / F.col("stddev")).otherwise(0.0)
    return join_on(df, stage_table(stats, "metric-stats"), keys).withColumn("z_score", z)


def anomalies(df: DataFrame, k: float = 3.0, n: int | None = 20) -> DataFrame:
    """Points more than ``k`` deviations from the mean, farthest first, with the number of all such points.

    The far points are written first, so list and number come from one pass.
    """
    far = stage_table(with_zscore(df).where(F.col("z_score") > k), "far-points")
    total = far.agg(F.count("*")).scalar()
    shown = far.select("host", "process", "metricGroup", "metricName", "timestamp_ms", "value", "mean", "z_score")
    shown = shown.orderBy(F.desc("z_score"), *SERIES, "timestamp_ms")
    return (shown if n is None else shown.limit(n)).withColumn("anomaly_count", total)


def last_value_per_series(df: DataFrame) -> DataFrame:
    """The newest point with a value of each series."""
    latest = F.max_by(F.struct("value", "timestamp_ms"), F.struct("timestamp_ms", "value"))
    found = df.where(F.col("value").isNotNull()).groupBy(*SERIES).agg(latest.alias("last"))
    return found.select(*SERIES, "last.timestamp_ms", "last.value")
