"""Mapping of labelled metrics into six fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import host_of, label, label_suffix, name_parts, name_prefixes, quantile_suffix, strip_job
from ..session import stage_table
from .vectors import drop_info

THRESHOLD = 100
HOST_GROUP = "cluster"
COLUMNS = ["ProcessGroup", "Process", "HostGroup", "Host", "MetricGroup", "Metric"]


def _names(series: DataFrame) -> DataFrame:
    """Series per job and metric name (without job prefix); ``*_info`` metrics do not count."""
    job, name = label("labels", "job"), label("labels", "__name__")
    rows = drop_info(series).select(job.alias("job"), strip_job(name, job).alias("name"))
    return rows.groupBy("job", "name").agg(F.count("*").alias("n"))


def _prefix_counts(names: DataFrame) -> DataFrame:
    exploded = names.select("job", F.explode(name_prefixes("name")).alias("prefix"), "n")
    return exploded.groupBy("job", "prefix").agg(F.sum("n").alias("n"))


def prefix_counts(series: DataFrame) -> DataFrame:
    """Series per job and name prefix of every length: (job, prefix, n)."""
    return _prefix_counts(_names(series))


def hot_prefixes(counts: DataFrame, threshold: int = THRESHOLD, n: int | None = 15) -> DataFrame:
    """Prefixes shared by more than ``threshold`` series, largest first."""
    hot = counts.where(F.col("n") > threshold).orderBy(F.desc("n"), "job", "prefix")
    return hot if n is None else hot.limit(n)


def split_metric(series: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(job, name, split, group_ext, metric): how many leading parts of each name move into the metric group.

    A longer prefix never has more series than a shorter one. The group therefore ends at the longest prefix, short of
    the whole name, that more than ``threshold`` series share. It is found once per distinct (job, name).
    """
    names = stage_table(_names(series), "metric-names")
    hot = _prefix_counts(names).where(F.col("n") > threshold).select("job", "prefix")
    cut = names.select("job", "name", F.posexplode(name_prefixes("name")).alias("i", "prefix"))
    cut = cut.where(F.col("i") + 1 < F.size(name_parts("name")))
    found = cut.join(hot, ["job", "prefix"]).groupBy("job", "name").agg(F.max(F.col("i") + 1).alias("split"))
    parts = name_parts("name")
    split = F.coalesce("split", F.lit(0))
    return names.join(found, ["job", "name"], "left").select(
        "job",
        "name",
        split.alias("split"),
        F.array_join(F.slice(parts, F.lit(1), split), "_").alias("group_ext"),
        F.array_join(F.slice(parts, split + 1, F.size(parts)), "_").alias("metric"),
    )


def to_dimensional(series: DataFrame, threshold: int = THRESHOLD, distinct: bool = True) -> DataFrame:
    """The six dimensions of every series, each combination once (or one row per series)."""
    job, name = label("labels", "job"), label("labels", "__name__")
    rows = drop_info(series).select(
        job.alias("job"),
        strip_job(name, job).alias("name"),
        label("labels", "instance").alias("Process"),
        label_suffix("labels").alias("suffix"),
        quantile_suffix(F.element_at("labels", F.lit("quantile"))).alias("quantile"),
    )
    if distinct:
        rows = rows.distinct()
    splits = split_metric(series, threshold).drop("split")
    ext, has_job = F.col("group_ext"), F.col("job") != ""
    group = (
        F.when((ext != "") & has_job, F.concat("job", F.lit("_"), ext))
        .when(ext != "", ext)
        .when(has_job, F.col("job"))
        .otherwise(F.substring_index("name", "_", 1))
    )
    suffix = F.when(F.col("suffix") != "", F.concat(F.lit("_"), "suffix")).otherwise("")
    mapped = rows.join(splits, ["job", "name"]).select(
        F.col("job").alias("ProcessGroup"),
        "Process",
        F.lit(HOST_GROUP).alias("HostGroup"),
        host_of("Process").alias("Host"),
        group.alias("MetricGroup"),
        F.concat("metric", suffix, "quantile").alias("Metric"),
    )
    return mapped.distinct() if distinct else mapped


def group_sizes(dimensional: DataFrame) -> DataFrame:
    """Metrics per metric group, largest first."""
    sizes = dimensional.groupBy("MetricGroup").agg(F.count("*").alias("metrics"))
    return sizes.orderBy(F.desc("metrics"), "MetricGroup")
