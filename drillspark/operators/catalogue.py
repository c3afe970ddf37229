"""Catalogue of the labels that occur on each metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table

COLUMNS = ["metric_name", "_type", "job", "instance", "label", "count", "values"]
# What each column of the catalogue holds, for the comment line of its file.
DESCRIPTIONS = ["__name__", "metadata.type", "label:job", "label:instance", "label:*", "(aggregiert)", "(aggregiert)"]


NAME = "__name__"


def _label_values(series: DataFrame) -> DataFrame:
    """(metric_name, label, value), each once; the name itself is a label too, so every metric has a row."""
    name = F.coalesce(F.element_at("labels", F.lit(NAME)), F.lit("unknown"))
    entries = F.concat(F.map_entries("labels"), F.array(F.struct(F.lit(NAME).alias("key"), name.alias("value"))))
    pairs = series.select(name.alias("metric_name"), F.explode(entries).alias("e"))
    return pairs.select("metric_name", F.col("e.key").alias("label"), F.col("e.value").alias("value")).distinct()


def _formatted(values: DataFrame) -> DataFrame:
    """(metric_name, label, count, values): the number of values and the first two of them as text."""
    in_order = Window.partitionBy("metric_name", "label").orderBy("value")
    first_two = values.withColumn("position", F.row_number().over(in_order)).where("position <= 2")
    shown = first_two.groupBy("metric_name", "label").agg(
        F.max(F.when(F.col("position") == 1, F.col("value"))).alias("first"),
        F.max(F.when(F.col("position") == 2, F.col("value"))).alias("second"),
    )
    counts = values.groupBy("metric_name", "label").agg(F.count("*").alias("count"))
    text = F.concat_ws(", ", "first", "second", F.when(F.col("count") > 2, F.lit("...")))
    return counts.join(shown, ["metric_name", "label"]).select("metric_name", "label", "count", text.alias("values"))


def first_types(metadata: DataFrame) -> DataFrame:
    """(metric_name, type) from a map of metric name to entries ``[{type, help}]``: the first entry of each."""
    return metadata.select(F.explode("metadata").alias("metric_name", "entries")).select(
        "metric_name", F.try_element_at("entries", F.lit(1))["type"].alias("type")
    )


def label_catalogue(series: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per metric and label beside job and instance; a metric without other labels gets one blank row.

    ``metadata`` is (metric_name, type); metrics without a type show ``n/a``.
    """
    found = stage_table(_label_values(series), "label-values")
    names = found.where(F.col("label") == NAME).select("metric_name").distinct()
    values = _formatted(found.where(F.col("label") != NAME))
    standard = values.where(F.col("label").isin("job", "instance"))
    own = standard.groupBy("metric_name").agg(
        F.max(F.when(F.col("label") == "job", F.col("values"))).alias("job"),
        F.max(F.when(F.col("label") == "instance", F.col("values"))).alias("instance"),
    )
    others = values.where(~F.col("label").isin("job", "instance"))
    return (
        names.join(own, "metric_name", "left")
        .join(others, "metric_name", "left")
        .join(metadata.select("metric_name", F.col("type").alias("_type")), "metric_name", "left")
        .select(
            "metric_name",
            F.when(F.coalesce("_type", F.lit("")) == "", "n/a").otherwise(F.col("_type")).alias("_type"),
            F.coalesce("job", F.lit("")).alias("job"),
            F.coalesce("instance", F.lit("")).alias("instance"),
            F.coalesce("label", F.lit("")).alias("label"),
            F.coalesce(F.col("count").cast("string"), F.lit("")).alias("count"),
            F.coalesce("values", F.lit("")).alias("values"),
        )
    )
