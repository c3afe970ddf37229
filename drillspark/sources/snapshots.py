"""Snapshots of labelled series and CSV files of mapped metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SERIES_SCHEMA = "status string, data array<map<string,string>>"
METADATA_SCHEMA = "status string, data map<string,array<struct<type:string,help:string>>>"


def read_series(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Label maps from answers ``{"status": "success", "data": [{label: value}, ..]}``; failed answers are left out.

    One answer per line (large files are split over tasks), or with ``lines=False`` one answer per file.
    """
    answers = spark.read.schema(SERIES_SCHEMA).option("multiLine", not lines).json(path)
    return answers.where("status = 'success'").select(F.explode("data").alias("labels"))


def read_metadata(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """The column ``metadata``, a map from metric name to entries ``[{type, help}]``."""
    answers = spark.read.schema(METADATA_SCHEMA).option("multiLine", not lines).json(path)
    return answers.where("status = 'success'").select(F.col("data").alias("metadata"))


def write_series(series: DataFrame, path: str) -> None:
    """Label maps as answers, one per line."""
    answer = F.to_json(F.struct(F.lit("success").alias("status"), F.array("labels").alias("data")))
    series.select(answer.alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[Column | str]) -> None:
    """CSV files with header, in the given column and row order; the files' names follow the row order."""
    ordered = df.select(*columns).orderBy(*order)
    ordered.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    found = spark.read.schema(schema).option("header", True).option("escape", '"').option("comment", "#").csv(path)
    return found.fillna("")


def write_described_csv(df: DataFrame, path: str, columns: list[str], descriptions: list[str], order: list, limit: int) -> None:
    """One CSV file led by a ``#`` line with descriptions, for small results only: more than ``limit`` rows fail."""
    rows = df.select(*columns).orderBy(*order).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows: write_csv writes results of any size")

    def cell(value) -> str:
        text = "" if value is None else str(value)
        return '"' + text.replace('"', '""') + '"' if any(ch in text for ch in ',"\n') else text

    lines = ["# " + ",".join(descriptions), ",".join(columns)] + [",".join(cell(v) for v in row) for row in rows]
    spark = df.sparkSession
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
