"""Documents spread over numbered shards, one folder each: JSON lines, or Parquet where filters shall reach the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .documents import to_documents


def write_shards(
    df: DataFrame,
    root: str,
    n_shards: int,
    shard_by: Column,
    max_docs: int = 1_000_000,
    file_format: str = "json",
    valid: Column | None = None,
) -> DataFrame:
    """Write rows to shard ``shard_by mod n_shards`` and report what was written: (shard, docs), empty shards too.

    Rows that are not ``valid``, or have no shard key, are rejected: they are written beside the shards, in the same pass,
    and counted in a further row without shard number if there are any. ``read_rejected`` gives them back.

    Adaptive execution splits large shards over several tasks, so no shard is one task's work. The documents are
    counted while they are written, after the shuffle, so that no second pass is needed.
    """
    shard = F.pmod(shard_by, F.lit(n_shards)).cast("int")
    docs = to_documents(df.withColumn("shard", shard if valid is None else F.when(valid, shard)))
    written = Observation("written")
    counts = [F.count_if(F.col("shard") == i).alias(f"shard{i}") for i in range(n_shards)]
    counted = docs.hint("rebalance", F.col("shard")).observe(written, *counts, F.count_if(F.col("shard").isNull()).alias("rejected"))
    writer = counted.write.mode("overwrite").option("maxRecordsPerFile", max_docs)
    writer.partitionBy("shard").format(file_format).save(root)
    rows = [(i, written.get[f"shard{i}"]) for i in range(n_shards)]
    rows += [(None, written.get["rejected"])] if written.get["rejected"] else []
    return df.sparkSession.createDataFrame(rows, "shard int, docs bigint")


def shard_stats(spark: SparkSession, root: str, file_format: str = "json") -> DataFrame:
    """(shard, files, docs) counted from the files themselves; no field is parsed."""
    reader = spark.read.schema("shard int") if file_format == "parquet" else spark.read.schema("value string, shard int")
    docs = reader.format("text" if file_format == "json" else file_format).load(root)
    per_file = docs.where(F.col("shard").isNotNull()).groupBy("shard", F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("docs"))
    return per_file.groupBy("shard").agg(F.count("*").alias("files"), F.sum("docs").alias("docs"))


def import_stats(stats: DataFrame, nodes: list[str]) -> DataFrame:
    """Per node: shards, documents and the shard names; shard i lies on node ``i mod len(nodes)``.

    Rejected rows lie on no node.
    """
    stats = stats.where(F.col("shard").isNotNull())
    node = F.element_at(F.array(*[F.lit(n) for n in nodes]), F.pmod(F.col("shard"), F.lit(len(nodes))) + 1)
    shard = F.concat(F.lit("shard"), F.col("shard").cast("string"))
    return stats.groupBy(node.alias("node")).agg(
        F.count("*").alias("shards"),
        F.sum("docs").alias("docs"),
        F.array_join(F.array_sort(F.collect_set(shard)), ", ").alias("targets"),
    )


def read_shards(
    spark: SparkSession,
    root: str,
    schema: str | T.StructType,
    where: Column | None = None,
    fields: list[str] | None = None,
    shards: list[int] | None = None,
    file_format: str = "json",
) -> DataFrame:
    """Documents of all shards (or some), filtered and projected; a frame without rows if none match.

    Every shard is split over tasks; nothing passes through the driver. Shard numbers prune folders, the schema
    leaves all other fields unparsed, and Parquet shards skip what the filter rules out.
    """
    df = spark.read.schema(_with_shard(schema)).format(file_format).load(root).where(F.col("shard").isNotNull())
    if shards is not None:
        df = df.where(F.col("shard").isin(shards))
    if where is not None:
        df = df.where(where)
    return df if fields is None else df.select(*fields)


def read_rejected(spark: SparkSession, root: str, schema: str | T.StructType, file_format: str = "json") -> DataFrame:
    """The rows that ``write_shards`` has rejected; other folders are not read."""
    df = spark.read.schema(_with_shard(schema)).format(file_format).load(root)
    return df.where(F.col("shard").isNull()).drop("shard")


def _with_shard(schema: str | T.StructType) -> T.StructType:
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return T.StructType([f for f in fields.fields if f.name != "shard"] + [T.StructField("shard", T.IntegerType())])
