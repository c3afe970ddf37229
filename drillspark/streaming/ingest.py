"""Continuous load of new trip files into the monthly table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import with_partitions


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive below ``path``, a folder or a pattern."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def ingest_stream(
    stream: DataFrame, table: str, checkpoint: str, pickup: str = "tpep_pickup_datetime", once: bool = True
) -> StreamingQuery:
    """Append every new row to the table at ``table``, one folder per month; each file is loaded exactly once.

    A batch is dealt by month before it is written, large months over several tasks, so that a batch adds few files to a
    month, and each is sorted by pickup time. The folder of a batch in a month is replaced if the batch runs again.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        placed = with_partitions(batch, pickup).withColumn("_batch", F.lit(batch_id)).hint("rebalance", F.col("month"))
        writer = placed.sortWithinPartitions("month", pickup).write.mode("overwrite").partitionBy("month", "_batch")
        writer.option("partitionOverwriteMode", "dynamic").parquet(table)

    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
