"""Session settings, the shared working folder, and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}
_folders: set[str] = set()


def build_session(app: str = "drillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; anything else stays with the cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **({"spark.ui.enabled": "false"} if (master or "").startswith("local") else {}),
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone, so wall-clock timestamps and epoch values agree on every cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, else the checkpoint folder already set.

    A temporary folder is used only in local mode, where driver and executors are one machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="drillspark-")
    return _local_roots[app]


def on_disk(spark: SparkSession, folder: str):
    """The file system of a path, and the path, for the few calls that are not about rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def app_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it goes away when the driver ends."""
    folder = f"{shared_root(spark).rstrip('/')}/drillspark/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        files, path = on_disk(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders.add(folder)
    return folder


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder; every call gives another one."""
    return f"{app_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Lost executors do not recompute what led to it, and Spark then knows its true size, so the choice between a
    broadcast and a shuffled join rests on that size and ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove everything this application wrote below the shared folder, before the driver ends."""
    folder = app_folder(spark)
    files, path = on_disk(spark, folder)
    files.delete(path, True)
    _folders.discard(folder)
