"""Reading and writing: scans, shards, serving tables, monthly tables, streams."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from .. import fixtures
from ..operators import rollups
from ..session import app_folder, new_path, on_disk
from ..sources import documents, serving, shards, tables, trips, workingset
from ..streaming import ingest, rollup
from .registry import query, sum_of
from .trip_queries import DAILY_SQL, HOURLY_SQL, ROUTE_ROLLUP_SQL, T

ISO = {c: f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ') AS {c}" for c in ("tpep_pickup_datetime", "tpep_dropoff_datetime")}
ALL = ", ".join(ISO.get(c, c) for c in fixtures.TRIPS)


@query("scan_trips", f"SELECT {ALL} FROM trips", T)
def scan_trips(spark, sf):
    path = f"{sf}/lineitem.parquet"
    return documents.to_documents(trips.read_trips(fixtures.prepare(spark), path).selectExpr(*fixtures.columns(fixtures.TRIPS)))


@query(
    "harmonise_union",
    """SELECT CAST(trip_order AS DOUBLE) AS trip_order, CAST(trip_line AS DOUBLE) AS trip_line, store_and_fwd_flag,
      CAST("PULocationID" AS DOUBLE) AS "PULocationID", total_amount, tip_amount AS airport_fee FROM trips""",
    T,
)
def harmonise_union(spark, sf):
    """Two halves of the trips, as two files with differing columns and spellings, brought together."""
    rows = fixtures.trips(spark, sf).withColumn("airport_fee", F.col("tip_amount"))
    shown = ["trip_order", "trip_line", "store_and_fwd_flag", "PULocationID", "total_amount", "airport_fee"]
    first = rows.where("payment_type <= 3").select(*shown, "VendorID")
    second = rows.where("payment_type > 3").select(*reversed(shown)).withColumnRenamed("airport_fee", "Airport_fee")
    return trips.union_months([first, second])


@query(
    "load_if_empty",
    "SELECT true AS first_load, false AS second_load, count(*) AS rows FROM trips",
    T,
)
def load_if_empty(spark, sf):
    target = new_path(spark, "loaded-trips")
    rows = fixtures.trips(spark, sf)
    first, second = tables.load_if_empty(rows, target), tables.load_if_empty(rows, target)
    return spark.read.parquet(target).agg(
        F.lit(first).alias("first_load"), F.lit(second).alias("second_load"), F.count("*").alias("rows")
    )


@query(
    "partitioned_roundtrip",
    """SELECT strftime(tpep_pickup_datetime, '%Y%m') AS month, trip_order, trip_line, total_amount FROM trips
    WHERE tpep_pickup_datetime BETWEEN TIMESTAMP '1996-03-10' AND TIMESTAMP '1997-02-20'""",
    T,
)
def partitioned_roundtrip(spark, sf):
    """Monthly table written whole, then read for a span of days."""
    path = new_path(spark, "monthly-trips")
    tables.write_trips(fixtures.trips(spark, sf), path)
    span = tables.read_months(spark, path, "1996-03-10", "1997-02-20")
    return span.select("month", "trip_order", "trip_line", "total_amount")


def _write_shards(spark, sf, root, file_format="json"):
    docs = fixtures.trips(spark, sf).select("trip_order", "tpep_pickup_datetime", "PULocationID", "total_amount")
    return shards.write_shards(docs, root, 16, F.col("trip_order"), file_format=file_format)


SHARD_SQL = """SELECT CAST(trip_order % 16 AS INTEGER) AS shard, trip_order, "PULocationID", total_amount FROM trips
    WHERE "PULocationID" = 7"""


def _read_shards(spark, sf, file_format):
    root = new_path(spark, "shards")
    _write_shards(spark, sf, root, file_format)
    schema = "trip_order bigint, PULocationID bigint, total_amount double"
    fields = ["shard", "trip_order", "PULocationID", "total_amount"]
    return shards.read_shards(spark, root, schema, F.col("PULocationID") == 7, fields, file_format=file_format)


@query("shard_read", SHARD_SQL, T)
def shard_read(spark, sf):
    return _read_shards(spark, sf, "json")


@query("shard_read_parquet", SHARD_SQL, T)
def shard_read_parquet(spark, sf):
    return _read_shards(spark, sf, "parquet")


@query("shard_write_stats", "SELECT CAST(trip_order % 16 AS INTEGER) AS shard, count(*) AS docs FROM trips GROUP BY 1", T)
def shard_write_stats(spark, sf):
    return _write_shards(spark, sf, new_path(spark, "shards")).select("shard", "docs")


def _write_valid(spark, sf, root):
    docs = fixtures.trips(spark, sf).select("trip_order", "trip_line", "fare_amount", "total_amount")
    return shards.write_shards(docs, root, 16, F.col("trip_order"), valid=F.col("fare_amount") > 0)


@query(
    "shard_write_rejects",
    """SELECT CAST(CASE WHEN fare_amount > 0 THEN trip_order % 16 END AS INTEGER) AS shard, count(*) AS docs FROM trips GROUP BY 1""",
    T,
)
def shard_write_rejects(spark, sf):
    """Documents per shard, and those without a fare that were rejected."""
    return _write_valid(spark, sf, new_path(spark, "shards"))


@query(
    "shard_rejected",
    "SELECT trip_order, CAST(trip_line AS BIGINT) AS trip_line, fare_amount, total_amount FROM trips WHERE NOT fare_amount > 0",
    T,
)
def shard_rejected(spark, sf):
    root = new_path(spark, "shards")
    _write_valid(spark, sf, root)
    return shards.read_rejected(spark, root, "trip_order bigint, trip_line bigint, fare_amount double, total_amount double")


@query(
    "import_stats",
    """s AS (SELECT trip_order % 16 AS shard, count(*) AS docs FROM trips GROUP BY 1)
    SELECT 'node' || (shard % 4 + 1) AS node, count(*) AS shards, CAST(sum(docs) AS BIGINT) AS docs,
      string_agg('shard' || shard, ', ' ORDER BY 'shard' || shard) AS targets FROM s GROUP BY 1""",
    T,
)
def import_stats(spark, sf):
    written = _write_shards(spark, sf, new_path(spark, "shards"))
    return shards.import_stats(written, ["node1", "node2", "node3", "node4"])


@query("publish_hourly", HOURLY_SQL, T)
def publish_hourly(spark, sf):
    return serving.publish(rollups.rollup_hourly(fixtures.trips(spark, sf)), new_path(spark, "serving-hourly"))


def _published(spark, sf, name, rollup_of):
    """A serving table of this application, built by the first query that needs it and again when the trips change."""
    files, path = on_disk(spark, f"{sf}/lineitem.parquet")
    state = files.getFileStatus(path)
    state = hashlib.md5(f"{sf} {state.getModificationTime()} {state.getLen()}".encode()).hexdigest()
    return serving.publish_once(spark, f"{app_folder(spark)}/serving-{name}-{state}", lambda: rollup_of(fixtures.trips(spark, sf)))


@query("serving_readback", f"SELECT pickup_date, trip_count * 1.0::DOUBLE AS trip_count, day_name FROM ({DAILY_SQL})", T)
def serving_readback(spark, sf):
    daily = _published(spark, sf, "daily", rollups.rollup_daily)
    return serving.displayed(daily, ["pickup_date"], ["trip_count"]).select("pickup_date", "trip_count", "day_name")


@query("serving_day", f"SELECT * FROM ({HOURLY_SQL}) WHERE pickup_date = '1997-01-15'", T)
def serving_day(spark, sf):
    return serving.serving_day(_published(spark, sf, "hourly", rollups.rollup_hourly), "1997-01-15")


@query(
    "serving_newest_day",
    f"h AS ({HOURLY_SQL}) SELECT * FROM h WHERE pickup_date = (SELECT max(pickup_date) FROM h)",
    T,
)
def serving_newest_day(spark, sf):
    return serving.serving_day(_published(spark, sf, "hourly", rollups.rollup_hourly))


@query("serving_top_routes", f"SELECT * FROM ({ROUTE_ROLLUP_SQL.format(least=10)}) ORDER BY total_revenue DESC, id LIMIT 10", T)
def serving_top_routes(spark, sf):
    return serving.serving_top_routes(_published(spark, sf, "routes", rollups.rollup_routes))


@query("serving_last_days", f"SELECT * FROM ({DAILY_SQL}) ORDER BY pickup_date DESC LIMIT 10", T)
def serving_last_days(spark, sf):
    return serving.serving_last_days(_published(spark, sf, "daily", rollups.rollup_daily))


@query("serving_dow", f"SELECT day_name, count(*) AS days FROM ({DAILY_SQL}) GROUP BY 1", T)
def serving_dow(spark, sf):
    return serving.serving_dow(_published(spark, sf, "daily", rollups.rollup_daily))


@query(
    "unwrap_docs",
    """SELECT trip_order, trip_line, "PULocationID", CASE WHEN passenger_count IS NULL THEN NULL
      ELSE passenger_count END AS passengers FROM trips""",
    T,
)
def unwrap_docs(spark, sf):
    wrapped = fixtures.trips(spark, sf).select(
        "trip_order",
        F.array("trip_line").alias("trip_line"),
        F.array("PULocationID").alias("PULocationID"),
        F.when(F.col("passenger_count").isNull(), F.array().cast("array<double>"))
        .otherwise(F.array("passenger_count"))
        .alias("passengers"),
    )
    return documents.unwrap(wrapped)


@query(
    "working_set_info",
    "SELECT count(*) AS rows, true AS use_memory, true AS use_disk, true AS loaded FROM trips",
    T,
)
def working_set_info(spark, sf):
    held = workingset.WorkingSet(lambda: fixtures.trips(spark, sf))
    info = held.info_frame()
    held.invalidate()
    return info


_TYPES = {
    **dict.fromkeys(fixtures.TRIPS, "bigint"),
    **dict.fromkeys(("trip_line", "VendorID"), "int"),
    **dict.fromkeys(("tpep_pickup_datetime", "tpep_dropoff_datetime"), "timestamp_ntz"),
    **dict.fromkeys(("passenger_count", "trip_distance", "fare_amount", "tip_amount", "total_amount"), "double"),
    "store_and_fwd_flag": "string",
}
_HEAD = ["tpep_pickup_datetime", *[c for c in fixtures.TRIPS if c != "tpep_pickup_datetime"]]


@query(
    "describe_schema",
    f"""head AS (SELECT * FROM trips ORDER BY {', '.join(f'{c} NULLS FIRST' for c in _HEAD)} LIMIT 5) """
    + " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", '{_TYPES[c]}' AS type, CAST({c} AS VARCHAR) AS value FROM head"""
        for i, c in enumerate(fixtures.TRIPS, 1)
    ),
    T,
)
def describe_schema(spark, sf):
    return tables.describe_table(fixtures.trips(spark, sf), _HEAD)


@query("dataset_profile")
def dataset_profile(spark, sf):
    return tables.dataset_profile(fixtures.table(spark, sf, "lineitem"))


def _trip_stream(spark, sf):
    """The trip files as a stream; the pattern matches one file as well as a folder of files."""
    schema = fixtures.table(spark, sf, "lineitem").schema
    return ingest.file_stream(spark, f"{sf}/lineitem.parquet*", schema).selectExpr(*fixtures.columns(fixtures.TRIPS))


def _arrive(spark, sf, folder, arrival, of=4):
    """One of ``of`` parts of the trips arrives in a folder, in as many files as tasks read them; no row is moved."""
    part = F.pmod(F.xxhash64("trip_order", "trip_line"), F.lit(of)) == arrival
    fixtures.trips(spark, sf).where(part).write.mode("append").parquet(folder)


@query(
    "stream_hourly_rollup",
    f"""SELECT strftime(date_trunc('hour', tpep_pickup_datetime), '%Y-%m-%d %H:%M') AS hour, "PULocationID",
      count(*) AS trips, {sum_of('total_amount')} AS revenue, {sum_of('trip_distance')} AS distance
    FROM trips GROUP BY ALL""",
    T,
)
def stream_hourly_rollup(spark, sf):
    """Four batches; parts are combined when a level is full and once more by a call, and one batch runs twice."""
    out, checkpoint, folder = (new_path(spark, name) for name in ("rollup", "rollup-checkpoint", "arriving"))

    def run():
        stream = ingest.file_stream(spark, folder, fixtures.trips(spark, sf).schema)
        rollup.start_hourly_rollup(stream, out, checkpoint, fan_in=3).awaitTermination()

    for arrival in range(4):
        _arrive(spark, sf, folder, arrival)
        run()
    rollup.compact_rollup(spark, out)
    files, last = on_disk(spark, f"{checkpoint}/commits/3")
    files.delete(last, False)  # as if the last commit had been lost
    run()
    rollup.compact_rollup(spark, out)
    return rollup.read_rollup(spark, out).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm"))


@query(
    "stream_first_hours",
    f"""SELECT strftime(date_trunc('hour', tpep_pickup_datetime), '%Y-%m-%d %H:%M') AS hour, count(*) AS total_trips,
      {sum_of('total_amount')} AS total_revenue FROM trips GROUP BY 1 ORDER BY 1 LIMIT 24""",
    T,
)
def stream_first_hours(spark, sf):
    out = new_path(spark, "rollup")
    rollup.start_hourly_rollup(_trip_stream(spark, sf), out, new_path(spark, "rollup-checkpoint")).awaitTermination()
    return rollup.first_hours(spark, out).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH:mm"))


@query(
    "stream_ingest",
    "SELECT strftime(tpep_pickup_datetime, '%Y%m') AS month, trip_order, trip_line, total_amount FROM trips",
    T,
)
def stream_ingest(spark, sf):
    target = new_path(spark, "ingested-trips")
    ingest.ingest_stream(_trip_stream(spark, sf), target, new_path(spark, "ingest-checkpoint")).awaitTermination()
    return tables.read_months(spark, target).select("month", "trip_order", "trip_line", "total_amount")
