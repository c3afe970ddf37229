"""Seven queries that show how fast a trip table answers."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from .facets import facet
from .filters import time_range
from .rollups import PICKUP, by_month
from .stats import grouped


SPAN = ("2023-01-09", "2023-01-16")


def count(trips: DataFrame, span: tuple[str, str] = SPAN) -> DataFrame:
    return trips.agg(F.count("*").alias("trips"))


def sum_avg(trips: DataFrame, span: tuple[str, str] = SPAN) -> DataFrame:
    means = {"avg_distance": "trip_distance", "avg_tip": "tip_amount"}
    return grouped(trips, [], "trips", {"revenue": "total_amount"}, means).drop("trips")


def weekday(trips: DataFrame, span: tuple[str, str] = SPAN) -> DataFrame:
    day = {"weekday": times.weekday(PICKUP)}
    return grouped(trips, day, "trips", avgs={"avg_amount": "total_amount"}).orderBy("weekday")


def hour(trips: DataFrame, span: tuple[str, str] = SPAN) -> DataFrame:
    return grouped(trips, {"hour": times.hour_of(PICKUP)}, "trips", {"revenue": "total_amount"}).orderBy("hour")


def top_locations(trips: DataFrame, span: tuple[str, str] = SPAN) -> DataFrame:
    return facet(trips, "PULocationID", limit=10)


def week(trips: DataFrame, span: tuple[str, str] = SPAN) -> DataFrame:
    return grouped(trips.where(time_range(PICKUP, *span)), [], "trips", avgs={"avg_amount": "total_amount"})


def month(trips: DataFrame, span: tuple[str, str] = SPAN) -> DataFrame:
    return by_month(trips)


SUITE = {q.__name__: q for q in (count, sum_avg, weekday, hour, top_locations, week, month)}


def bench_suite(trips: DataFrame, span: tuple[str, str] = SPAN) -> DataFrame:
    """Runs the seven queries: (query, seconds, rows_per_second)."""
    rows = trips.count()
    measured = []
    for name, query in SUITE.items():
        began = time.perf_counter()
        query(trips, span).write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - began
        measured.append((name, seconds, rows / seconds))
    return trips.sparkSession.createDataFrame(measured, "query string, seconds double, rows_per_second double")
