"""Names of queries, the functions behind them and the SQL of their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixtures

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

_SOURCES = {"trips": "lineitem", "monitoring": "events", "samples": "events", "counters": "events", "prom": "part"}
_COLUMNS = {
    "trips": fixtures.TRIPS,
    "monitoring": fixtures.MONITORING,
    "samples": {**fixtures.SAMPLES, "timestamp_ms": "epoch_us(ts)//1000"},
    "counters": fixtures.COUNTERS,
    "prom": fixtures.PROM_SERIES,
}
_ZONES = (
    "SELECT n_nationkey + 1 AS zone_id, n_name AS name, r_name AS borough, substr(r_name, 1, 2) AS short "
    "FROM nation JOIN region ON n_regionkey = r_regionkey"
)


def _view(name: str) -> str:
    if name == "zones":
        return f"zones AS ({_ZONES})"
    return f"{name} AS (SELECT {', '.join(fixtures.columns(_COLUMNS[name]))} FROM {_SOURCES[name]})"


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a query; ``sql`` may use the named views and starts with SELECT, or with further ``name AS (..)`` parts."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            parts = ", ".join(_view(v) for v in views)
            body = sql.strip()
            if not parts:
                CHECKS[name] = body if body.upper().startswith("SELECT") else f"WITH {body}"
            else:
                CHECKS[name] = f"WITH {parts}" + (" " if body.upper().startswith("SELECT") else ", ") + body
        return function

    return add


def sum_of(expression: str) -> str:
    """SQL of the exact sum: whole millionths, added as integers."""
    return f"(CAST(sum(CAST(round_even(CAST({expression} AS DOUBLE) * 1000000, 0) AS BIGINT)) AS DOUBLE) / 1000000)"


def avg_of(expression: str) -> str:
    return f"({sum_of(expression)} / count({expression}))"
