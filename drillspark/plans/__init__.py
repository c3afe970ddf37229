"""Named queries over the driver tables, each with the SQL that checks it."""

from . import event_queries, metric_queries, table_queries, trip_queries  # noqa: F401
from .registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
