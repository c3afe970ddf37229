"""A set of rows loaded once and queried many times."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class WorkingSet:
    """Keeps a frame in executor memory, on disk where memory ends; lost blocks are computed again by Spark."""

    def __init__(self, load: Callable[[], DataFrame]):
        self._load = load
        self._df: DataFrame | None = None
        self._info: dict = {}

    def get(self) -> DataFrame:
        """The cached rows; the first call loads and counts them."""
        if not self.valid():
            started = time.monotonic()
            self._df = self._load().persist(StorageLevel.MEMORY_AND_DISK)
            rows = self._df.count()
            self._info = {"rows": rows, "load_seconds": time.monotonic() - started}
        return self._df

    def valid(self) -> bool:
        return self._df is not None and self._df.is_cached

    def info(self) -> dict:
        """Rows, seconds of the load, and whether the set is loaded."""
        return {"loaded": self.valid(), **self._info}

    def info_frame(self) -> DataFrame:
        """The same as one row: (rows, use_memory, use_disk, loaded)."""
        df = self.get()
        level = df.storageLevel
        row = (self._info["rows"], level.useMemory, level.useDisk, self.valid())
        return df.sparkSession.createDataFrame([row], "rows bigint, use_memory boolean, use_disk boolean, loaded boolean")

    def invalidate(self) -> None:
        if self._df is not None:
            self._df.unpersist()
        self._df, self._info = None, {}
