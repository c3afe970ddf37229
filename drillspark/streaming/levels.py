"""A table of partial rows that stays compact while a stream adds to it.

Each batch adds one *part*. As soon as ``fan_in`` parts of one level have gathered, they are combined into one part of the
next level, so the table never has more than ``fan_in`` parts a level, a row is rewritten once a level, and the number
of levels grows with the logarithm of the batches. A *manifest* lists the parts that count; a new one takes the old one's
place by a single rename, after its data are complete. Readers see the table before or after a change, never in between;
replaced parts stay for ``keep`` more manifests, for readers that have just started.

One writer at a time: the checkpoint of a stream already sees to that, and a second one is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import on_disk


@dataclass(frozen=True)
class Part:
    """Rows of the batches ``first`` to ``last``."""

    first: int
    last: int
    level: int
    folder: str


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    parts: tuple[Part, ...] = ()
    #: Folders that no longer count, with the version that left them out.
    replaced: tuple[tuple[int, str], ...] = ()


class LeveledTable:
    def __init__(
        self, spark: SparkSession, root: str, schema: str, combine: Callable[[DataFrame], DataFrame], fan_in: int = 8, keep: int = 3
    ):
        """``combine`` turns rows of several parts into fewer rows that mean the same; both have ``schema``."""
        if fan_in < 2 or keep < 1:
            raise ValueError("at least two parts are combined, and one manifest kept")
        self.spark, self.root, self.schema, self.combine = spark, root.rstrip("/"), schema, combine
        self.fan_in, self.keep = fan_in, keep

    def manifest(self) -> Manifest:
        """The newest manifest; an empty one if nothing was added yet."""
        files, folder = on_disk(self.spark, f"{self.root}/manifest")
        if not files.exists(folder):
            return Manifest()
        names = [s.getPath().getName() for s in files.listStatus(folder)]
        newest = max((n for n in names if n.endswith(".json") and n[0] not in "._"), default=None)
        if newest is None:
            return Manifest()
        _, path = on_disk(self.spark, f"{self.root}/manifest/{newest}")
        stream = files.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return Manifest(int(newest[:-5]), tuple(Part(**p) for p in held["parts"]), tuple(map(tuple, held["replaced"])))

    def _commit(self, before: Manifest, parts: list[Part]) -> None:
        version = before.version + 1
        gone = [(version, p.folder) for p in before.parts if p not in parts]
        replaced = [*before.replaced, *gone]
        old = [folder for at, folder in replaced if at <= version - self.keep]
        held = {"parts": [asdict(p) for p in sorted(parts, key=lambda p: p.first)], "replaced": [r for r in replaced if r[1] not in old]}
        files, target = on_disk(self.spark, f"{self.root}/manifest/{version:012d}.json")
        _, draft = on_disk(self.spark, f"{self.root}/manifest/.{uuid.uuid4().hex}")
        if files.exists(target):
            raise RuntimeError(f"another writer changes {self.root}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        if not files.rename(draft, target):
            raise RuntimeError(f"another writer changes {self.root}")
        # what nothing refers to any more
        for folder in old:
            files.delete(on_disk(self.spark, f"{self.root}/{folder}")[1], True)
        files.delete(on_disk(self.spark, f"{self.root}/manifest/{version - self.keep:012d}.json")[1], False)

    def read(self) -> DataFrame:
        """All rows that count, as they are stored; ``combine`` them for one row a key."""
        return self._rows(self.manifest().parts)

    def _rows(self, parts) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{p.folder}" for p in parts])

    def add(self, rows: DataFrame, batch: int) -> bool:
        """Add the rows of a batch, and combine what has gathered; false if that batch is in the table already.

        Batches come in order. One that failed half-way is written again whole: its rows count only with its manifest.
        """
        now = self.manifest()
        fresh = batch > max((p.last for p in now.parts), default=-1)
        if fresh:
            folder = f"parts/{batch}-{uuid.uuid4().hex[:12]}"
            rows.write.parquet(f"{self.root}/{folder}")
            self._commit(now, [*now.parts, Part(batch, batch, 0, folder)])
        self.merge()
        return fresh

    def merge(self, everything: bool = False) -> int:
        """Combine levels that are full, or all parts into one; returns how many parts are left.

        May run in the middle of a stream, between two batches.
        """
        while True:
            now = self.manifest()
            if everything:
                chosen = list(now.parts) if len(now.parts) > 1 else []
            else:
                levels = sorted({p.level for p in now.parts})
                chosen = next((c for level in levels if len(c := [p for p in now.parts if p.level == level]) >= self.fan_in), [])
            if not chosen:
                return len(now.parts)
            first, last, level = min(p.first for p in chosen), max(p.last for p in chosen), max(p.level for p in chosen) + 1
            folder = f"parts/{first}-{last}-{uuid.uuid4().hex[:12]}"
            self.combine(self._rows(chosen)).write.parquet(f"{self.root}/{folder}")
            self._commit(now, [*(p for p in now.parts if p not in chosen), Part(first, last, level, folder)])

    def sweep(self) -> int:
        """Delete folders that failed writes left behind; not while a batch is being added. Returns their number."""
        now = self.manifest()
        known = {p.folder for p in now.parts} | {folder for _, folder in now.replaced}
        files, folder = on_disk(self.spark, f"{self.root}/parts")
        if not files.exists(folder):
            return 0
        lost = [s.getPath() for s in files.listStatus(folder) if f"parts/{s.getPath().getName()}" not in known]
        for path in lost:
            files.delete(path, True)
        return len(lost)
