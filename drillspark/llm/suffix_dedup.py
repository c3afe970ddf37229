"""Removal of long passages that occur more than once, by suffix arrays of the places where repeats can be.

A passage of ``length`` bytes is known by its *anchor*, the smallest code among its runs of ``gram`` bytes. Starts with the
same anchor that follow one another make a *piece*: the bytes of all passages that start there. Equal passages have equal
anchors, so repeats are found among pieces of one anchor, and an anchor with a single piece needs no more work. Pieces
that are wholly alike form a class, which is counted before anything is shuffled by anchor; all passages of a class with
several members repeat. What is left, one piece of each class where an anchor has several classes, is sorted: of all
suffixes only those smaller than their successors are sorted directly, the others are induced by scans over the buckets
of first bytes, and common prefixes of neighbours tell which passages repeat.

Texts travel only for pieces that must be sorted. An anchor with more than ``sorted_bytes`` in its pieces is never brought
into one task: its passages are counted by 128-bit codes instead, which combine before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .frames import for_long_texts, ship, small_batches

ship(__name__)

#: Starts of a text handled at once, and bytes of pieces sorted at once (an anchor's pieces stay together).
SLICE, TOGETHER = 1 << 20, 1 << 20
#: A written table is broadcast if it has at most so many rows and items of lists together, of some 40 bytes each; Spark
#: joins larger ones by its own choice.
SMALL = 1_000_000
#: Ends each piece in an array to sort; UTF-8 has no such byte.
END = 255
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_VALUES = np.random.default_rng(400).integers(1, 1 << 63, (2, 256), np.uint64) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


@dataclass(frozen=True)
class Passages:
    length: int = 400
    gram: int = 64
    sorted_bytes: int = 4 << 20

    def __post_init__(self):
        if not 1 <= self.gram <= self.length:
            raise ValueError("gram must be between 1 and length")


def _tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = 1 << max(n, 4096).bit_length()
        both = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers[which] = (both[0], both[1])
    return _powers[which]


class Codes:
    """Codes of any runs of bytes in an array."""

    def __init__(self, raw: np.ndarray, which: int = 0):
        up, self.down = _tables(len(raw) + 1, which)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[which][raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, starts, ends) -> np.ndarray:
        """For two slices or two arrays of places; equal runs have equal codes wherever they stand."""
        code = (self.sums[ends] - self.sums[starts]) * self.down[: len(self.sums)][starts]
        code ^= code >> np.uint64(31)
        code *= np.uint64(0xD6E8FEB86659FD93)
        return code ^ (code >> np.uint64(32))


def _window_minimum(values: np.ndarray, size: int) -> np.ndarray:
    reach, low = 1, values
    while 2 * reach <= size:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    n = len(values) - size + 1
    return np.minimum(low[:n], low[size - reach : size - reach + n])


def pieces(raw: np.ndarray, spec: Passages) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays for slices of a text: anchor, code, first start, number of starts, and whether the anchor occurs again nearby.

    The last is true if one passage of a piece may equal another of the same piece.
    """
    length, gram = spec.length, spec.gram
    for at in range(0, len(raw) - length + 1, SLICE):
        part = raw[at : at + SLICE + length - 1]
        codes = Codes(part)
        grams = codes.of(slice(0, len(part) - gram + 1), slice(gram, len(part) + 1))
        low = _window_minimum(grams, length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        n = np.diff(np.append(first, len(low)))
        anchor = low[first]
        few = grams[grams <= anchor.max()]
        known = np.sort(anchor)
        place = np.minimum(np.searchsorted(known, few), len(known) - 1)
        seen = np.sort(few[known[place] == few])
        again = np.searchsorted(seen, anchor, "right") - np.searchsorted(seen, anchor) > 1
        code = codes.of(first, first + n - 1 + length) ^ n.astype(np.uint64)
        yield anchor.view(np.int64), code.view(np.int64), first + at, n, again


def text_bytes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text, without copies; missing texts have none."""
    wide = texts.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1].tolist()
    raw = np.frombuffer(wide.buffers()[2], np.uint8) if wide.buffers()[2] is not None else np.empty(0, np.uint8)
    for start, end in zip(edges, edges[1:]):
        yield raw[start:end]


PIECES = "anchor long, code long, k1 long, k2 long, start int, n int, again boolean"


def _all_pieces(batches, spec: Passages) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        for row, raw in enumerate(text_bytes(batch.column("text"))):
            for found in pieces(raw, spec):
                for part, values in zip(parts, [*found, np.full(len(found[0]), row)]):
                    part.append(values)
        if not parts[0]:
            continue
        anchor, code, start, n, again, row = (np.concatenate(p) for p in parts)
        k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False)[row] for k in ("k1", "k2"))
        columns = [anchor, code, k1, k2, start.astype(np.int32), n.astype(np.int32), again]
        yield pa.record_batch([pa.array(c) for c in columns], [c.split()[0] for c in PIECES.split(", ")])


def common_prefixes(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, known: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at ``a`` and ``b`` share, ``most`` at most, if they share those that are ``known``.

    ``words`` has the 8 bytes at each place.
    """
    out = np.minimum(known, most)
    going = np.flatnonzero(out < most)
    a, b = a[going] + out[going], b[going] + out[going]
    while len(going):
        differ = words[a] ^ words[b]
        same = differ == 0
        ended = differ[~same]
        # bytes before the highest bit that differs; without the bits that follow a set one, rounding to a float adds none
        bits = np.frexp((ended & ~(ended >> np.uint64(1))).astype(np.float64))[1]
        out[going[~same]] += (64 - bits) // 8
        a, b, going = a[same] + 8, b[same] + 8, going[same]
        out[going] += 8
        open_ends = out[going] < most
        if not open_ends.all():
            a, b, going = a[open_ends], b[open_ends], going[open_ends]
    return np.minimum(out, most)


def _words(text: np.ndarray, padding: int) -> np.ndarray:
    """The 8 bytes from each place as one number that orders like them."""
    padded = np.concatenate([text, np.full(padding + 8, END, np.uint8)])
    words = np.zeros(len(padded) - 7, np.uint64)
    for i in range(8):
        words |= padded[i : len(words) + i].astype(np.uint64) << np.uint64(56 - 8 * i)
    return words


def _rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; what follows the last byte is smaller than everything."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16)))
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where the byte changes
    rising = np.zeros(n, bool)
    inside = at < n
    rising[:-1][inside] = step[at[inside]] > 0
    return rising


def _sorted_directly(places: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Places in order of the first ``most`` bytes from there.

    Groups that are still equal skip what all their members share and are then sorted by the next eight bytes.
    """
    order = places[np.argsort(words[places], kind="stable")]
    key = words[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    known = np.full(len(order), 8, np.int32)
    slots = np.arange(len(order))
    while True:
        group = np.cumsum(fresh) - 1
        tied = np.bincount(group)[group] > 1
        slots, group, known = slots[tied], group[tied], known[tied]
        if not len(slots):
            return order
        fresh = np.concatenate([[True], group[1:] != group[:-1]])
        here = order[slots]
        share = np.full(len(slots), most, np.int32)
        inner = np.flatnonzero(~fresh)
        share[inner] = common_prefixes(words, here[inner - 1], here[inner], most, known[inner])
        heads = np.flatnonzero(fresh)
        shared = np.minimum.reduceat(share, heads)
        group = np.cumsum(fresh) - 1
        known = shared[group]
        going = known < most
        slots, here, group, known = slots[going], here[going], group[going], known[going]
        if not len(slots):
            return order
        key = words[here + known]
        by = np.lexsort((key, group))
        order[slots] = here[by]
        key, group = key[by], group[by]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])


def suffix_order(text: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """All places in order of the first ``most`` bytes from there, by two-stage sorting."""
    rising = _rising(text)
    direct = np.flatnonzero(rising).astype(np.int32)
    direct = _sorted_directly(direct, words, most) if len(direct) else direct
    edges = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([len(text) - 1], np.int32))
    out = []
    for byte in range(256):
        wave = np.concatenate(induced[byte]) if induced[byte] else np.empty(0, np.int32)
        bucket = []
        while len(wave):  # a falling suffix whose successor starts with the same byte comes from this bucket itself
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[text[before] == byte]
        bucket.append(direct[edges[byte] : edges[byte + 1]])
        bucket = np.concatenate(bucket)
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        starts = text[before]
        larger = starts > byte
        before, starts = before[larger], starts[larger]
        by = np.argsort(starts, kind="stable")
        before, starts = before[by], starts[by]
        cuts = np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1]])) if len(starts) else []
        for start, end in zip(cuts, [*cuts[1:], len(starts)]):
            induced[starts[start]].append(before[start:end])
    return np.concatenate(out)


def repeated_starts(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each of different pieces, which of its starts have a passage that starts anywhere else in them."""
    sizes = np.array([len(b) + 1 for b in bodies])
    text = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)
    words = _words(text, length)
    order = suffix_order(text, words, length)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    is_start = np.zeros(len(text), bool)
    for at, size in zip(first.tolist(), sizes.tolist()):
        is_start[at : at + size - length] = True
    order = order[is_start[order]]
    alike = common_prefixes(words, order[:-1], order[1:], length, np.zeros(max(len(order) - 1, 0), np.int32)) >= length
    repeated = np.zeros(len(text), bool)
    repeated[order[:-1][alike]] = True
    repeated[order[1:][alike]] = True
    return [repeated[at : at + size - length] for at, size in zip(first.tolist(), sizes.tolist())]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of true flags."""
    steps = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    first = np.flatnonzero(steps > 0)
    return first, np.flatnonzero(steps < 0) - first


BODIES = "anchor long, code long, copies long, k1 long, k2 long, start int, n int, body binary"


def _bodies(batches, spec: Passages) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted pieces; a text that a task has more than once gives them once."""
    seen = set()
    for batch in small_batches(batches):
        rows = {c.split()[0]: [] for c in BODIES.split(", ")}
        columns = (batch.column(c) for c in ("k1", "k2", "wanted"))
        for k1, k2, wanted, raw in zip(*columns, text_bytes(batch.column("text"))):
            key = (k1.as_py(), k2.as_py())
            if key in seen:
                continue
            seen.add(key)
            for piece in wanted.as_py():
                body = raw[piece["start"] : piece["start"] + piece["n"] - 1 + spec.length]
                for name, value in (piece | {"k1": key[0], "k2": key[1], "body": body.tobytes()}).items():
                    rows[name].append(value)
        kinds = {"start": pa.int32(), "n": pa.int32(), "body": pa.binary()}
        yield pa.record_batch([pa.array(v, kinds.get(c, pa.int64())) for c, v in rows.items()], list(rows))


RANGES = "k1 long, k2 long, start int, n int"


def _sorted_pieces(batches, spec: Passages) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated starts in pieces without copies; a task's rows come in order of anchor and code."""
    held: list[dict] = []
    last, size = None, 0

    def ranges():
        found = {c.split()[0]: [] for c in RANGES.split(", ")}
        for row, flags in zip(held, repeated_starts([r["body"] for r in held], spec.length)):
            if row["copies"] == 1:
                for start, n in zip(*_runs(flags)):
                    for name, value in (("k1", row["k1"]), ("k2", row["k2"]), ("start", row["start"] + start), ("n", n)):
                        found[name].append(value)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.record_batch([pa.array(v, kind) for v, kind in zip(found.values(), kinds)], list(found))

    for batch in small_batches(batches):
        for row in batch.to_pylist():
            key = (row["anchor"], row["code"])
            if key == last:  # the same text from several tasks
                continue
            if size >= TOGETHER and row["anchor"] != last[0]:
                yield ranges()
                held.clear()
                size = 0
            held.append(row)
            size += len(row["body"])
            last = key
    if held:
        yield ranges()


STARTS = "code1 long, code2 long, copies long, k1 long, k2 long, start int"


def _start_codes(batches, spec: Passages) -> Iterator[pa.RecordBatch]:
    """The passages of pieces by two codes of their bytes."""
    for batch in small_batches(batches, 64):
        for row in batch.to_pylist():
            raw = np.frombuffer(row["body"], np.uint8)
            for at in range(0, row["n"], SLICE):
                part = raw[at : at + SLICE + spec.length - 1]
                n = len(part) - spec.length + 1
                ends = slice(0, n), slice(spec.length, len(part) + 1)
                codes = [Codes(part, which).of(*ends).view(np.int64) for which in (0, 1)]
                same = [np.full(n, row[c]) for c in ("copies", "k1", "k2")]
                columns = [*codes, *same, np.arange(n, dtype=np.int32) + np.int32(row["start"] + at)]
                yield pa.record_batch([pa.array(c) for c in columns], [c.split()[0] for c in STARTS.split(", ")])


def _kept(batches, spec: Passages, names: list[str]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without the bytes of repeated passages."""
    for batch in small_batches(batches):
        sizes, removed, spans, hashes, texts = [], [], [], [], []
        for raw, ranges in zip(text_bytes(batch.column("text")), batch.column("ranges")):
            kept, gone, runs = raw, 0, 0
            if ranges.is_valid and len(ranges.values):
                start, n = (ranges.values.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n"))
                cover = np.zeros(len(raw) + 1, np.int32)
                np.add.at(cover, start, 1)
                np.add.at(cover, start + n - 1 + spec.length, -1)
                covered = np.cumsum(cover[:-1]) > 0
                kept, gone, runs = raw[~covered], int(covered.sum()), len(_runs(covered)[0])
            sizes.append(len(raw))
            removed.append(gone)
            spans.append(runs)
            hashes.append(hashlib.sha256(kept.tobytes()).hexdigest())
            texts.append(kept.tobytes())
        counts = [pa.array(c, pa.int64()) for c in (sizes, removed, spans)]
        columns = [batch.column("doc_id"), *counts, pa.array(hashes, pa.string()), pa.array(texts, pa.binary())]
        yield pa.record_batch(columns[: len(names)], names)


def _if_small(written: DataFrame, items: str | None = None) -> DataFrame:
    """A written table, marked for broadcast if it is small, the lists in ``items`` included."""
    size = written.agg(F.count("*") + (F.coalesce(F.sum(F.size(items)), F.lit(0)) if items else F.lit(0))).first()[0]
    return F.broadcast(written) if size <= SMALL else written


def repeated_ranges(keyed: DataFrame, spec: Passages) -> DataFrame:
    """Of texts (k1, k2, text): k1, k2 and ranges, a list of (start, n): the starts of passages that start elsewhere too."""
    found = stage_table(keyed.mapInArrow(lambda it: _all_pieces(it, spec), PIECES), "pieces")
    one = F.min(F.struct("k1", "k2", "start", "n", "again")).alias("one")
    classes = stage_table(found.groupBy("anchor", "code").agg(F.count("*").alias("copies"), one), "piece-classes")
    anchors = classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.sum(F.col("one.n") + F.lit(spec.length)).alias("bytes"))
    sizes = F.col("bytes") > spec.sorted_bytes
    several = stage_table(anchors.where("classes > 1").select("anchor", sizes.alias("large")), "shared-anchors")
    alone = classes.where("copies = 1 AND one.again").select("anchor", "code")  # repeats within itself are possible
    alone = alone.join(several, "anchor", "left_anti").join(classes, ["anchor", "code"])
    alone = alone.withColumn("large", F.col("one.n") + F.lit(spec.length) > spec.sorted_bytes)
    together = classes.join(_if_small(several), "anchor")
    wanted = together.unionByName(alone.select(*together.columns))
    piece = F.struct("anchor", "code", "copies", F.col("one.start").alias("start"), F.col("one.n").alias("n"))
    parts = [
        stage_table(wanted.where(F.col("large") == large).groupBy("one.k1", "one.k2").agg(F.collect_list(piece).alias("wanted")), "wanted-pieces")
        for large in (False, True)
    ]
    texts = [keyed.join(_if_small(p, "wanted"), ["k1", "k2"]).mapInArrow(lambda it: _bodies(it, spec), BODIES) for p in parts]
    order = ["anchor", "code"]
    ranges = texts[0].repartition("anchor").sortWithinPartitions(*order).mapInArrow(lambda it: _sorted_pieces(it, spec), RANGES)
    copied = classes.where("copies > 1").select("anchor", "code")
    copied = found.join(_if_small(stage_table(copied, "copied-pieces")), ["anchor", "code"]).select("k1", "k2", "start", "n").distinct()
    ranges = stage_table(ranges, "sorted-ranges").unionByName(copied)
    if not parts[1].isEmpty():
        starts = texts[1].dropDuplicates(order).mapInArrow(lambda it: _start_codes(it, spec), STARTS)
        starts = stage_table(starts, "start-codes")
        counted = starts.groupBy("code1", "code2").agg(F.sum("copies").alias("n")).where("n > 1").drop("n")
        again = starts.where("copies = 1").join(counted, ["code1", "code2"])
        ranges = ranges.unionByName(again.select("k1", "k2", "start", F.lit(1).alias("n")))
    return stage_table(ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n")).alias("ranges")), "repeated-ranges")


def remove_repeats(docs: DataFrame, spec: Passages = Passages(), with_text: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Bytes covered by a string of ``spec.length`` bytes that also starts anywhere else, in the same text or another, are
    removed; all occurrences go, the first included. ``n_spans`` counts maximal removed runs; ``with_text`` adds what is
    left as ``kept``, in bytes, as a passage may begin inside a character. Missing texts count as empty; shorter texts
    stay whole; repeated rows are copies of one another, each with a result; an empty table gives an empty one; other
    columns are left out. Texts are told apart by 128-bit codes.
    """
    for_long_texts(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(400), text).alias("k2"))
    long_enough = keyed.where(F.octet_length("text") >= spec.length)
    ranges = repeated_ranges(long_enough.select("k1", "k2", "text"), spec)
    met = keyed.join(_if_small(ranges, "ranges"), ["k1", "k2"], "left").select("doc_id", "text", "ranges")
    id_type = keyed.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if with_text else [])
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return met.mapInArrow(lambda it: _kept(it, spec, names), schema)
