"""Alignment of the tokens of two tokenizers by the bytes they cover, with corpus-wide counts of tokens that end together.

Both tokenizers never join what a single space between two other characters separates, so a text is a list of *units*
between such spaces; each distinct unit is encoded and aligned once and remembered for a while. Within units every token
points to its farthest-right overlapping token; successors are doubled until nothing changes, and the terminal token of a
token's chain labels its group.

Counts need all texts before any text can be judged. Texts are read once: what is known of each is written with its
distinct links, packed, and judged from there. Only pairs of ids and their counts are shuffled. Their number is bounded by
the vocabularies; they are sent to executors in blocks of ``PAIRS`` at most.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .frames import for_long_texts, ship, small_batches

ship(__name__)

#: Units a worker remembers before it starts anew, characters of text split or encoded at once, and pairs of ids sent to
#: executors at once.
REMEMBERED, TOGETHER, PAIRS = 1 << 19, 1 << 20, 1 << 22
#: Units encoded as one text; longer texts take more time per token.
LINE = 256
#: A space between two characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: What the second tokenizer writes for a space; a text that holds it itself is not given back by its tokens.
MARK = "▁"


def byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, others for 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Two tokenizers as functions from texts, which spaces precede, to ids; and the bytes of each id."""

    def __init__(self, given: dict[str, bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        first = Tokenizer.from_str(given["a"].decode())
        first.encode_special_tokens = True
        second = sentencepiece.SentencePieceProcessor(model_proto=given["b"])
        alphabet = byte_alphabet()
        names = {i: token for token, i in first.get_vocab(with_added_tokens=True).items()}
        self.a = lambda lines: [e.ids for e in first.encode_batch_fast([" " + line for line in lines], add_special_tokens=False)]
        self.b = lambda lines: second.encode(lines, num_threads=1)
        self.bytes_a = [bytes(alphabet.get(c, 0) for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(map(second.id_to_piece, range(second.get_piece_size())))
        ]
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in table]) for table in (self.bytes_a, self.bytes_b))
        # ids as text with what follows them: inside a group, at the end of its part, and in b at the end of a unit
        self.first_b = 2 * len(self.bytes_a)
        ends = [(self.bytes_a, ",|"), (self.bytes_b, (",", ";", ""))]
        self.written = [f"{i}{end}" for table, marks in ends for end in marks for i in range(len(table))]


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For the tokens of two complete coverings of the same bytes, those of a before those of b, the last token of its group.

    A token's successor is the overlapping token that ends last, among equals that of b; one that ends last itself is its
    own successor.
    """
    n = len(ends_a)
    over_a = np.searchsorted(ends_b, ends_a)  # the token of b over the last byte of each token of a
    over_b = np.searchsorted(ends_a, ends_b)
    own = np.arange(len(ends_b))
    after = np.concatenate([over_a + n, np.where(ends_a[over_b] > ends_b, over_b, own + n)])
    while True:
        twice = after[after]
        if np.array_equal(twice, after):
            return after
        after = twice


class Rows:
    """An array that rows are added to; ``rows`` shows those so far."""

    def __init__(self, *shape: int):
        self.held, self.n = np.empty((1024, *shape), np.int64), 0

    def add(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.held):
            held = np.empty((2 * end, *self.held.shape[1:]), np.int64)
            held[: self.n] = self.rows
            self.held = held
        self.held[self.n : end] = more
        self.n = end

    @property
    def rows(self) -> np.ndarray:
        return self.held[: self.n]


def parts(text: str) -> Iterator[str]:
    """A text cut between units into parts of about ``TOGETHER`` characters."""
    at = 0
    while len(text) - at > TOGETHER and (cut := CUT.search(text, at + TOGETHER)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


class Units:
    """What is known of each unit: token counts, groups as text, and pairs of ids that end together."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.shift = max(len(tokenizers.bytes_b) - 1, 1).bit_length()
        self.packed = "<u4" if len(tokenizers.bytes_a) << self.shift <= 1 << 32 else "<u8"
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.kept_figures, self.kept_pairs = Rows(5), Rows()

    @property
    def figures(self) -> np.ndarray:
        """For each unit: tokens of a, tokens of b, groups, 1 if both cover just the unit, and where its pairs end."""
        return self.kept_figures.rows

    @property
    def pairs(self) -> np.ndarray:
        """The pairs of all units in order; a unit has as many as groups."""
        return self.kept_pairs.rows

    def learn(self, units: list[str]) -> None:
        """Encode and align units that are not known yet."""
        loose = [u for u in units if MARK in u or u != u.strip() or not u]
        odd = set(loose)
        plain = [u for u in units if u not in odd]
        at = 0
        while at < len(plain):
            end, size = at, 0
            while end < len(plain) and (end == at or size + len(plain[end]) < TOGETHER):
                size += len(plain[end]) + 1
                end += 1
            if not self._add(plain[at:end]):
                for unit in plain[at:end]:
                    self._add_alone(unit)
            at = end
        for unit in loose:
            self._add_alone(unit)

    def _add_alone(self, unit: str) -> None:
        if not unit or not self._add([unit]):
            self._append([unit], np.zeros((1, 4), np.int64), [""], np.empty(0, np.int64))

    def _add(self, units: list[str]) -> bool:
        """Units side by side; false if the tokens do not give them back."""
        t = self.tokenizers
        lines = [" ".join(units[i : i + LINE]) for i in range(0, len(units), LINE)]
        a, b = ([i for ids in encode(lines) for i in ids] for encode in (t.a, t.b))
        raw = (" " + " ".join(lines)).encode()
        if b"".join(map(t.bytes_a.__getitem__, a)) != raw or b"".join(map(t.bytes_b.__getitem__, b)) != raw:
            return False
        a, b = np.array(a), np.array(b)
        ends_a, ends_b = np.cumsum(t.sizes_a[a]), np.cumsum(t.sizes_b[b])
        last = terminals(ends_a, ends_b)
        heads = np.unique(last) - len(a)  # tokens of b that end groups, in order
        borders = ends_b[heads]
        cuts_a, cuts_b = np.searchsorted(ends_a, borders, "right"), heads + 1
        unit_ends = np.cumsum([len(u.encode()) + 1 for u in units])
        upto = np.searchsorted(borders, unit_ends, "right")  # groups up to the end of each unit
        if not np.array_equal(borders[upto - 1], unit_ends):
            return False
        figures = np.diff(np.stack([cuts_a[upto - 1], cuts_b[upto - 1], upto], 1), axis=0, prepend=0)
        pairs = (a[cuts_a - 1] << self.shift) | b[heads]
        # tokens in the order they are written: a group's tokens of a, then those of b
        shape_a, shape_b = a.copy(), b + t.first_b
        shape_a[cuts_a - 1] += len(t.bytes_a)
        shape_b[heads] += len(t.bytes_b)
        shape_b[heads[upto - 1]] += len(t.bytes_b)
        place_a = np.arange(len(a)) + np.concatenate([[0], cuts_b[:-1]]).repeat(np.diff(cuts_a, prepend=0))
        place_b = np.arange(len(b)) + cuts_a.repeat(np.diff(cuts_b, prepend=0))
        order = np.empty(len(a) + len(b), np.int64)
        order[place_a], order[place_b] = shape_a, shape_b
        written = list(map(t.written.__getitem__, order.tolist()))
        ends = (cuts_a + cuts_b)[upto - 1].tolist()
        groups = ["".join(written[i:j]) for i, j in zip([0, *ends], ends)]
        self._append(units, np.concatenate([figures, np.ones((len(units), 1), np.int64)], 1), groups, pairs)
        return True

    def _append(self, units, figures, groups, pairs) -> None:
        self.number.update(zip(units, range(len(self.number), len(self.number) + len(units))))
        self.groups.extend(groups)
        ends = self.kept_pairs.n + np.cumsum(figures[:, 2])
        self.kept_figures.add(np.concatenate([figures, ends[:, None]], 1))
        self.kept_pairs.add(pairs)

    def numbers(self, texts: list[str | None], before_forgetting: Callable[[], None] = lambda: None) -> list[np.ndarray]:
        """The numbers of each text's units; a missing or empty text has none."""
        if len(self.number) > REMEMBERED:
            before_forgetting()
            self.forget()
        found: list[list[np.ndarray]] = [[] for _ in texts]
        group: list[tuple[int, list[str]]] = []
        size = 0

        def look_up():
            fresh = dict.fromkeys(u for _, units in group for u in units if u not in self.number)
            if fresh:
                self.learn(list(fresh))
            for row, units in group:
                found[row].append(np.array([self.number[u] for u in units], np.int64))
            group.clear()

        for row, text in enumerate(texts):
            for part in parts(text) if text else ():
                group.append((row, CUT.split(part)))
                size += len(part)
                if size >= TOGETHER:
                    look_up()
                    size = 0
        look_up()
        return [np.concatenate(f) if f else np.empty(0, np.int64) for f in found]

    def links(self, numbers: np.ndarray) -> np.ndarray:
        """The pairs of some units, one after another."""
        sizes, ends = self.figures[numbers, 2], self.figures[numbers, 4]
        upto = np.cumsum(sizes)
        return self.pairs[np.arange(sizes.sum()) + np.repeat(ends - upto, sizes)]


def _units(state) -> Units:
    """The units of a worker, which one task leaves to the next."""
    held = state.value
    if "units" not in held:
        held["units"] = Units(Tokenizers(held))
    return held["units"]


FIGURES = ["n_a", "n_b", "n_groups", "n_links"]
#: Rows of texts, with distinct links and how often each occurs, packed; and rows of counts over many texts.
ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, times binary, pair array<long>, n array<long>"


def _aligned(batches, state, key: str) -> Iterator[pa.RecordBatch]:
    """Texts as they are aligned, and from time to time the pairs that end together in the texts so far, with their counts."""
    units, ready = _units(state), []
    seen = np.zeros(0, np.int64)
    names = [key, *(c.split()[0] for c in ALIGNED.split(", "))]

    def count():
        nonlocal seen
        n = units.figures[: len(seen), 2]
        pairs, place = np.unique(units.pairs[: n.sum()], return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, place, np.repeat(seen, n))
        pairs, total = pairs[total > 0], total[total > 0]
        lists = [pa.array([x[i : i + TOGETHER] for i in range(0, len(x), TOGETHER)], pa.list_(pa.int64())) for x in (pairs, total)]
        kinds = [batch.column(key).type, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
        ready.append(pa.record_batch([*(pa.nulls(len(lists[0]), k) for k in kinds), *lists], names))
        seen = np.zeros(0, np.int64)

    for batch in small_batches(batches, 64):
        numbers = units.numbers(batch.column("text").to_pylist(), count)
        seen = np.concatenate([seen, np.zeros(len(units.number) - len(seen), np.int64)])
        rows, hashes, packed = np.zeros((len(numbers), 4), np.int64), [""] * len(numbers), [(b"", b"")] * len(numbers)
        for i, n in enumerate(numbers):
            if len(n) and units.figures[n, 3].all():
                rows[i, :3] = units.figures[n, :3].sum(axis=0)
                rows[i, 3] = rows[i, 2]
                hashes[i] = hashlib.sha256(";".join([units.groups[u] for u in n.tolist()]).encode()).hexdigest()
                links, times = np.unique(units.links(n), return_counts=True)
                packed[i] = links.astype(units.packed).tobytes(), times.astype("<u4").tobytes()
                np.add.at(seen, n, 1)
        yield from ready
        ready.clear()
        columns = [batch.column(key), *(pa.array(rows[:, k]) for k in range(4)), pa.array(hashes, pa.string())]
        columns += [pa.array([p[k] for p in packed], pa.binary()) for k in (0, 1)]
        yield pa.record_batch([*columns, *[pa.nulls(len(numbers), pa.list_(pa.int64()))] * 2], names)
    if len(seen):
        count()
    yield from ready


def _judged(batches, kind: str, block, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Texts with two sums over those of their links that are in a block of pairs."""
    known, n, best = (block.value[c] for c in ("pair", "n", "best"))
    for batch in small_batches(batches, 256):
        links, times = (batch.column(c).to_pylist() for c in ("links", "times"))
        sums = np.zeros((len(links), 2), np.int64)
        for i, (raw, often) in enumerate(zip(links, times)):
            pairs = np.frombuffer(raw, kind).astype(np.int64)
            if not len(pairs) or not len(known):
                continue
            at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
            often = np.where(known[at] == pairs, np.frombuffer(often, "<u4"), 0)
            sums[i] = (often * best[at]).sum(), (often * n[at]).sum()
        columns = {c: batch.column(c) for c in batch.schema.names} | {"n_best": pa.array(sums[:, 0]), "count_sum": pa.array(sums[:, 1])}
        yield pa.record_batch([columns[c] for c in names], names)


def pair_counts(aligned: DataFrame, shift: int) -> DataFrame:
    """pair, n, best: how often two ids end together, and whether no other id ends more often with the same b id."""
    counted = aligned.where("pair IS NOT NULL").select(F.explode(F.arrays_zip("pair", "n")).alias("one"))
    counted = counted.groupBy("one.pair").agg(F.sum("one.n").alias("n"))
    counted = stage_table(counted, "pair-counts")
    low = F.col("pair").bitwiseAND((1 << shift) - 1)
    most = counted.groupBy(low.alias("b")).agg(F.max("n").alias("most"))
    return stage_table(counted.join(most, low == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path`` is a byte-level vocabulary of the tokenizers library, used on a space and the text; ``b_path`` a model of
    the sentencepiece library, which puts that space itself. Special tokens' strings are plain text. A text that is
    missing, empty, or not given back by the tokens of both has no tokens: zeros, and an empty text in place of the hash.
    Repeated rows each have a result and count each; an empty table gives an empty one; other columns are left out. A
    link joins two tokens that end together; its count is how often the corpus links these two ids.
    """
    spark = docs.sparkSession
    for_long_texts(spark)
    given = docs.select("doc_id", "text")
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        files = {"a": a.read(), "b": b.read()}
    units = Units(Tokenizers(files))
    shift, packed = units.shift, units.packed
    state = spark.sparkContext.broadcast(files)
    kind = given.schema["doc_id"].dataType.simpleString()
    aligned = given.mapInArrow(lambda it: _aligned(it, state, "doc_id"), f"doc_id {kind}, {ALIGNED}")
    aligned = stage_table(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")  # with numbers, so that these stay
    pairs = pair_counts(aligned, shift)
    texts = aligned.where("links IS NOT NULL").drop("pair", "n")
    blocks = max(1, -(-pairs.count() // (PAIRS * 3 // 4)))
    types = "n_best long, count_sum long"

    def judged(block: int, rows: DataFrame, columns: str) -> DataFrame:
        some = pairs.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == block).orderBy("pair").toArrow()
        sent = spark.sparkContext.broadcast({c: some.column(c).to_numpy() for c in some.column_names})
        names = [c.split()[0] for c in columns.split(", ")]
        return rows.mapInArrow(lambda it: _judged(it, packed, sent, names), columns)

    whole = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in FIGURES) + f", {types}, groups_sha256 string"
    if blocks == 1:
        return judged(0, texts, whole)
    # each block sees the links of all texts and adds to two of their sums
    parts = [stage_table(judged(k, texts.select("row", "links", "times"), f"row long, {types}"), f"judged-{k}") for k in range(blocks)]
    sums = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return texts.join(sums, "row").select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256")
