"""Language-model scores by deleted interpolation of word trigrams, word pairs and classes.

A token's probability mixes three maximum-likelihood estimates: after the two words before it, after the one word before
it, and by classes. The weights of the mix depend on how often the two contexts occur (buckets by powers of two) and are
learned by expectation-maximisation on the runs of a part of the corpus that the estimates did not see.

Texts are read once into groups of bounded size: the distinct words of a group and their numbers, token by token. Groups
are dealt once, and stay where they are. Counts of words, then of pairs, then of runs of three come to them by one exchange
each: a group sends its distinct keys with its own counts, dealt by key, packed; the sums go back in the same order. A context counts as often as the word, or the
pair, it is made of, so contexts need no counts of their own. What a group need not ask is left out without loss: where a
word or pair occurs in no other group, no run that holds it does. Words are compared as they are, pairs and runs of three as
64-bit codes.

By classes: the most frequent tokens have a class of their own, all others share hashed classes. The estimate is that of
a token's class after the class before it, times the token's share of its class. The first is itself a mix of class pairs,
single classes and equal shares, with weights learned in the same way. The share is smoothed by one, with one more share
for tokens never seen, so probabilities add up to one.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .frames import for_long_texts, ship
from .word_codes import SLICE, _long_codes

ship(__name__)

#: The token at the end of each text; no word is empty.
END = b""


@dataclass(frozen=True)
class Settings:
    """Classes of their own and shared ones, and how many distinct words and how many tokens fill a group of texts.

    ``broadcast_counts`` has no effect any more: no counts are broadcast.
    """

    own: int = 511
    shared: int = 512
    broadcast_counts: int = 100_000
    buffered: int = 400_000
    buffered_runs: int = 1 << 20
    steps: int = 60

    @property
    def classes(self) -> int:
        return self.own + self.shared


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text; a missing id counts as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % by


def tokens_of(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


class Classes:
    """The class of each token; class ``own + shared`` stands for the start of a text."""

    def __init__(self, own: dict[bytes, int], first: int, shared: int):
        self.own, self.first, self.shared = own, first, shared

    def class_of(self, token: bytes) -> int:
        """The shared class of a token without one of its own."""
        return self.first + zlib.crc32(token) % self.shared

    def of(self, tokens: list[bytes]) -> np.ndarray:
        own, first, shared, crc = self.own, self.first, self.shared, zlib.crc32
        return np.array([own[t] if t in own else first + crc(t) % shared for t in tokens], np.int64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One code for two."""
    mixed = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(29))


#: Contexts seen 2**(BUCKETS - 2) times or more share a bucket.
BUCKETS = 24


def run_weights(b3: np.ndarray, b2: np.ndarray, estimates: np.ndarray, times: np.ndarray, steps: int) -> np.ndarray:
    """Weights of the estimates by three words, two words and classes, for each two buckets of the contexts.

    Buckets without held-out runs take the weights of all runs together; a context never seen has no weight.
    """
    possible = np.ones((BUCKETS, BUCKETS, 3))
    possible[0, :, 0] = possible[:, 0, 1] = 0
    possible = possible.reshape(-1, 3)

    def fitted(of: np.ndarray, weights: np.ndarray) -> np.ndarray:
        for _ in range(steps):
            shares = weights[of] * estimates
            shares *= (times / np.maximum(shares.sum(axis=1), 1e-300))[:, None]
            sums = np.stack([np.bincount(of, shares[:, k], len(weights)) for k in range(3)], axis=1)
            total = sums.sum(axis=1, keepdims=True)
            weights = np.where(total > 0, sums / np.maximum(total, 1e-300), weights)
        return weights

    together = fitted(np.zeros(len(times), np.int64), np.full((1, 3), 1 / 3))
    floor = 1e-6  # classes never vanish, so every token stays possible
    together = together * (1 - floor) + floor * np.array([0, 0, 1])
    start = possible * together
    weights = fitted(b3 * BUCKETS + b2, start / start.sum(axis=1, keepdims=True)) * possible
    return weights * (1 - floor) + floor * np.array([0, 0, 1])


def bucket(times: np.ndarray) -> np.ndarray:
    """Contexts never seen, and powers of two of how often the others occur."""
    return np.where(times > 0, np.floor(np.log2(np.maximum(times, 1))) + 1, 0).astype(np.int64)


def _parts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Pair, single and equal-share estimates."""
    before, after = counts.sum(axis=1), counts.sum(axis=0)
    pair = counts / np.maximum(before, 1)[:, None]
    return pair, after / max(after.sum(), 1), 1 / counts.shape[1]


def mix_weights(learned: np.ndarray, held: np.ndarray, steps: int) -> np.ndarray:
    """Weights of the three estimates for each bucket, by expectation-maximisation on held-out pair counts."""
    pair, single, equal = _parts(learned)
    buckets = bucket(learned.sum(axis=1))
    weights = np.full((max(66, buckets.max() + 1), 3), 1 / 3)
    b, a = np.nonzero(held)
    n, of = held[b, a], buckets[b]
    estimates = np.stack([pair[b, a], single[a], np.full(len(a), equal)], axis=1)
    for _ in range(steps):
        shares = weights[of] * estimates
        shares *= (n / shares.sum(axis=1))[:, None]
        for k in range(3):
            total = np.bincount(of, shares[:, k], len(weights))
            weights[:, k] = np.where(np.bincount(of, n, len(weights)) > 0, total, weights[:, k])
        weights /= weights.sum(axis=1, keepdims=True)
    unseen = np.bincount(of, n, len(weights)) == 0
    weights[unseen & (np.arange(len(weights)) == 0)] = (0, 0.5, 0.5)
    floor = 1e-6  # equal shares never vanish, so every class stays possible
    return weights * (1 - floor) + floor * np.array([0, 0, 1])


def _chance(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    pair, single, equal = _parts(counts)
    of = weights[bucket(counts.sum(axis=1))]
    return of[:, :1] * pair + of[:, 1:2] * single[None, :] + of[:, 2:] * equal


def _packed(values: np.ndarray) -> tuple[int, int, bytes]:
    """Whole numbers from 0 on: how many, bytes of each, and these byte by byte, compressed."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return len(values), width, pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpacked(packed: tuple[int, int, bytes]) -> np.ndarray:
    n, width, data = packed
    raw = pa.Codec("zstd").decompress(data, n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(f"<u{width}").astype(np.int64 if width < 8 else np.uint64)


#: What a text counts for: to learn from, held out for the weights, or only to be scored.
LEARNED, HELD, SCORED = 0, 1, 2

_GROUP = ("group", "words", "ids", "lengths", "roles", "doc_ids", "tokens", "asks")


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """`tokens_of` each text, in one row as numbers of words, how many a text has, and the words."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(texts.fill_null("")))
    # the space behind the last word leaves an empty word, the end
    lists = pc.ascii_split_whitespace(pc.if_else(pc.equal(plain, ""), plain, pc.binary_join_element_wise(plain, "", " ")))
    coded = lists.flatten().dictionary_encode()
    return coded.indices.to_numpy(), pc.list_value_length(lists).to_numpy(), coded.dictionary.cast(pa.binary())


class _Open:
    """The texts of a group that is being filled."""

    def __init__(self):
        self.words, self.kinds = [pa.array([END], pa.binary())], 1
        self.ids, self.lengths, self.roles, self.doc_ids, self.total = [], [], [], [], 0

    def add(self, texts: pa.RecordBatch) -> None:
        ids, lengths, words = _tokens(texts.column("text"))
        self.ids.append((ids + self.kinds).astype(np.int32))
        self.words.append(words)
        self.kinds += len(words)
        self.lengths.append(lengths)
        self.roles.append(texts.column("role").to_numpy())
        self.doc_ids += texts.column("doc_id").to_pylist()
        self.total += len(ids)

    def merge(self) -> None:
        """Give each word one number; the end is number 0."""
        coded = pa.concat_arrays(self.words).dictionary_encode()
        self.ids = [coded.indices.to_numpy()[np.concatenate(self.ids)]]
        self.words, self.kinds = [coded.dictionary], len(coded.dictionary)

    def full(self, words: int, tokens: int) -> bool:
        """Whether there are so many tokens, or half as many distinct words or more; never more than these and one slice."""
        if self.kinds >= words:
            self.merge()
        return self.total >= tokens or len(self.words) == 1 and 2 * self.kinds >= words

    def row(self, number: int, asks: bool, id_type: pa.DataType) -> pa.RecordBatch:
        """Frequent words have small numbers, words equally frequent go by the alphabet; the end is number 0.

        The group's name rests on its partition, its number there and what it holds, so a repeated task finds it again.
        """
        self.merge()
        (ids,), (words,) = self.ids, self.words
        times = np.bincount(ids, minlength=len(words))
        times[0] = len(ids) + 1
        order = pc.sort_indices(pa.table({"times": times, "word": words}), [("times", "descending"), ("word", "ascending")])
        place = np.empty(len(words), np.int64)
        place[order.to_numpy()] = np.arange(len(words))
        shape = pa.struct([("n", pa.int64()), ("width", pa.int32()), ("data", pa.binary())])
        packs = [_text(words.take(order).to_pylist()), *(_packed(x.astype(np.int64)) for x in (place[ids], np.concatenate(self.lengths), np.concatenate(self.roles)))]
        task = TaskContext.get()
        name = hashlib.blake2b(b"%d %d " % (task.partitionId() if task else 0, number), digest_size=8)
        for _, _, data in packs:
            name.update(data)
        columns = [pa.array([int.from_bytes(name.digest()) >> 1], pa.int64()), *(pa.array([dict(zip(("n", "width", "data"), p))], shape) for p in packs)]
        columns += [pa.array([self.doc_ids], pa.list_(id_type)), pa.array([len(ids)], pa.int64()), pa.array([asks])]
        return pa.record_batch(columns, list(_GROUP))


def _text(words: list[bytes]) -> tuple[int, int, bytes]:
    text = b"\n".join(words)
    return len(text), 1, pa.Codec("zstd", 3).compress(text, asbytes=True)


def _plain(packed: tuple[int, int, bytes]) -> bytes:
    return pa.Codec("zstd").decompress(packed[2], packed[0], asbytes=True)


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Rows with about so many bytes of text together, or a single longer one."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


def _grouped(batches, words: int, tokens: int, asks: bool) -> Iterator[pa.RecordBatch]:
    """A row for each group of texts, closed when it has enough distinct words or tokens; held out texts have groups of their own."""
    filled, number = {False: _Open(), True: _Open()}, 0
    id_type = None
    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for texts in _slices(batch, min(SLICE, 8 * words, 8 * tokens)):
            apart = texts.column("role").to_numpy() == HELD
            for held in filled:
                part = texts.filter(pa.array(apart == held))
                if len(part):
                    filled[held].add(part)
                    if filled[held].full(words, tokens):
                        yield filled[held].row(number, asks, id_type)
                        filled[held], number = _Open(), number + 1
    for held, group in filled.items():
        if group.total:
            yield group.row(number + held, asks, id_type)


def _groups_of(docs: DataFrame, role: Column, settings: Settings, asks: bool = True) -> DataFrame:
    """The texts of ``docs`` (doc_id, text) as groups, which are written once, by `stage_table` or as they are dealt."""
    for_long_texts(docs.sparkSession)
    given = docs.select("doc_id", "text", role.cast("int").alias("role"))
    id_type = given.schema["doc_id"].dataType.simpleString()
    pack = "struct<n:long,width:int,data:binary>"
    schema = f"group long, words {pack}, ids {pack}, lengths {pack}, roles {pack}, doc_ids array<{id_type}>, tokens long, asks boolean"

    return given.mapInArrow(lambda it: _grouped(it, settings.buffered, settings.buffered_runs, asks), schema)


class Group:
    """The texts of a group, token by token, with its own counts and, once they have come, those of the corpus.

    Counts are of two rows: learned and held out. Distinct keys are sorted by code, so each bucket of codes is a slice.
    """

    def __init__(self, row: tuple, answers: dict[int, dict[int, tuple]], buckets: int, place: int = 0):
        self.row, self.answers, self.buckets, self.place = dict(zip(_GROUP, row)), answers, buckets, place
        self.ids, self.lengths, self.roles = (_unpacked(self.row[c]).astype(kind) for c, kind in (("ids", np.int32), ("lengths", np.int64), ("roles", np.int8)))
        self.text = _plain(self.row["words"])
        self.words = self.text.split(b"\n")
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.role = np.repeat(self.roles, self.lengths)
        self.first = np.zeros(len(self.ids), bool)
        self.first[self.starts] = True

    def _own(self, of: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((2, n), np.int64)
        for k in (LEARNED, HELD):
            if (self.roles == k).any():
                out[k] = np.bincount(of if (self.roles == k).all() else of[self.role == k], minlength=n)
        return out

    def _all(self, level: int, own: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the corpus for the distinct keys, and which of them other groups have, too; the group's own where nothing was asked."""
        got, out = self.answers[level], np.concatenate([own, np.zeros((1, own.shape[1]), np.int64)])
        if len(asked):
            for k in range(3):
                out[k, asked] = np.concatenate([_unpacked(got[b][k]) for b in sorted(got)]).astype(np.int64)
        return out[:2], out[2] > 0

    @cached_property
    def codes(self) -> np.ndarray:
        return np.concatenate([np.ones(1, np.uint64), _long_codes(np.frombuffer(self.text, np.uint8))])

    @cached_property
    def dealt(self) -> tuple[np.ndarray, np.ndarray]:
        """The words ordered by bucket, and the buckets in that order."""
        of = _dealt(self.codes, self.buckets)
        order = np.argsort(of, kind="stable")
        return order, of[order]

    @cached_property
    def own_words(self) -> np.ndarray:
        return self._own(self.ids, len(self.words))

    @cached_property
    def all_words(self) -> tuple[np.ndarray, np.ndarray]:
        return self._all(1, self.own_words, self.dealt[0])

    @cached_property
    def pair_codes(self) -> np.ndarray:
        codes = self.codes[self.ids]
        before = np.concatenate([np.zeros(1, np.uint64), codes[:-1]])
        before[self.first] = 0
        return _joined(before, codes)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs, a place of each, and the pair of each place."""
        return _distinct(self.pair_codes)

    @cached_property
    def own_pairs(self) -> np.ndarray:
        return self._own(self.pairs[2], len(self.pairs[0]))

    @cached_property
    def asked_pairs(self) -> np.ndarray:
        """Pairs of two words that other groups have, too."""
        elsewhere = self.all_words[1]
        at = self.pairs[1]
        return np.flatnonzero((self.first[at] | elsewhere[self.ids[at - 1]]) & elsewhere[self.ids[at]])

    @cached_property
    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self._all(2, self.own_pairs, self.asked_pairs)

    @cached_property
    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct runs of three, a place of each, and the run of each place."""
        before = np.concatenate([np.zeros(1, np.uint64), self.pair_codes[:-1]])
        before[self.first] = 0
        return _distinct(_joined(before, self.codes[self.ids]))

    @cached_property
    def own_runs(self) -> np.ndarray:
        return self._own(self.runs[2], len(self.runs[0]))

    @cached_property
    def asked_runs(self) -> np.ndarray:
        """Runs of two pairs that other groups have, too."""
        elsewhere = self.all_pairs[1]
        at, of = self.runs[1], self.pairs[2]
        return np.flatnonzero((self.first[at] | elsewhere[of[at - 1]]) & elsewhere[of[at]])

    @cached_property
    def all_runs(self) -> np.ndarray:
        return self._all(3, self.own_runs, self.asked_runs)[0]

    def asked(self, level: int) -> Iterator[tuple[int, tuple]]:
        """For each bucket with keys: the group's partition and number, the keys and their two counts."""
        if level == 1:
            order, of = self.dealt
            own = self.own_words
        else:
            keys, order, own = (self.pairs[0], self.asked_pairs, self.own_pairs) if level == 2 else (self.runs[0], self.asked_runs, self.own_runs)
            of = _dealt(keys[order], self.buckets)
        cuts = np.flatnonzero(np.diff(of, prepend=-1, append=-1))
        for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            part = order[at:end]
            if level == 1:
                sent = _text([self.words[i] for i in part.tolist()])
            else:
                sent = _packed(np.diff(keys[part], prepend=np.uint64(0)))
            yield int(of[at]), ((self.place, self.row["group"]), sent, _packed(own[0, part]), _packed(own[1, part]))

    def contexts(self, at: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
        """For runs at these places: counts of the two words before, of the pair, of the word before, and of the word."""
        first, of = self.first[at], self.pairs[2]
        return np.where(first, words[0], pairs[of[at - 1]]), pairs[of[at]], np.where(first, words[0], words[self.ids[at - 1]]), words[self.ids[at]]

    def cells(self, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
        """The class before each token, and its own."""
        after = classes.of(self.words).astype(np.int32)[self.ids]
        before = np.concatenate([np.zeros(1, np.int32), after[:-1]])
        before[self.first] = classes.first + classes.shared
        return before, after


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes in order, a place of each, and the number of the code at each place."""
    order = np.argsort(codes)
    ordered = codes[order]
    fresh = np.ones(len(codes), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    of = np.empty(len(codes), np.int32)
    of[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return ordered[fresh], order[fresh], of


def _dealt(codes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each code, in the order of codes."""
    return ((codes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


#: Kinds of rows that meet in a partition: a group, counts that come back to one, and what a bucket of words has in all.
GIVEN, BACK, FOUND = 0, 1, 2


def _groups(rows: Iterable, buckets: int) -> Iterator[Group]:
    """Groups of a partition, one at a time; until then they and their answers stay packed."""
    answers, given = defaultdict(lambda: defaultdict(dict)), []
    for place, (kind, *row) in rows:
        if kind == GIVEN:
            given.append((place, row))
        elif kind == BACK:
            group, level, bucket_, *counts = row
            answers[group][level][bucket_] = counts
    given.reverse()
    while given:
        place, row = given.pop()
        yield Group(row, answers.pop(row[0], defaultdict(dict)), buckets, place)


def _summed(rows: Iterable, level: int) -> tuple[list, np.ndarray, np.ndarray, list]:
    """The keys sent to a bucket, the number of each key, the sums of its two counts, and who sent how many of them."""
    sent, keys = [], []
    for _, (group, given, *counts) in rows:
        n, h = map(_unpacked, counts)
        sent.append((group, len(n), n, h))
        if level == 1:
            keys.append(pa.array(_plain(given).split(b"\n"), pa.large_binary()))
        else:
            keys.append(np.cumsum(_unpacked(given).astype(np.uint64), dtype=np.uint64))
    if not sent:
        return [], np.empty(0, np.int64), np.empty((2, 0), np.int64), []
    if level == 1:
        coded = pa.concat_arrays(keys).dictionary_encode()
        kinds, of = coded.dictionary, coded.indices.to_numpy()
    else:
        kinds, of = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.stack([np.bincount(of, np.concatenate([s[k] for s in sent]), len(kinds)).astype(np.int64) for k in (2, 3)])
    return kinds, of, sums, [s[:2] for s in sent]


def _by_bucket(rows: Iterable) -> Iterable[tuple[int, list]]:
    held = defaultdict(list)
    for row in rows:
        held[row[0]].append(row)
    return held.items()


def _answers(rows: Iterable, level: int, own: int, shared: int) -> Iterator[tuple[int, tuple]]:
    """The sums for each group that has asked and, of words, what `_frequent` finds."""
    for bucket_, held in _by_bucket(rows):
        kinds, of, sums, sent = _summed(held, level)
        if level == 1:
            yield bucket_, (FOUND, *_frequent(kinds, sums, own, shared))
        elsewhere, at = np.bincount(of) > 1, 0  # a group sends a key once
        for (place, group), n in sent:
            part = of[at : at + n]
            yield place, (BACK, group, level, bucket_, *(_packed(x[part]) for x in (*sums, elsewhere)))
            at += n


def _as_they_are(key: int) -> int:
    return key


#: Bytes of text, about 2 million tokens, for which there is a bucket of keys.
BUCKET = 12 << 20


def _bytes(docs: DataFrame) -> int:
    """The bytes of all texts, for the number of buckets; only sizes are read for it, no text is split."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


#: Bytes of a file of texts or of packed groups that one task reads, and so keeps packed.
READ = 16 << 20


class Exchange:
    """Groups, dealt once, and beside them the counts that have come back; each step adds one kind.

    Both are dealt to the same partitions by the same rule, so their union reads a partition of each and nothing moves.
    """

    def __init__(self, groups: DataFrame, size: int, own: int, shared: int):
        spark = groups.sparkSession
        self.context, self.own, self.shared = spark.sparkContext, own, shared
        packed = lambda p: (p.n, p.width, bytes(p.data))
        row = lambda r: (GIVEN, r.group, *map(packed, (r.words, r.ids, r.lengths, r.roles)), r.doc_ids, r.tokens, r.asks)
        name = "spark.sql.files.maxPartitionBytes"
        before = spark.conf.get(name)
        spark.conf.set(name, READ)
        try:
            read = groups.rdd.mapPartitionsWithIndex(lambda place, rows: ((place, row(r)) for r in rows))
            self.given = read.partitionBy(max(1, read.getNumPartitions()), _as_they_are)
        finally:
            spark.conf.set(name, before)
        self.buckets = max(self.context.defaultParallelism, -(-size // BUCKET))
        self.back = None

    def answer(self, level: int) -> None:
        """Ask for the counts of words, pairs or runs, and send back what they are in the whole corpus."""
        own, shared = self.own, self.shared
        sent = self.each(lambda group: group.asked(level)).partitionBy(self.buckets, _as_they_are)
        back = sent.mapPartitions(lambda rows: _answers(rows, level, own, shared)).partitionBy(self.given.getNumPartitions(), _as_they_are)
        self.back = back if self.back is None else self.back.union(back)

    def found(self) -> tuple:
        """What `_frequent` finds in the whole corpus."""
        own, none = self.own, ([], 0, 0, np.zeros(self.shared, np.int64))

        def both(a: tuple, b: tuple) -> tuple:
            return heapq.nsmallest(own, [*a[0], *b[0]]), *map(add, a[1:], b[1:])

        return self.back.mapPartitions(lambda rows: [reduce(both, (tuple(row[1:]) for _, row in rows if row[0] == FOUND), none)]).treeReduce(both)

    def each(self, function) -> RDD:
        """What ``function`` yields of each group."""
        buckets = self.buckets
        rows = self.given if self.back is None else self.back.union(self.given)
        return rows.mapPartitions(lambda rows: (out for group in _groups(rows, buckets) for out in function(group)))


def _frequent(kinds: pa.Array, sums: np.ndarray, own: int, shared: int) -> tuple:
    """The most frequent tokens of a bucket, all tokens, distinct ones, and both by shared class."""
    n = sums.sum(axis=0)
    seen = np.flatnonzero(n)
    tokens = kinds.take(pa.array(seen)).to_pylist()
    sizes = np.bincount([zlib.crc32(t) % shared for t in tokens], n[seen] + 1, shared).astype(np.int64) if tokens else np.zeros(shared, np.int64)
    return heapq.nsmallest(own, zip((-n[seen]).tolist(), tokens)), int(n.sum()), len(seen), sizes


def _counts(groups: DataFrame, size: int, own: int, shared: int) -> tuple[Exchange, tuple]:
    """All counts that the groups of ``size`` bytes of text need, and what `_frequent` finds in the whole corpus."""
    exchange = Exchange(groups, size, own, shared)
    exchange.answer(1)
    found = exchange.found()
    for level in (2, 3):
        exchange.answer(level)
    return exchange, found


#: Class pairs are added up in blocks of so many cells.
BLOCK = 1 << 15


def _class_pairs(exchange: Exchange, classes: Classes) -> np.ndarray:
    """Counts of class pairs, of learned and of held out texts."""
    width = classes.first + classes.shared
    size = (width + 1) * width
    known = exchange.context.broadcast(classes)

    def counted(rows):
        cells = np.zeros(2 * size, np.int64)
        for group in _groups(rows, 1):
            before, after = group.cells(known.value)
            counts = group.role != SCORED
            cells += np.bincount((group.role.astype(np.int64) * size + before.astype(np.int64) * width + after)[counts], minlength=2 * size)
        for at in range(0, 2 * size, BLOCK):
            if cells[at : at + BLOCK].any():
                yield at // BLOCK, _packed(cells[at : at + BLOCK])

    def added(rows):
        for block, held in _by_bucket(rows):
            yield block, _packed(sum(_unpacked(packed) for _, packed in held))

    cells = np.zeros(2 * size)  # whole on the driver: at most twice the square of the classes
    blocks = exchange.given.mapPartitions(counted).partitionBy(-(-2 * size // BLOCK), _as_they_are)
    for block, packed in blocks.mapPartitions(added).collect():
        part = _unpacked(packed)
        cells[block * BLOCK : block * BLOCK + len(part)] = part
    return cells.reshape(2, width + 1, width)


def _bucket_of(times: np.ndarray) -> np.ndarray:
    return np.minimum(bucket(times), BUCKETS - 1)


def _by_class(cells: tuple[np.ndarray, np.ndarray], at: np.ndarray, wn: np.ndarray, known: dict) -> np.ndarray:
    before, after = (x[at] for x in cells)
    return known["chance"][before, after] * np.where(after < known["classes"].first, 1, (wn + 1) / known["sizes"][after])


#: Stands for the ratio of a run never seen; the others, quarter powers of two of doubles, are far from it.
NEVER = -(1 << 15)


def _ratios(group: Group, known: dict) -> Iterator[tuple[int, int]]:
    """Held-out runs, counted by their buckets and by the ratios of their estimates in quarter powers of two, all in one number."""
    if not (group.roles == HELD).any():
        return
    held = np.flatnonzero(group.own_runs[HELD])
    at = group.runs[1][held]
    un, pn, vn, wn = group.contexts(at, group.all_words[0][LEARNED], group.all_pairs[0][LEARNED])
    low = _by_class(group.cells(known["classes"]), at, wn, known)
    keys = _bucket_of(un) * BUCKETS + _bucket_of(vn)
    for count, context in ((group.all_runs[LEARNED, held], un), (pn, vn)):
        with np.errstate(divide="ignore"):
            ratio = np.round(4 * np.log2(count / np.maximum(context, 1) / low))
        keys = (keys << 16) + (np.where(count > 0, ratio, NEVER).astype(np.int64) - NEVER)
    kinds, of = np.unique(keys, return_inverse=True)
    yield from zip(kinds.tolist(), np.bincount(of, group.own_runs[HELD, held]).astype(np.int64).tolist())


def learn(docs: DataFrame, apart: Column, settings: Settings = Settings()) -> dict:
    """A model of ``docs`` (doc_id, text); rows where ``apart`` holds set the weights, all rows the counts."""
    groups = stage_table(_groups_of(docs, F.when(apart, HELD).otherwise(LEARNED), settings, asks=False), "text-groups")
    return _learned(groups, _bytes(docs), settings)[0]


def _learned(groups: DataFrame, size: int, settings: Settings) -> tuple[dict, Exchange]:
    """The model of the groups, and their counts."""
    exchange, (top, total, distinct, kinds) = _counts(groups, size, settings.own, settings.shared)
    own = {token: i for i, (_, token) in enumerate(top)}
    classes = Classes(own, settings.own, settings.shared)
    learned, held = _class_pairs(exchange, classes)
    weights = mix_weights(learned, held, settings.steps)
    chance, learned_chance = (_chance(c, weights) for c in (learned + held, learned))
    sizes = np.ones(settings.classes)  # of each shared class: tokens and distinct tokens
    sizes[settings.own :] += kinds
    for n, token in top:
        sizes[classes.class_of(token)] -= 1 - n
    known = groups.sparkSession.sparkContext.broadcast({"classes": classes, "chance": learned_chance, "sizes": sizes})
    ratios = sorted(exchange.each(lambda group: _ratios(group, known.value)).reduceByKey(add).collect())  # few distinct ratios
    keys, times = np.array(ratios, np.int64).reshape(-1, 2).T
    b3, b2 = np.divmod(keys >> 32, BUCKETS)
    q3, q2 = ((keys >> k & 0xFFFF) + NEVER for k in (16, 0))
    estimates = [np.where(q == NEVER, 0, 2.0 ** (q / 4)) for q in (q3, q2)]
    found = run_weights(b3, b2, np.stack([*estimates, np.ones(len(times))], axis=1), times, settings.steps)
    model = {"groups": groups, "bytes": size, "own": own, "total": total, "distinct": distinct, "chance": chance, "sizes": sizes, "settings": settings, "run_weights": found}
    return model, exchange


#: Runs whose chances are worked out at once, so that memory follows these, not the group.
SCORES = 1 << 16


def _scored(group: Group, known: dict) -> Iterator[tuple]:
    """A row for each text of a group."""
    if not group.row["asks"]:
        return
    words, pairs, runs = (c.sum(axis=0) for c in (group.all_words[0], group.all_pairs[0], group.all_runs))
    cells, logs = group.cells(known["classes"]), np.empty(len(runs))
    for block in range(0, len(runs), SCORES):
        part = slice(block, block + SCORES)
        at = group.runs[1][part]
        un, pn, vn, wn = group.contexts(at, words, pairs)
        three, two, low = known["run_weights"][_bucket_of(un) * BUCKETS + _bucket_of(vn)].T
        logs[part] = np.log10(three * runs[part] / np.maximum(un, 1) + two * pn / np.maximum(vn, 1) + low * _by_class(cells, at, wn, known))
    sums = [np.add.reduceat(x, group.starts).tolist() for x in ((words > 0).astype(np.int64)[group.ids], np.log10((words + 1) / known["scale"])[group.ids], logs[group.runs[2]])]
    for doc, n, seen, base, score_ in zip(group.row["doc_ids"], group.lengths.tolist(), *sums):
        yield doc, n, seen, known["total"], base, score_


def _scores(exchange: Exchange, model: dict, schema) -> DataFrame:
    groups, settings = model["groups"], model["settings"]
    spark = groups.sparkSession
    sent = {k: model[k] for k in ("chance", "sizes", "total", "run_weights")}
    sent |= {"classes": Classes(model["own"], settings.own, settings.shared), "scale": model["total"] + model["distinct"] + 1}
    known = spark.sparkContext.broadcast(sent)
    columns = "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    id_type = schema["doc_id"].dataType.simpleString()
    return spark.createDataFrame(exchange.each(lambda group: _scored(group, known.value)), f"doc_id {id_type}, {columns}")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the base-10 logarithm of the model's probability of the whole text with its end, ``base_score`` that of
    single tokens smoothed by one. A missing or empty text has its end alone; repeated rows each have a score; an empty
    table gives an empty one, and an empty corpus a model of equal shares; other columns are left out. The texts meet the
    groups of the corpus; where both are one table, `learn_and_score` has each text once.
    """
    settings: Settings = model["settings"]
    groups = _groups_of(docs, F.lit(SCORED), settings)
    learned = model["groups"].withColumn("doc_ids", F.lit(None).cast(groups.schema["doc_ids"].dataType))
    exchange, _ = _counts(learned.unionByName(groups), model["bytes"] + _bytes(docs), settings.own, settings.shared)
    return _scores(exchange, model, docs.schema)


def learn_and_score(docs: DataFrame, learned: Column, apart: Column, settings: Settings = Settings()) -> DataFrame:
    """`score` of all ``docs`` by the model of those where ``learned`` holds; of these, rows where ``apart`` holds set the weights.

    Texts are read once, unless an executor is lost: then its part is read again and must give the same rows in the same
    order, as files do, or the run fails. Where rows may differ, write them first.
    """
    groups = _groups_of(docs, F.when(learned, F.when(apart, HELD).otherwise(LEARNED)).otherwise(SCORED), settings)
    model, exchange = _learned(groups, _bytes(docs), settings)
    return _scores(exchange, model, docs.schema)
