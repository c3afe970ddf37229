"""Byte-level BPE: texts to token ids and back, by a vocabulary of ranked byte strings.

Merges run through a queue of ranks: a bucket for each rank holds the places where that merge starts, a bitmap in three
levels marks ranks with filled buckets, and find-first-set on it gives the next rank. Places are nodes of linked lists; an
entry whose pair has changed meanwhile is stale and is skipped. A merge costs the same however long the pre-token is, so
megabytes without a space are no special case, and many short pre-tokens share one run of the queue, each with a list of
its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .frames import for_long_texts, ship, small_batches

ship(__name__)

#: Encoded chunks and pre-tokens in one generation of a worker's memory, the longest of them, the characters of a long
#: text handled at once, and those of several texts handled together.
CHUNKS, TOKENS, REMEMBERED_CHARS, PIECE, TOGETHER = 1 << 16, 1 << 17, 48, 1 << 20, 1 << 17


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 string and a number on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankQueue:
    """Places by rank: the smallest rank first; who drains a bucket sorts it, to take the leftmost place first."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.high = 0  # a bit for each word of the middle level; Python integers have no width to exceed

    def open(self, rank: int, places: list[int]) -> None:
        """Start a bucket; more places are appended to it in any order."""
        self.buckets[rank] = places
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.middle[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.high |= 1 << (rank >> 12)

    def first(self) -> int:
        """The smallest rank with a place; -1 if there is none."""
        if not self.high:
            return -1
        top = (self.high & -self.high).bit_length() - 1
        word = self.middle[top]
        word = (top << 6) + (word & -word).bit_length() - 1
        bits = self.low[word]
        return (word << 6) + (bits & -bits).bit_length() - 1

    def close(self, rank: int) -> None:
        """Take an emptied bucket away."""
        del self.buckets[rank]
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.middle[rank >> 12] &= ~(1 << ((rank >> 6) & 63))
            if not self.middle[rank >> 12]:
                self.high &= ~(1 << (rank >> 12))


class Vocabulary:
    """Ranks, which are the ids, and for each pair of ids the id of the two together, if there is one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.shift = max(ranks.values()).bit_length()
        self.pairs = {
            (ranks[token[:i]] << self.shift) | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)])
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)])
        self.queue = RankQueue(1 << self.shift)
        lengths = np.zeros(1 << self.shift, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        back = {rank: token for token, rank in ranks.items()}
        self.joined = np.frombuffer(b"".join(back[r] for r in sorted(back)), np.uint8)

    def encode(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(tokens)
        whole, open_ = self.ranks.get, []
        for i, token in enumerate(tokens):
            rank = whole(token)
            if rank is None:
                open_.append(i)
            else:
                out[i] = rank.to_bytes(4, "little")
        if open_:
            some = [tokens[i] for i in open_]
            ids = self._merge(some)
            starts = ids >= 0
            packed = ids[starts].astype("<u4").tobytes()
            ends = 4 * np.cumsum(starts)[np.cumsum([len(token) for token in some]) - 1]
            at = 0
            for i, end in zip(open_, ends.tolist()):
                out[i] = packed[at:end]
                at = end
        return out

    def _merge(self, tokens: list[bytes]) -> np.ndarray:
        """Ids at the places where they start, -1 at all others, of the tokens one after another."""
        shift, get, queue = self.shift, self.pairs.get, self.queue
        buckets = queue.buckets
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        n = len(raw)
        ends = np.cumsum([len(token) for token in tokens])
        links = np.arange(1, n + 1)
        links[ends - 1] = -1
        after = links.tolist()
        links = np.arange(-1, n - 1)
        links[0], links[ends[:-1]] = -1, -1
        before = links.tolist()
        current = self.bytes[raw].tolist()
        ranks = np.full(n, -1)
        ranks[:-1] = self.byte_pairs[raw[:-1].astype(np.int64) * 256 + raw[1:]]
        ranks[ends - 1] = -1
        order = np.argsort(ranks, kind="stable")[np.count_nonzero(ranks < 0) :]
        filled, firsts = np.unique(ranks[order], return_index=True)
        for rank, places in zip(filled.tolist(), np.split(order, firsts[1:])):
            queue.open(rank, places.tolist())
        while (rank := queue.first()) >= 0:
            bucket, lower = buckets[rank], False
            bucket.sort(reverse=True)
            while bucket and not lower:
                i = bucket.pop()
                j = after[i]
                if j < 0 or current[i] < 0 or get((current[i] << shift) | current[j]) != rank:
                    continue  # stale: one of the two has grown since
                current[i], current[j] = rank, -1
                k = after[i] = after[j]
                h = before[i]
                if k >= 0:
                    before[k] = i
                    new = get((rank << shift) | current[k])
                    if new is not None:
                        lower = new < rank
                        if new in buckets:
                            buckets[new].append(i)
                        else:
                            queue.open(new, [i])
                if h >= 0:
                    new = get((current[h] << shift) | rank)
                    if new is not None:
                        lower = lower or new < rank
                        if new in buckets:
                            buckets[new].append(h)
                        else:
                            queue.open(new, [h])
            if not bucket:
                queue.close(rank)
        return np.array(current, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.joined[shift + np.arange(len(shift))].tobytes()


#: A space after white space; a place where a space follows something else; white space that follows something else.
_ODD, _SPACE, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )"), re.compile(r"(?<=\S)\s")


def _pieces(text: str) -> Iterator[str]:
    """A long text cut where white space follows something else; no pre-token crosses such a place."""
    at = 0
    while len(text) - at > PIECE:
        cut = _CUT.search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Memory:
    """Ids of strings in two generations; a full young one takes the place of the old one, where all that was not met since is forgotten."""

    def __init__(self, most: int):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.most = most

    def find(self, wanted: set[str]) -> tuple[dict[str, bytes], list[str]]:
        """What is remembered, and the strings that are not."""
        young, old = self.young, self.old
        found, missing = {}, []
        for key in wanted:
            ids = young.get(key)
            if ids is None:
                ids = old.pop(key, None)
                if ids is None:
                    missing.append(key)
                    continue
                young[key] = ids
            found[key] = ids
        return found, missing

    def add(self, new: dict[str, bytes]) -> None:
        self.young.update((k, v) for k, v in new.items() if len(k) <= REMEMBERED_CHARS)
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}


class Coder:
    """Encodes texts with a vocabulary, remembering what it has encoded.

    A text falls into chunks before each space that follows something else, where no pre-token goes across. Chunks and
    pre-tokens seen before are looked up; new ones of several texts are encoded in one run.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern).findall
        self.chunks, self.tokens = Memory(CHUNKS), Memory(TOKENS)  # chunks without the space in front

    def encode(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        starts, rest = [], []
        for piece in pieces:
            if _ODD.search(piece):
                start, *chunks = _SPACE.split(piece)
                chunks = [c[1:] for c in chunks]
            else:
                start, *chunks = piece.split(" ")
            starts.append(self.split(start))
            rest.append(chunks)
        held, missing = self.chunks.find(set().union(*rest))
        split = {c: self.split(" " + c) for c in missing}
        known, new = self.tokens.find(set().union(*starts, *split.values()))
        coded = dict(zip(new, self.vocabulary.encode([t.encode("utf-8", "surrogatepass") for t in new])))
        known.update(coded)
        token, chunk = known.__getitem__, held.__getitem__
        fresh = {c: b"".join(map(token, tokens)) for c, tokens in split.items()}
        held.update(fresh)
        out = [b"".join([*map(token, s), *map(chunk, chunks)]) for s, chunks in zip(starts, rest)]
        self.tokens.add(coded)
        self.chunks.add(fresh)
        return out


def _grouped(texts: pa.Array) -> Iterator[list[tuple[int, str]]]:
    """Pieces of texts with the number of their text, so many that they have about ``TOGETHER`` characters."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text.as_py() or ""):
            group.append((i, piece))
            size += len(piece)
            if size >= TOGETHER:
                yield group
                group, size = [], 0
    if group:
        yield group


def _coded(batches, state, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    held = state.value  # one object for each worker, so what one task remembers serves the next
    if "coder" not in held:
        held["coder"] = Coder(held["ranks"], pattern)
    coder = held["coder"]
    for batch in small_batches(batches, 1024):
        n = len(batch)
        hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in range(n)]
        counts, ids = [0] * n, [[] for _ in range(n)]
        for group in _grouped(batch.column("text")):
            for (i, _), got in zip(group, coder.encode([piece for _, piece in group])):
                numbers = np.frombuffer(got, "<u4")
                counts[i] += len(numbers)
                hashes[i][0].update(got)
                hashes[i][1].update(coder.vocabulary.decode(numbers))
                if with_ids:
                    ids[i].extend(numbers.tolist())
        columns = [
            batch.column("doc_id"),
            pa.array(counts, pa.int64()),
            *(pa.array([h[k].hexdigest() for h in hashes], pa.string()) for k in (0, 1)),
        ]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.record_batch(columns, names)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if wanted.

    Whole texts are encoded, each match of ``pattern`` by itself and without special tokens, and the ids are decoded
    again. Hashes are of the ids as little-endian unsigned 32-bit integers and of the decoded bytes. A missing or empty
    text has no ids; repeated rows each have a result; an empty table gives an empty one; other columns are left out. The
    vocabulary (its size is that of the file) is sent to each executor once.
    """
    for_long_texts(docs.sparkSession)
    given = docs.select("doc_id", "text")
    state = docs.sparkSession.sparkContext.broadcast({"ranks": load_ranks(ranks_path)})
    id_type = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return given.mapInArrow(lambda batches: _coded(batches, state, pattern, with_ids), schema)

