"""Ranked search by terms in a length-stratified index.

A document's score for an item is the sum of ``w * impact`` over the item's terms, where the impact depends only on how
often the term occurs (tf) and on the document's length through its normaliser m. Documents with equal m make a stratum:
within it postings are grouped by term and tf, so an impact is computed once per tf, and the largest tf of each term gives
a bound on any score in the stratum. Each task visits its strata in order of their bounds and leaves out those whose bound
is below the k-th best score an item has there already; results of all tasks are then ranked together.

A stratum of many documents is stored in several *units* of bounded size, spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .frames import for_long_texts, ship, small_batches
from .word_codes import word_codes

ship(__name__)

#: Documents and postings of a unit, scores computed at once, terms an index may be limited to, and terms of the items
#: that one pass answers.
UNIT_DOCS, UNIT_POSTINGS, AT_ONCE, VOCABULARY, PASS_TERMS = 1 << 14, 1 << 20, 1 << 22, 1 << 20, 1 << 21
_TERM_BYTES = np.full(256, 32, np.uint8)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _TERM_BYTES[_low:_high] = np.arange(_low, _high)


@dataclass(frozen=True)
class Index:
    """Written strata, term frequencies over documents, and the two totals scores need."""

    units: DataFrame
    frequencies: DataFrame
    documents: int
    terms: int


def term_codes(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """As ``word_codes``; terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z read as a-z."""
    wide = texts.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.empty(0, np.uint8)
    parts = [None, pa.py_buffer((edges - edges[0]).tobytes()), pa.py_buffer(_TERM_BYTES[raw].tobytes())]
    yield from word_codes(pa.Array.from_buffers(pa.large_string(), len(wide), parts))


def _ragged(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """Lists of the values of rows 0 to n - 1; rows come in order."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _counted(batches, key: str, wanted) -> Iterator[pa.RecordBatch]:
    """For each text: number of terms, and the distinct ones, or those that are wanted, with their counts."""
    vocabulary = None if wanted is None else wanted.value
    for batch in small_batches(batches):
        at = 0
        for group in term_codes(batch.column("text")):
            sizes = np.array([len(g) for g in group])
            codes = np.concatenate(group).view(np.int64)
            rows = np.repeat(np.arange(len(group)), sizes)
            known = np.unique(codes) if vocabulary is None else vocabulary
            place = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            hit = known[place] == codes if len(known) else np.zeros(len(codes), bool)
            both, counts = np.unique(rows[hit] * max(len(known), 1) + place[hit], return_counts=True)
            rows, terms = both // max(len(known), 1), known[both % max(len(known), 1)]
            lists = [_ragged(terms, rows, len(group), pa.int64()), _ragged(counts, rows, len(group), pa.int32())]
            yield pa.record_batch([batch.column(key).slice(at, len(group)), pa.array(sizes, pa.int64()), *lists], [key, "n", "terms", "tfs"])
            at += len(group)


def count_terms(rows: DataFrame, key: str, wanted=None) -> DataFrame:
    """key, n, terms, tfs of each row's text."""
    for_long_texts(rows.sparkSession)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, n long, terms array<long>, tfs array<int>"
    return rows.select(key, "text").mapInArrow(lambda it: _counted(it, key, wanted), schema)


def _impact(tf: np.ndarray, m: int) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


UNIT = "m long, docs array<{id}>, terms array<long>, term_ends array<int>, tfs array<int>, tf_ends array<int>, postings array<int>"


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists, and the length of each."""
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _built(batches, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Units of the documents of a task, which come in order of m."""
    held: list[pa.RecordBatch] = []
    docs = postings = 0

    def unit(m: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        terms, sizes = _flat(table.column("terms"))
        tfs, _ = _flat(table.column("tfs"))
        doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.lexsort((doc, -tfs, terms))
        terms, tfs, doc = terms[order], tfs[order], doc[order]
        new_term = np.ones(len(terms), bool)
        new_term[1:] = terms[1:] != terms[:-1]
        new_tf = new_term.copy()
        new_tf[1:] |= tfs[1:] != tfs[:-1]
        groups = np.flatnonzero(new_tf)
        term_ends = np.append(np.flatnonzero(new_term[groups])[1:], len(groups)) if len(groups) else groups
        tf_ends = np.append(groups[1:], len(terms)) if len(groups) else groups
        one = lambda x, kind: pa.array([x], pa.list_(kind))
        ids = table.column("doc_id")
        whole = [
            pa.array([m], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            one(terms[new_term], pa.int64()),
            *(one(x, pa.int32()) for x in (term_ends, tfs[groups], tf_ends, doc)),
        ]
        held.clear()
        return pa.record_batch(whole, names)

    m = None
    for batch in small_batches(batches):
        ms = batch.column("m").to_numpy()
        sizes = np.diff(batch.column("terms").offsets.to_numpy())
        start = 0
        for i in range(len(batch)):
            full = docs >= UNIT_DOCS or (docs and postings + sizes[i] > UNIT_POSTINGS)
            if docs and (ms[i] != m or full):
                if i > start:
                    held.append(batch.slice(start, i - start))
                yield unit(int(m))
                start, docs, postings = i, 0, 0
            m = ms[i]
            docs += 1
            postings += sizes[i]
        held.append(batch.slice(start))
    if docs:
        yield unit(int(m))


def build_index(docs: DataFrame, wanted: np.ndarray | None = None) -> Index:
    """The index of all documents (doc_id, text), of all their terms or of those in ``wanted``, sorted 64-bit codes.

    Documents without terms are not part of it, missing texts included; repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    sent = None if wanted is None else spark.sparkContext.broadcast(wanted)
    counted = count_terms(docs, "doc_id", sent).where("n > 0").withColumn("row", F.monotonically_increasing_id())
    counted = stage_table(counted, "term-counts")  # with the row numbers, so that these stay
    documents, terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = stage_table(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")), "term-frequencies")
    m = F.expr(f"50 + (50 * n * {documents}L) div {terms}L" if terms else "50L")
    dealt = counted.select(m.alias("m"), "row", "doc_id", "terms", "tfs").repartitionByRange("m", "row").sortWithinPartitions("m", "row")
    schema = UNIT.format(id=docs.schema["doc_id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]
    units = stage_table(dealt.mapInArrow(lambda it: _built(it, names), schema), "strata")
    return Index(units, frequencies, documents, terms)


@dataclass
class Items:
    """Items of one pass: for each entry its item, its term (a place in ``terms``) and the term's weight."""

    terms: np.ndarray
    item: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    n: int

    def __post_init__(self):
        self.ends = np.searchsorted(self.item, np.arange(self.n), "right")
        # below this, sums of doubles are exact
        self.exact = np.bincount(self.item, self.weight, self.n).max(initial=0) * 1e6 < 2**53

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.ends] - total[np.concatenate([[0], self.ends[:-1]])]


def _places(items: Items, terms: np.ndarray) -> np.ndarray:
    """For each term of the items its place among the terms of a unit, or -1."""
    if not len(terms):
        return np.full(len(items.terms), -1)
    at = np.minimum(np.searchsorted(terms, items.terms), len(terms) - 1)
    return np.where(terms[at] == items.terms, at, -1)


def _bounded(batches, sent, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Units with a bound for each item, and with the sum of the bounds."""
    items: Items = sent.value
    for batch in small_batches(batches, 64):
        bounds = []
        for m, terms, ends, tfs in zip(*(batch.column(c) for c in ("m", "terms", "term_ends", "tfs"))):
            terms, ends, tfs = (x.values.to_numpy() for x in (terms, ends, tfs))
            largest = _impact(tfs[np.concatenate([[0], ends[:-1]])], m.as_py()) if len(terms) else np.empty(0, np.int64)
            at = _places(items, terms)[items.term]
            bounds.append(items.sums(np.where(at >= 0, items.weight * np.append(largest, 0)[at], 0)))
        more = [pa.array([int(b.sum()) for b in bounds], pa.int64()), pa.array(bounds, pa.list_(pa.int64()))]
        yield pa.record_batch([*(batch.column(c) for c in names[:-2]), *more], names)


class Best:
    """The k best of each item so far: highest score first, then smallest id, missing ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.threshold = k, np.ones(n, np.int64)
        self.kept: list[np.ndarray] | None = None

    def add(self, item, score, missing, ids) -> None:
        rows = [item, score, missing, ids]
        if self.kept is not None:
            rows = [np.concatenate(both) for both in zip(self.kept, rows)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [r[order] for r in rows]
        heads = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1]]))
        rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
        self.kept = [r[rank < self.k] for r in rows]
        last = rank == self.k - 1
        self.threshold[rows[0][last]] = rows[1][last]


def _scores(items: Items, chosen: np.ndarray, at: np.ndarray, firsts, lasts, postings, impacts, docs: int) -> np.ndarray:
    """Scores of all documents of a unit for the chosen items."""
    number = np.full(items.n, -1)
    number[chosen] = np.arange(len(chosen))
    entry = np.flatnonzero((number[items.item] >= 0) & (at[items.term] >= 0))
    total = np.zeros(len(chosen) * docs, np.int64)
    place = at[items.term[entry]]
    sizes = lasts[place] - firsts[place]
    upto = np.cumsum(sizes)
    step = max(1, AT_ONCE // max(int(sizes.max(initial=0)), 1))
    for low in range(0, len(entry), step):
        part = slice(low, low + step)
        size, end = sizes[part], upto[part]
        if not size.sum():
            continue
        flat = np.arange(end[0] - size[0], end[-1]) + np.repeat(firsts[place[part]] - (end - size), size)
        key = np.repeat(number[items.item[entry[part]]] * docs, size) + postings[flat]
        value = np.repeat(items.weight[entry[part]], size) * impacts[flat]
        if items.exact:
            total += np.bincount(key, value, len(total)).astype(np.int64)
        else:
            np.add.at(total, key, value)
    return total.reshape(len(chosen), docs)


def _searched(batches, sent, k: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A task's best documents of each item; its units come in order of their bounds."""
    items: Items = sent.value
    best = Best(items.n, k)
    for batch in small_batches(batches, 16):
        columns = (batch.column(c) for c in ("m", "docs", "terms", "term_ends", "tfs", "tf_ends", "postings", "bounds"))
        for m, docs, *lists in zip(*columns):
            terms, term_ends, tfs, tf_ends, postings, bounds = (x.values.to_numpy() for x in lists)
            live = np.flatnonzero((bounds >= best.threshold) & (bounds > 0))
            if not len(live):
                continue
            ids = docs.values
            missing = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0 if pa.types.is_integer(id_type) else "").to_numpy(zero_copy_only=False)
            ids = ids.astype(str) if ids.dtype == object else ids
            impacts = np.repeat(_impact(tfs, m.as_py()), np.diff(tf_ends, prepend=0))
            lasts = tf_ends[term_ends - 1].astype(np.int64)
            firsts = np.concatenate([[0], lasts[:-1]])
            at = _places(items, terms)
            step = max(1, AT_ONCE // len(ids))
            for low in range(0, len(live), step):
                chosen = live[low : low + step]
                scores = _scores(items, chosen, at, firsts, lasts, postings, impacts, len(ids))
                least = best.threshold[chosen]
                if len(ids) > k:
                    least = np.maximum(least, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
                item, doc = np.nonzero(scores >= least[:, None])
                if len(item):
                    best.add(chosen[item], scores[item, doc], missing[doc], ids[doc])
    if best.kept is not None:
        item, score, missing, ids = best.kept
        found = pa.array(ids, mask=missing).cast(id_type)
        yield pa.record_batch([pa.array(item, pa.int64()), found, pa.array(score, pa.int64())], ["number", "doc_id", "score"])


def _pass(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """item, rank, doc_id and score for items (item, terms), a written table of so many that their terms fit a worker."""
    spark: SparkSession = asked.sparkSession
    entries = asked.select("item", F.explode("terms").alias("term"))
    known = index.frequencies.join(F.broadcast(entries.select("term").distinct()), "term").orderBy("term").toArrow()
    terms, df = (known.column(c).to_numpy() for c in ("term", "df"))
    weights = np.floor(1000 * np.log((2 * index.documents + 2) / (2 * df + 1))).astype(np.int64)
    given = entries.orderBy("item", "term").toArrow()
    item, term = (given.column(c).to_numpy() for c in ("item", "term"))
    names = np.unique(item)
    at = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
    hit = terms[at] == term if len(terms) else np.zeros(len(term), bool)
    items = Items(terms, np.searchsorted(names, item[hit]), at[hit], weights[at[hit]] if len(terms) else at[hit], len(names))
    sent, sent_names = spark.sparkContext.broadcast(items), spark.sparkContext.broadcast(names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.units.schema) + ", priority long, bounds array<long>"
    columns = [*index.units.columns, "priority", "bounds"]
    bounded = index.units.mapInArrow(lambda it: _bounded(it, sent, columns), schema).sortWithinPartitions(F.desc("priority"))
    ids = index.units.schema["docs"].dataType.elementType
    kind = pa.string() if ids.typeName() == "string" else pa.int64()
    found = bounded.mapInArrow(lambda it: _named(_searched(it, sent, k, kind), sent_names), f"item long, doc_id {'string' if kind == pa.string() else 'long'}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").isNull(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item", "rank", F.col("doc_id").cast(ids).alias("doc_id"), "score")


def _named(batches, names) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item = pa.array(names.value[batch.column("number").to_numpy()])
        yield pa.record_batch([item, batch.column("doc_id"), batch.column("score")], ["item", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, k: int = 50, index: Index | None = None) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score.

    ``items`` has item_id and text; each of its rows is answered by itself, repeated ones again. Documents score by the
    item's distinct terms; only scores above 0 count, so an item without terms, or a missing text on either side, has no
    rows. Equal scores go by doc_id (whole numbers or text), missing ids last; ranks are unique. Empty tables give no rows; other columns
    are left out. Without ``index`` one is built for the items' terms, or for all terms where items have more than
    ``VOCABULARY``. Items are answered in passes of about ``PASS_TERMS`` terms. Terms are compared as 64-bit codes.
    """
    asked = count_terms(items, "item_id").withColumn("item", F.monotonically_increasing_id())
    asked = stage_table(asked.select("item", "item_id", "terms"), "items")
    if index is None:
        vocabulary = stage_table(asked.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
        few = vocabulary.count() <= VOCABULARY
        index = build_index(docs, np.sort(vocabulary.toArrow().column("term").to_numpy()) if few else None)
    passes = max(1, -(-asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0] // PASS_TERMS))
    found = [_pass(index, asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == i).select("item", "terms"), k) for i in range(passes)]
    return reduce(DataFrame.unionByName, found).join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
