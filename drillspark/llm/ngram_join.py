"""Exact Jaccard join on word shingles by grouped prefixes, and the classes of linked documents.

Texts with the same shingles collapse into one representative. A representative's *prefix* holds its rarest shingles, so
many that two sets which are similar enough must share one; representatives with the same prefix and size collapse into
one group. Group pairs that share a prefix shingle and pass the length and position bounds are expanded into member
pairs, whose whole shingle sets are compared.

Only the classes are wanted, so a pair whose members are already linked through others is not compared again: a round
compares every member of a list with one of a few leaders of it, then joins classes; the next one compares an eighth of the
pairs that are left across classes, and the last one all that are still left. No pair of different classes is ever skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import join_on
from ..session import stage_table
from .components import min_labels
from .frames import for_long_texts, if_small, ship, small_batches, without
from .word_codes import shingles, word_codes

ship(__name__)


#: Least bits of the parity of a set: each shingle turns one bit round. Two sets differ in at least as many shingles as
#: bits. Larger sets have a fine parity with a bit for each shingle at least, which folds to this and to 64 bits (a hint).
PARITY = 512


@dataclass(frozen=True)
class Join:
    """``percent`` similarity or more links; ``common`` bounds the broadcast list of the most frequent shingles."""

    size: int = 4
    percent: int = 85
    common: int = 1 << 19
    buffered: int = 1 << 20
    leaders: int = 3
    rounds: int = 1
    thin: int = 8


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for group in word_codes(texts):
        for codes in group:
            yield shingles(codes, size)


def _frequent(texts: Iterator[pa.RecordBatch], size: int, buffered: int) -> Iterator[pa.RecordBatch]:
    """Shingles that occur more than once among the texts of a task, counted over a bounded buffer."""
    held: list[np.ndarray] = []

    def counted():
        values, times = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        some = times > 1
        return pa.record_batch([pa.array(values[some].view(np.int64)), pa.array(times[some])], ["shingle", "n"])

    total = 0
    for batch in small_batches(texts):
        for found in shingle_sets(batch.column(0), size):
            held.append(found)
            total += len(found)
            if total >= buffered:
                yield counted()
                total = 0
    if held:
        yield counted()


def common_shingles(docs: DataFrame, join: Join) -> tuple[np.ndarray, np.ndarray]:
    """The at most ``common`` most frequent shingles, sorted, and how often they occur.

    They only order shingles: any order common to all documents gives the same links. A shingle left out here counts as
    rare; it occurs at most once in each buffer, or less often than all that are listed.
    """
    counted = docs.select("text").mapInArrow(lambda it: _frequent(it, join.size, join.buffered), "shingle long, n long")
    totals = counted.groupBy("shingle").agg(F.sum("n").alias("n"))
    top = totals.orderBy(F.desc("n"), "shingle").limit(join.common).toArrow()
    shingles, n = (top.column(c).to_numpy() for c in ("shingle", "n"))
    order = np.argsort(shingles.view(np.uint64))
    return shingles.view(np.uint64)[order], n[order]


def parity_words(found: np.ndarray) -> np.ndarray:
    """The fine parity of a set, in words of 64 bits; a power of two of bits, ``PARITY`` and ``len(found)`` at least."""
    bits = max(PARITY, 1 << max(len(found) - 1, 0).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _prefixes(batches, join: Join, common) -> Iterator[pa.RecordBatch]:
    """For each text: size of its set, a 128-bit name of the set, its rarest shingles in order, and a name of these."""
    shingles, times = common.value
    for batch in small_batches(batches):
        sizes, names, prefixes, prefix_names, fine = [], [], [], [], []
        for found in shingle_sets(batch.column("text"), join.size):
            n = len(found)
            at = np.searchsorted(shingles, found)
            known = at < len(shingles)
            known[known] = shingles[at[known]] == found[known]
            rank = np.zeros(n, np.int64)
            rank[known] = times[at[known]]
            length = n - (-(-join.percent * n // 100)) + 1 if n else 0
            prefix = found[rank == 0][:length]
            if len(prefix) < length:
                prefix = found[np.argsort(rank, kind="stable")[:length]]  # equally frequent ones in order of their code
            sizes.append(n)
            names.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
            prefixes.append(prefix.view(np.int64))
            fine.append(parity_words(found))
            prefix_names.append(xxhash.xxh3_128_hexdigest(prefix.tobytes()))
        parities = [np.bitwise_xor.reduce(f.reshape(-1, PARITY // 64), axis=0) for f in fine]
        yield pa.record_batch(
            [
                batch.column("doc_id"),
                batch.column("text_key"),
                pa.array(sizes, pa.int32()),
                pa.array(names, pa.string()),
                _lists(prefixes),
                pa.array(prefix_names, pa.string()),
                _lists(parities),
                _lists(fine),
            ],
            ["doc_id", "text_key", "n", "name", "prefix", "prefix_name", "parity", "fine"],
        )


def _sets(batches, size: int) -> Iterator[pa.RecordBatch]:
    """The whole sets of texts that have the set that was asked for."""
    for batch in small_batches(batches):
        rows, items = [], []
        for row, name, found in zip(batch.column("row"), batch.column("name"), shingle_sets(batch.column("text"), size)):
            if xxhash.xxh3_128_hexdigest(found.tobytes()) == name.as_py():
                rows.append(row.as_py())
                items.append(found.view(np.int64))
        yield pa.record_batch([pa.array(rows, pa.int64()), _lists(items)], ["row", "items"])


def _whole_sets(given: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """row and items, once for each row of ``wanted`` (row, doc_id, name), from the texts."""
    asked = wanted.select("row", "name", F.col("doc_id").alias("wanted"))
    texts = given.join(if_small(asked), F.col("doc_id").eqNullSafe(F.col("wanted"))).select("row", "name", "text")
    whole = texts.mapInArrow(lambda it: _sets(it, join.size), "row long, items array<long>")
    whole = stage_table(whole, "whole-sets")
    if whole.count() > wanted.count():  # rows that repeat one another in doc_id and text
        whole = stage_table(whole.dropDuplicates(["row"]), "whole-sets")
    return whole


def _alike(pairs: DataFrame, parities: DataFrame, join: Join) -> DataFrame:
    """The pairs whose parities differ in no more bits than their sets may differ in shingles; none that links is lost."""
    sides = [parities.select(*[F.col(c).alias(f"{c}_{s}" if c != "row" else s) for c in parities.columns]) for s in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    return met.where(_parities_allow(join)).select("a", "b")


def _few_differ(differ, join: Join):
    """Whether sets that differ in at least so many shingles can still be similar enough."""
    # 100 * o >= percent * u with n_a + n_b = u + o: u - o <= (100 - percent) / (100 + percent) * (n_a + n_b)
    return (100 + join.percent) * differ <= (100 - join.percent) * (F.col("n_a") + F.col("n_b")).cast("long")


def _alike_in_detail(pairs: DataFrame, described: DataFrame, join: Join) -> DataFrame:
    """Of the pairs, a written table, those that their fine parities allow; a longer one is folded to half its length.

    A few hundredths of the size of the sets, so that sets travel for hardly any pair but those that link.
    """
    asked = if_small(pairs)
    sides = [
        described.join(asked, described["row"] == asked[s]).select("a", "b", F.col("n").alias(f"n_{s}"), F.col("fine").alias(f"fine_{s}"))
        for s in "ab"
    ]
    half = lambda x, k: F.slice(x, 1 + k * F.floor(F.size(x) / 2).cast("int"), F.floor(F.size(x) / 2).cast("int"))
    xor = lambda x, y: x.bitwiseXOR(y)
    fold = lambda x, other: F.when(F.size(x) > F.size(other), F.zip_with(half(x, 0), half(x, 1), xor)).otherwise(x)
    a, b = F.col("fine_a"), F.col("fine_b")
    met = sides[0].join(sides[1], ["a", "b"]).withColumns({"fold_a": fold(a, b), "fold_b": fold(b, a)})
    differ = F.aggregate(F.zip_with("fold_a", "fold_b", xor), F.lit(0), lambda n, word: n + F.bit_count(word))
    return met.where((F.size("fold_a") != F.size("fold_b")) | _few_differ(differ, join)).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b), a written table, whose sets are similar enough, by their whole sets."""
    asked = if_small(pairs)
    left = sets.join(asked, sets["row"] == asked["a"]).select("a", "b", F.col("items").alias("items_a"))
    right = sets.join(asked, sets["row"] == asked["b"]).select("a", "b", F.col("items").alias("items_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - both
    return left.join(right, ["a", "b"]).where(100 * both.cast("long") >= join.percent * union).select("a", "b")


def _can_match(join: Join):
    """Length bound, position bound (what follows the shared shingle on both sides must suffice) and the bound of hints.

    A pair meets at each shingle that both prefixes hold. At the first of them, in the order of all shingles, nothing before
    is shared, so there the bound holds for every pair that links; it need not hold where the pair meets again.
    """
    small, large = F.least("n_a", "n_b").cast("long"), F.greatest("n_a", "n_b").cast("long")
    # 100 * o >= percent * (n_a + n_b - o)  <=>  (100 + percent) * o >= percent * (n_a + n_b)
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (100 * small >= join.percent * large) & ((100 + join.percent) * most >= join.percent * (small + large))
    return fits & _few_differ(F.bit_count(F.col("hint_a").bitwiseXOR(F.col("hint_b"))), join)


def linked(docs: DataFrame, join: Join = Join(), with_key: bool = False) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable by links, the document itself included. Missing and empty texts
    have no shingles and no links; repeated rows are linked as equal texts are, each with a result of its own; a class
    without any doc_id has none as its name; an empty table gives an empty one; other columns are left out. ``with_key``
    adds the MD5 of the text as text_key.
    """
    spark = docs.sparkSession
    for_long_texts(spark)
    given = docs.select("doc_id", "text")
    common = spark.sparkContext.broadcast(common_shingles(given, join))
    id_type = given.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, text_key string, n int, name string, prefix array<long>, prefix_name string, parity array<long>, fine array<long>"
    keyed = given.withColumn("text_key", F.md5(F.coalesce("text", F.lit(""))) if with_key else F.lit(""))
    described = keyed.mapInArrow(lambda it: _prefixes(it, join, common), schema)
    # written together with the row numbers, so that these stay
    described = stage_table(described.withColumn("row", F.monotonically_increasing_id()), "prefixes")
    # the smallest row stands for all texts with the same set, then for all sets with the same prefix and size
    first = described.where("n > 0").groupBy("name").agg(F.min("row").alias("row")).select("row")
    first = if_small(stage_table(first, "distinct-sets"))
    sets = described.join(first, "row", "left_semi")
    groups = sets.groupBy("prefix_name", "n").agg(F.min("row").alias("grp"), F.count("*").alias("members"))
    members = sets.join(groups, ["prefix_name", "n"])
    members = stage_table(members.select("row", "doc_id", "name", "grp", "n", "members", "parity"), "prefix-groups")
    leads = stage_table(members.where("row = grp").select("row", F.least("members", F.lit(2)).alias("several")), "group-leads")
    entries = described.select("row", F.posexplode("prefix").alias("at", "shingle")).join(if_small(leads), "row")
    # lists of one set pair nothing
    shared = entries.groupBy("shingle").agg(F.sum("several").alias("listed")).where("listed > 1").select("shingle")
    lists = entries.select("shingle", F.col("row").alias("grp"), "at").join(shared, "shingle")
    lists = stage_table(lists, "prefix-lists")
    hint = reduce(lambda a, b: a.bitwiseXOR(b), [F.col("parity")[i] for i in range(PARITY // 64)])
    listed = lists.join(members.select("grp", "row", "n", hint.alias("hint")), "grp")  # expand groups into members
    listed = stage_table(listed.select("shingle", "row", "n", "at", "hint"), "prefix-members")
    needed = stage_table(listed.select("row").distinct(), "listed")
    whole = _whole_sets(given, stage_table(members.join(needed, "row").select("row", "doc_id", "name"), "wanted"), join)

    parities = members.join(needed, "row", "left_semi").select("row", "n", "parity")
    labels = needed.select("row", F.col("row").alias("label"))
    links, done = None, None
    for turn in range(join.rounds + 2):
        now = listed.join(if_small(labels), "row") if turn else listed.withColumn("label", F.col("row"))
        classes = now.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"))
        open_lists = classes.where("low < high").select("shingle")
        now = stage_table(now.join(open_lists, "shingle"), f"open-{turn}")
        pairs = _leader_pairs(now, join, turn) if turn < join.rounds else _all_pairs(now, parities, join, join.thin if turn == join.rounds else 1)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = stage_table(_alike(pairs, parities, join), f"pairs-{turn}")
        close = stage_table(_alike_in_detail(pairs, described, join), f"close-pairs-{turn}")
        found = stage_table(_similar(close, whole, join), f"links-{turn}")
        links = found if links is None else links.unionByName(found)
        done = pairs if done is None else done.unionByName(pairs)
        labels = stage_table(min_labels(links, needed), f"labels-{turn}")
    return _with_ids(described, labels, ["text_key"] if with_key else [])


def _leader_pairs(now: DataFrame, join: Join, turn: int) -> DataFrame:
    """Each member of a list with one leader of that list; lists draw their leaders in ``leaders`` different ways.

    Members that share many shingles meet the same few leaders on all of them, so pairs repeat and are counted once.
    """
    way = F.pmod(F.xxhash64("shingle", F.lit(turn)), F.lit(join.leaders))
    drawn = now.withColumn("way", way)
    key = F.struct(F.xxhash64("row", "way", F.lit(turn)).alias("draw"), "row", "n", "at", "label", "hint")
    leaders = drawn.groupBy("shingle").agg(F.min(key).alias("lead"))
    leaders = leaders.select("shingle", *[F.col(f"lead.{c}").alias(f"{c}_b") for c in ("row", "n", "at", "label", "hint")])
    sides = [F.col(c).alias(f"{c}_a") for c in ("row", "n", "at", "label", "hint")]
    met = drawn.select("shingle", *sides).join(leaders, "shingle")
    return _ordered_pairs(met.where((F.col("label_a") != F.col("label_b")) & _can_match(join)))


def _all_pairs(now: DataFrame, parities: DataFrame, join: Join, thin: int = 1) -> DataFrame:
    """The pairs of members of a list that are still in different classes and that their parities allow.

    With ``thin``, one of so many pairs only, drawn by their rows: in a crowd whose members are linked with many others these
    few links make one class already, and the round for all pairs that follows meets hardly any of its pairs again.

    A member with too much before the shared shingle, ``late``, cannot match another late one: what follows is too short for
    both. So lists are joined with their early members only, and the parity is tested where a pair is met, before it is a
    row: a crowd of texts that are alike, yet not enough, makes no rows.
    """
    columns = ["row", "n", "at", "label", "hint", "parity", "late"]
    # (100 + percent) * (n - at) < 2 * percent * n on both sides leaves min(n - at) below percent * (n_a + n_b) / (100 + percent)
    late = (100 + join.percent) * (F.col("n") - F.col("at")).cast("long") < 2 * join.percent * F.col("n")
    whole = stage_table(now.join(if_small(parities.select("row", "parity")), "row").withColumn("late", late), "open-members")
    sides = [whole.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in columns]) for s in "ab"]
    met = sides[0].where("NOT late_a").join(sides[1], "shingle")
    # two early members meet from both sides; one of the two is enough
    once = F.col("late_b") | (F.col("label_a") < F.col("label_b"))
    if thin > 1:
        once &= F.pmod(F.xxhash64(F.least("row_a", "row_b"), F.greatest("row_a", "row_b")), F.lit(thin)) == 0
    return _ordered_pairs(met.where(once & (F.col("label_a") != F.col("label_b")) & _can_match(join) & _parities_allow(join)))


def _parities_allow(join: Join):
    words = [F.bit_count(F.col("parity_a")[i].bitwiseXOR(F.col("parity_b")[i])) for i in range(PARITY // 64)]
    return _few_differ(reduce(lambda a, b: a + b, words), join)


def _ordered_pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()


def _with_ids(described: DataFrame, labels: DataFrame, more: list[str]) -> DataFrame:
    """Labels of representatives, for all rows, named by the smallest doc_id of a class."""
    rows = described.select("doc_id", "n", "name", *more)
    firsts = described.where("n > 0").groupBy("name").agg(F.min("row").alias("row"), F.min("doc_id").alias("doc_id"))
    firsts = firsts.join(labels, "row", "left").select("name", "doc_id", F.coalesce("label", "row").alias("label"))
    firsts = stage_table(firsts, "labels")
    smallest = firsts.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    firsts = firsts.join(smallest, "label").select("name", "component_id")
    out = rows.join(firsts, "name", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """``docs`` with one row of each class, one with the smallest doc_id; all columns stay.

    Rows that repeat one another wholly in doc_id and text count as one; empty texts are linked with nothing and stay.
    """
    classes = stage_table(linked(docs, join, with_key=True).where("n_shingles > 0"), "classes")
    # a class is named by its smallest doc_id; more than one text can have it if that id is repeated
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")).alias("first")
    kept = classes.groupBy("component_id").agg(first).select("first.doc_id", "first.text_key")
    dropped = join_on(classes.select("doc_id", "text_key").distinct(), kept, ["doc_id", "text_key"], "left_anti")
    return without(docs, stage_table(dropped, "other-copies"))
