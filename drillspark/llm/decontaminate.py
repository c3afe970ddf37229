"""Benchmark passages in documents: a prefix-filtered join of word windows, verified word by word.

A document holds a window only if it holds every one of its words, so one word of each window is a sufficient prefix: the
one that is rarest in the corpus. Document words are joined with these prefix words alone. A match fixes where the window
would start; the length and position bounds then say whether it fits into the document, and what fits is compared in full.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .frames import lower_ascii, without

#: Between words, after A-Z is lowered. (Splitting reads a text once; extracting all matches copies it for each match.)
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Limits:
    """``window`` words match; contaminated: at least one word of ``one_in`` is hit; ``block`` windows broadcast at once."""

    window: int = 13
    one_in: int = 20
    block: int = 200_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """The distinct windows of all items: words and the items that have them. Shorter items are one window."""
    words = benchmark.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    windows = F.transform(starts, lambda i: F.slice("words", i, F.lit(size)))
    each = words.select("item_id", F.explode(windows).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item_id").alias("items"))


def _prefixes(docs: DataFrame, windows: DataFrame, parts: int) -> DataFrame:
    """Each window with its rarest word, counted over all documents, and the place of that word in it."""
    each = windows.select("window", "items", F.posexplode("window").alias("at", "word"))
    needed = each.select("word").distinct()
    counts = []
    spoken = docs.select(F.explode(_words(F.col("text"))).alias("spoken"))
    for part in range(parts):
        mine = needed.where(F.pmod(F.xxhash64("word"), F.lit(parts)) == part)
        met = spoken.join(F.broadcast(mine), F.col("spoken") == F.col("word"))
        counts.append(met.groupBy("word").agg(F.count("*").alias("n")))
    counted = counts[0]
    for more in counts[1:]:
        counted = counted.unionByName(more)
    each = each.join(counted, "word", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("rare")
    found = each.groupBy("window").agg(rarest, F.first("items").alias("items"))
    return found.select(
        F.col("rare.word").alias("prefix"),
        F.col("rare.at").alias("at"),
        F.size("window").alias("long"),
        F.array_join("window", " ").alias("phrase"),
        "items",
    )


def hits(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text) against ``benchmark`` (item_id, text), by whole texts.

    Columns: doc_id, text_key (MD5 of the text), n_words, spans (array of start and end of window occurrences, in words),
    n_hit, n_items, items (sorted texts), items_sha256, contaminated. A missing text has no words and no hits, as has any
    text if the benchmark is empty; an item without an id is matched but not listed; items with equal ids count once;
    repeated documents get a row each; an empty table gives an empty one; other columns are ignored.
    """
    windows = stage_table(_windows(benchmark.select("item_id", "text"), limits.window), "windows")
    parts = max(1, -(-windows.count() // limits.block))
    given = docs.select("doc_id", "text")
    prefixes = stage_table(_prefixes(given, windows, parts), "window-prefixes")
    # the empty word in front of each document meets an entry without a window, so each document keeps a row
    item = prefixes.schema["items"].dataType.elementType.simpleString()
    marker = prefixes.sparkSession.sql(
        f"SELECT '' AS prefix, 0 AS at, 0 AS long, '' AS phrase, CAST(array() AS array<{item}>) AS items"
    )
    rows = given.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "text", _words(F.col("text")).alias("words")
    )
    spoken = rows.select("row", "doc_id", "text", "words", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("place", "spoken"))
    start = F.col("place") - F.col("at")  # from 1
    phrase = F.array_join(F.slice("words", F.greatest(start, F.lit(1)), F.col("long")), " ")
    holds = (start >= 1) & (start + F.col("long") - 1 <= F.size("words")) & (phrase == F.col("phrase"))
    found = None
    for part in range(parts):
        mine = prefixes.where(F.pmod(F.xxhash64("prefix"), F.lit(parts)) == part)
        if part == 0:
            mine = mine.unionByName(marker)
        met = spoken.join(F.broadcast(mine), (F.col("spoken") == F.col("prefix")) & ((F.col("prefix") == "") | holds))
        own = F.col("prefix") == ""
        met = met.select(
            "row",
            F.when(own, F.struct("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_key"), F.size("words").alias("n_words"))).alias("doc"),
            F.when(~own, F.struct((start - 1).alias("start"), (start - 1 + F.col("long")).alias("end"))).alias("span"),
            F.when(~own, F.col("items")).alias("items"),
        )
        found = met if found is None else found.unionByName(met)
    each = found.groupBy("row").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        F.array_sort(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("reach"), F.lit(0).alias("hit")),
        lambda a, s: F.struct(
            F.greatest(a["reach"], s["end"]).alias("reach"),
            (a["hit"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["reach"], s["start"]))).alias("hit"),
        ),
    )["hit"]
    out = each.select(
        "doc.doc_id",
        "doc.text_key",
        F.col("doc.n_words").cast("long").alias("n_words"),
        "spans",
        covered.cast("long").alias("n_hit"),
        F.array_sort(F.transform("ids", lambda i: i.cast("string"))).alias("items"),
    )
    return out.select(
        "*",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (limits.one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` without contaminated rows; all columns stay."""
    flagged = hits(docs, benchmark, limits).where("contaminated")
    return without(docs, stage_table(flagged.select("doc_id", "text_key").distinct(), "contaminated"))
