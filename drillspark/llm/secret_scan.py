"""Secrets in texts: sure patterns, and parts of credentials that count only next to their complements.

Sure findings (``assign``, ``access``, ``hex``) stand alone. Weak ones are reported when the rest of a credential lies in
the same scope, so many code points away at most: ``key`` (a mixed token of 40 characters) next to an access identifier
or a login, ``login`` (a named user or client id) next to a secret and an endpoint, ``endpoint`` (an address of a service)
next to an access identifier or login and a secret. Scopes are found by an interval join on bins as wide as a scope:
partners are summed up for each bin and role by their first and last place, which decides exactly whether one lies in
reach, so a text full of parts makes no pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .frames import free_name, if_small, text_key

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LONG = r"""(?i)^(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}$"""
#: kind: (pattern, what a match must also satisfy). Runs shorter than asked for never hold a longer one, so the lengths
#: of access and hex are part of their patterns.
SURE = {"assign": (ASSIGN, ASSIGN_LONG), "access": (r"AKIA[A-Z0-9]{12,}", None), "hex": (r"[0-9a-f]{32,}", None)}
WEAK = {
    "key": (r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"),
    "login": (r"""(?i)\b(?:user(?:name)?|login|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", None),
    "endpoint": (r"""(?i)\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|s3)://[A-Za-z0-9.-]+(?::[0-9]+)?""", None),
}
KINDS = [*SURE, *WEAK]
#: What each match holds for sure, and is quicker to look for; texts without it are not searched.
HOLDS = {
    "assign": lambda t: t.contains(":") | t.contains("="),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike("[0-9a-f]{32}"),
    "key": lambda t: t.rlike("[A-Za-z0-9+/]{40}"),
    "login": lambda t: t.contains(":") | t.contains("="),
    "endpoint": lambda t: t.contains("://"),
}
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "login": "id", "endpoint": "endpoint"}
#: Roles that must all lie in reach of a weak part.
NEEDS = {"key": ["id"], "login": ["secret", "endpoint"], "endpoint": ["id", "secret"]}
SCOPE = 400


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(items: Column) -> Column:
    """An array in blocks of an even size, about as many as a block has items."""
    size = (F.ceil(F.sqrt(F.size(items)) / 2) * 2).cast("int")
    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / size).cast("int"))
    return F.transform(numbers, lambda i: F.slice(items, i * size + 1, size))


def _before(blocks: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Struct (upto, at): a running figure over blocks, from 0; ``at`` has it as it is before each block."""
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(
        blocks, start, lambda done, block: F.struct(add(done["upto"], block).alias("upto"), F.concat(done["at"], F.array(done["upto"])).alias("at"))
    )


def _spans(text: Column, kind: str, pattern: str, also: str | None) -> Column:
    """Leftmost matches that do not overlap, as (start, order of the kind, end) in code points.

    Matches are marked off by a character that the text does not hold; then what lies between matches and the matches
    take turns, and their lengths, added up, are the places. They are added up by blocks, so that many matches in one text
    take time in proportion, nearly.
    """
    marked = F.regexp_replace(F.translate(text, "\0", "\1"), pattern, "\0$0\0")
    one = "struct<start:int,kind:int,end:int>"

    def step(done: Column, piece: Column) -> Column:
        end = done["at"] + F.length(piece)
        span = F.struct(done["at"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        good = done["inside"] if also is None else done["inside"] & piece.rlike(also)
        spans = F.when(good, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), (~done["inside"]).alias("inside"), spans.alias("spans"))

    def of_block(block: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.lit(False).alias("inside"), F.array().cast(f"array<{one}>").alias("spans"))
        return F.aggregate(block, start, step)["spans"]

    def of_pieces(pieces: Column) -> Column:
        length = lambda block: F.aggregate(block, F.lit(0), lambda n, piece: n + F.length(piece))
        return _named(
            _blocks(pieces),
            lambda blocks: _named(
                _before(blocks, lambda at, block: at + length(block)),
                lambda before: F.flatten(F.transform(blocks, lambda block, i: of_block(block, F.get(before["at"], i)))),
            ),
        )

    spans = _named(F.split(marked, "\0"), of_pieces)
    return F.when(HOLDS[kind](text) & text.rlike(pattern), spans).otherwise(F.array().cast(f"array<{one}>"))


def find(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, text_key (MD5 of the text), base, linked.

    ``base`` and ``linked`` are sorted arrays of (start, kind, end), kinds numbered as in ``KINDS``. A missing or empty
    text has none; repeated rows each have theirs; an empty table gives an empty one; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sure = F.array_sort(F.concat(*[_spans(text, k, *SURE[k]) for k in SURE]))
    weak = F.array_sort(F.concat(*[_spans(text, k, *WEAK[k]) for k in WEAK]))
    found = docs.select("doc_id", text_key(docs).alias("text_key"), sure.alias("base"), weak.alias("weak"))
    found = stage_table(found.withColumn("row", F.monotonically_increasing_id()), "secret-parts")
    return _link(found, scope)


def _link(found: DataFrame, scope: int) -> DataFrame:
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.col("part.kind") + 1)
    weak = found.where(F.size("weak") > 0)
    parts = weak.select("row", F.explode(F.concat("base", "weak")).alias("part")).withColumn("role", role)
    parts = parts.withColumn("bin", F.floor(F.col("part.start") / scope))
    sums = parts.groupBy("row", "bin", "role").agg(F.min("part.start").alias("first"), F.max("part.start").alias("last"))
    sums = sums.withColumnRenamed("role", "partner")
    asking = weak.select("row", F.explode("weak").alias("part"))
    asking = asking.withColumn("bin", F.explode(F.array(*[F.floor(F.col("part.start") / scope) + d for d in (-1, 0, 1)])))
    near = asking.join(sums, ["row", "bin"])
    begin = F.col("part.start")
    reach = (F.col("first") <= begin + scope) & (F.col("last") >= begin - scope)
    near = near.where(reach).groupBy("row", "part").agg(F.collect_set("partner").alias("partners"))
    complete = [
        (F.col("part.kind") == KINDS.index(k)) & reduce(lambda a, b: a & b, [F.array_contains("partners", r) for r in NEEDS[k]])
        for k in WEAK
    ]
    linked = near.where(reduce(lambda a, b: a | b, complete)).groupBy("row").agg(F.array_sort(F.collect_list("part")).alias("linked"))
    out = found.join(linked, "row", "left")
    none = F.array().cast(found.schema["base"].dataType)
    return out.select("doc_id", "text_key", "base", F.coalesce("linked", none).alias("linked"))


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas, in the order of ``spans``."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each finding, or run of findings that overlap, replaced by ``mark``, and ``n_chars`` counted anew."""
    found = find(docs, scope)
    spans = F.array_sort(F.concat("base", "linked"))
    doc, key, cuts = (free_name(docs, n) for n in ("found_doc", "found_key", "found_cuts"))
    found = found.where((F.size("base") > 0) | (F.size("linked") > 0)).dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), spans.alias(cuts))
    text = docs["text"]
    same = docs["doc_id"].eqNullSafe(F.col(doc)) & (text_key(docs) == F.col(key))
    joined = docs.join(if_small(stage_table(found, "found"), 100_000), same, "left")

    def furthest(at: Column, block: Column) -> Column:
        return F.greatest(at, F.array_max(F.transform(block, lambda s: s["end"])))

    def clean_block(block: Column, at: Column, part: Column) -> Column:
        """The text from ``at`` to the last end of a block, with its findings replaced."""

        def step(done: Column, s: Column) -> Column:
            kept = F.concat(F.substring(part, done["at"] - at + 1, s["start"] - done["at"]), F.lit(mark))
            parts = F.when(s["start"] >= done["at"], F.concat(done["parts"], F.array(kept))).otherwise(done["parts"])
            return F.struct(F.greatest(done["at"], s["end"]).alias("at"), parts.alias("parts"))

        start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("parts"))
        return F.aggregate(block, start, step, lambda done: F.array_join(done["parts"], ""))

    def clean(blocks: Column, before: Column) -> Column:
        def one(block: Column, i: Column) -> Column:
            at = F.get(before["at"], i)
            # places are looked for in the block's part of the text, not from the start of a long text each time
            return _named(F.substring(text, at + 1, furthest(at, block) - at), lambda part: clean_block(block, at, part))

        return F.concat(F.array_join(F.transform(blocks, one), ""), F.substring(text, before["upto"] + 1, F.length(text)))

    cleaned = _named(_blocks(F.col(cuts)), lambda blocks: _named(_before(blocks, furthest), lambda before: clean(blocks, before)))
    cleaned = F.when(F.col(cuts).isNotNull(), cleaned).otherwise(text)
    changed = {"text": cleaned}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(cuts).isNotNull(), F.length(cleaned)).otherwise(docs["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return joined.select(*[changed.get(c, docs[c]).alias(c) for c in docs.columns])
