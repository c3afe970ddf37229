"""Rules for URLs, and exact membership of listed keys by a cascade of Bloom filters.

The first filter holds the listed keys. Other keys of the corpus that pass it go into the second, listed keys that pass
the second into the third, and so on until no key passes wrongly. For every key of the corpus the first filter that it
does not pass then tells exactly whether it is listed, so a page is judged from its own row, without a join.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .frames import lower_ascii

#: (verdict, host, path): a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Bits in one bitmap of Spark's bitmap functions, and the most bits a cascade may send with a query.
WORD_BITS, MOST_BITS = 32768, 1 << 28


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return lower_ascii(F.regexp_extract(_after(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(at + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _bit(key: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits))


def _filled(keys: DataFrame, level: int, bits: int, hashes: int) -> bytes:
    """A Bloom filter of the keys: one bitmap for each 32,768 bits comes to the driver, at most ``MOST_BITS`` in all."""
    places = F.explode(F.array(*[_bit(F.col("key"), level * 64 + h, bits) for h in range(hashes)]))
    each = keys.select(places.alias("bit"))
    word = F.floor(F.col("bit") / WORD_BITS)
    maps = each.groupBy(word.alias("word")).agg(F.bitmap_construct_agg((F.col("bit") % WORD_BITS).cast("long")).alias("map"))
    out = bytearray(bits // 8)
    for row in maps.collect():
        out[row["word"] * WORD_BITS // 8 : (row["word"] + 1) * WORD_BITS // 8] = row["map"]
    return bytes(out)


def passes(key: Column, level: tuple[int, int, int, bytes]) -> Column:
    """Whether all bits of ``key`` are set in the filter of a level."""
    seed, bits, hashes, data = level
    held = F.lit(data)

    def one(h: int) -> Column:
        bit = _bit(key, seed * 64 + h, bits)
        byte = F.conv(F.hex(F.substring(held, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (bit % 8).cast("int")) == 1

    return reduce(lambda a, b: a & b, [one(h) for h in range(hashes)])


def cascade(keys: DataFrame, most_bits: int = MOST_BITS) -> list[tuple[int, int, int, bytes]] | None:
    """The levels for ``keys`` (key, listed), all distinct keys of the corpus; None if they would need more bits."""
    levels: list[tuple[int, int, int, bytes]] = []
    inside, outside = keys.where("listed"), keys.where("NOT listed")
    n, spent = inside.count(), 0
    others = outside.count()
    while n:
        # the first level lets about as many others pass as there are listed keys; later ones an eighth
        wanted = max(2.0, others / n * 1.4) if not levels else 8.0
        hashes = min(30, max(1, round(math.log2(wanted))))
        bits = WORD_BITS * max(1, math.ceil(n * hashes / math.log(2) / WORD_BITS))
        spent += bits
        if spent > most_bits:
            return None
        level = (len(levels), bits, hashes, _filled(inside.select("key"), len(levels), bits, hashes))
        levels.append(level)
        wrong = stage_table(outside.where(passes(F.col("key"), level)), "passed-wrongly")
        inside, outside, n, others = wrong, inside, wrong.count(), n
    return levels


def is_member(key: Column, levels: list[tuple[int, int, int, bytes]]) -> Column:
    """Exact for every key that the cascade was made from."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        answer = F.when(~passes(key, levels[i]), F.lit(i % 2 == 1)).otherwise(answer)
    return answer


def judge(pages: DataFrame, listed: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """One row for each row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, listed.

    ``listed`` (key) has keys that are blocked unless a rule says otherwise; a key is a host and a path. A missing URL,
    or one without ://, has an empty host, an empty path and no rule, and can be listed under the empty key. Repeated
    rows each have a verdict, repeated or missing listed keys count once or not at all; an empty table gives an empty
    one; other columns are ignored. Filters travel with the query up to ``most_bits``; a longer list is joined instead.
    """
    url = F.col("url")
    given = pages.select("page_id", F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"))
    key = F.concat("host", "path")
    universe = given.select(key.alias("key"), F.lit(False).alias("listed")).unionByName(listed.where("key IS NOT NULL").select("key", F.lit(True).alias("listed")))
    keys = stage_table(universe.groupBy("key").agg(F.max("listed").alias("listed")), "keys")
    levels = cascade(keys, most_bits)
    if levels is None:
        found = keys.where("listed").select(F.col("key").alias("found"))
        given = given.join(found, key == F.col("found"), "left").withColumn("listed", F.col("found").isNotNull()).drop("found")
    else:
        given = given.withColumn("listed", is_member(key, levels))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return given.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")
