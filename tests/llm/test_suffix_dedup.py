"""Removal of repeated passages against a brute-force version."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from drillspark.llm import queries, suffix_dedup
from drillspark.llm.suffix_dedup import Passages, remove_repeats

SF = "/root/testdata/sf0.001"


def plain(texts, length):
    """n_bytes, n_removed, n_spans, kept for each text."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_two_stage_order(seed):
    rng = random.Random(seed)
    text = bytes(rng.choices(b"abcd\xff"[: rng.randint(1, 5)], k=rng.randint(1, 300))) + b"\xff"
    raw = suffix_dedup.np.frombuffer(text, suffix_dedup.np.uint8)
    order = suffix_dedup.suffix_order(raw, suffix_dedup._words(raw, 400), 400)
    assert sorted(order.tolist()) == list(range(len(text)))
    # suffixes that run into the end of the array within the depth are in no particular order among others
    inner = [i for i in order.tolist() if b"\xff" not in text[i : i + 5] and len(text) - i > 5]
    assert [text[i : i + 5] for i in inner] == sorted(text[i : i + 5] for i in inner)


@pytest.mark.parametrize("length, gram, limit", [(20, 6, 4 << 20), (20, 20, 4 << 20), (7, 1, 4 << 20), (20, 6, 150)])
def test_removes_what_brute_force_removes(spark, length, gram, limit):
    rng = random.Random(length + gram)
    passage = "".join(rng.choices("abcdé ", k=60))
    texts = [None, "", "short", "a" * 500, "ab" * 90, passage, passage, "x" + passage + "y"]
    for _ in range(60):
        at = rng.randint(0, 40)
        noise = ["".join(rng.choices("abcdé ", k=rng.randint(0, 40))) for _ in range(2)]
        texts.append(noise[0] + passage[at : at + rng.randint(5, 40)] + noise[1])
    docs = spark.createDataFrame([(i if i % 7 else None, t, "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, k1 int")
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("k2", "ranges", "start", "n", "anchor")])
    got = remove_repeats(docs.repartition(5), Passages(length, gram, limit), with_text=True).collect()
    want = [(i if i % 7 else None, *w) for i, w in enumerate(plain(texts, length))]
    want = sorted(((d, b, r, s, hashlib.sha256(k).hexdigest(), k) for d, b, r, s, k in want), key=repr)
    assert sorted(((*r[:-1], bytes(r.kept)) for r in got), key=repr) == want


def test_empty_table_and_bad_sizes(spark):
    empty = remove_repeats(spark.createDataFrame([], "doc_id string, text string"))
    assert empty.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and not empty.collect()
    with pytest.raises(ValueError):
        Passages(10, 11)


def test_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 64)
    raw = suffix_dedup.np.frombuffer(random.Random(1).randbytes(1000).hex().encode(), suffix_dedup.np.uint8)
    found = list(suffix_dedup.pieces(raw, Passages(30, 8)))
    starts = [s for _, _, first, n, _ in found for a, b in zip(first, n) for s in range(a, a + b)]
    assert len(found) > 20 and starts == list(range(len(raw) - 29))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: w for d, w in zip(docs, plain([d.text for d in docs], 400))}
    for r in queries.QUERIES["op11_suffix_dedup"](spark, SF).collect():
        n, removed, spans, kept = want[r.doc_id]
        assert r[1:] == (n, removed, spans, hashlib.sha256(kept).hexdigest())
    assert sum(w[1] for w in want.values()) > 10_000
