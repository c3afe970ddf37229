"""Ranked search against the formulas on small tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from drillspark.llm import lexical_search
from drillspark.llm.lexical_search import Best, Items, build_index, search, term_codes

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k):
    """(item, rank, doc_id, score) of each row of items."""
    counted = [(d, Counter(terms_of(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in counted:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in c}
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) & set(c))
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, rank + 1, d, -score) for rank, (score, _, d) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2] or 0))[:k])]
    return sorted(out, key=repr)


def tables():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(30)] + ["É", "naïve", "漢字"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", "-", "\x00\n"]).join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(150)]
    docs += [(i, docs[3][1]) for i in range(150, 190)]  # ties
    docs += [(500, None), (501, ""), (502, "?!\n"), (503, "w0 " * 30000), (504, docs[5][1].upper()), (7, docs[9][1]), (None, docs[4][1])]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    return docs, items + [(20, None), (21, ""), (22, "unheard"), (23, docs[3][1]), (0, items[1][1]), (24, "W0 w0 w0")]


def frames(spark, docs, items):
    clash = [F.lit(1).alias(c) for c in ("m", "row", "terms", "rank", "score", "item")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").select("*", *clash).repartition(4)
    return docs, spark.createDataFrame(items, "item_id long, text string").select("*", *clash)


@pytest.mark.parametrize(
    "sizes", [{}, {"UNIT_DOCS": 3, "AT_ONCE": 40}, {"UNIT_POSTINGS": 5}, {"VOCABULARY": 1, "PASS_TERMS": 20}, {"UNIT_DOCS": 1}]
)
def test_ranks_as_formulas_do(spark, monkeypatch, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(lexical_search, name, size)
    docs, items = tables()
    got = search(*frames(spark, docs, items), k=6)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, 6)


def test_index_serves_several_searches(spark):
    docs, items = tables()
    given, asked = frames(spark, docs, items)
    index = build_index(given)
    for k in (1, 300):
        assert sorted(map(tuple, search(given, asked, k, index).collect()), key=repr) == plain(docs, items, k)


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in search(docs, items).orderBy("rank").collect()] == [(1, "a"), (2, "b"), (3, None)]
    assert not search(docs.limit(0), items).collect() and not search(docs, items.limit(0)).collect()


def test_terms_are_runs_of_letters_digits_and_wide_characters():
    texts = ["Ab-c9 É_x\x7fy", None, "", "ab c9 É x Y", "::", "a" * 70]
    sliced = pa.array(["skip me", *texts], pa.string()).slice(1)
    got = [codes.tolist() for group in term_codes(sliced) for codes in group]
    assert [len(g) for g in got] == [5, 0, 0, 5, 0, 1] and got[0] == got[3] and len(set(got[0])) == 5


def test_large_weights_add_as_integers():
    items = Items(np.array([5]), np.array([0]), np.array([0]), np.array([1 << 50]), 1)
    assert not items.exact
    arrays = [np.array(x) for x in ([0], [2], [1, 0], [3, 5])]
    got = lexical_search._scores(items, np.array([0]), np.array([0]), *arrays, 2)
    assert got.tolist() == [[5 << 50, 3 << 50]]


def test_best_keeps_smallest_ids_of_ties():
    best = Best(2, 2)
    best.add(*(np.array(x) for x in ([0, 0, 0, 1], [5, 5, 5, 1], [False] * 4, [9, 3, 4, 1])))
    best.add(*(np.array(x) for x in ([0], [5], [False], [1])))
    assert best.kept[3].tolist() == [1, 3, 1] and best.threshold.tolist() == [5, 1]
