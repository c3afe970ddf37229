"""Alignment of two tokenizers against a plain version that encodes whole texts."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from drillspark.llm import queries, token_alignment
from drillspark.llm.token_alignment import align, terminals

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = token_alignment.byte_alphabet()

    def tokens(text):
        if not text:
            return [], []
        a = [(i, bytes(alphabet[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in second.encode(text):
            piece = second.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])

    def ends(pairs):
        at, out = 0, {}
        for i, raw in pairs:
            at += len(raw)
            out[at] = i
        return out

    def judge(texts):
        links, split = Counter(), []
        for text in texts:
            a, b = tokens(text)
            ends_a, ends_b = ends(a), ends(b)
            both = sorted(set(ends_a) & set(ends_b))
            split.append((ends_a, ends_b, both))
            links.update((ends_a[e], ends_b[e]) for e in both)
        most = defaultdict(int)
        for (_, b), n in links.items():
            most[b] = max(most[b], n)
        out = []
        for ends_a, ends_b, both in split:
            sides = [[[] for _ in both] for _ in "ab"]
            for side, ends_of in zip(sides, (ends_a, ends_b)):
                for at, i in ends_of.items():
                    side[bisect.bisect_left(both, at)].append(str(i))
            groups = [f"{','.join(a)}|{','.join(b)}" for a, b in zip(*sides)]
            here = [(ends_a[e], ends_b[e]) for e in both]
            best = sum(links[p] == most[p[1]] for p in here)
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
            out.append((len(ends_a), len(ends_b), len(both), len(both), best, sum(links[p] for p in here), digest))
        return out

    return judge


def texts():
    rng = random.Random(5)
    odd = " \n\t  ab 　é漢字👍🏽'’s12▁_-.,\x00\x1c\x85​"
    made = ["".join(rng.choices(odd, k=rng.randint(1, 40))) for _ in range(150)]
    words = ["".join(rng.choices("abcdeéß'", k=rng.randint(1, 9))) for _ in range(60)]
    made += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    return made + [None, "", " ", "a", "<s> <|endoftext|> <unk> <0x41>", "x" * 20000, "word " * 9000, made[160], made[160], "▁", "a ▁ b"]


def run(spark, given, **more):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "doc_id long, text string")
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("row", "pair", "n", "n_a", "groups_sha256")])
    return [tuple(r)[1:] for r in sorted(align(docs.repartition(3), A, B).collect())]


def test_aligns_as_whole_texts_do(spark, plain):
    given = texts()
    assert run(spark, given) == plain(given)


def test_blocks_and_forgetting_change_nothing(spark, plain, monkeypatch):
    given = texts()
    monkeypatch.setattr(token_alignment, "PAIRS", 200)
    assert run(spark, given) == plain(given)


def test_forgetting_keeps_counts(monkeypatch, plain):
    import pyarrow as pa

    given = texts()
    batch = pa.record_batch([pa.array(range(len(given))), pa.array(given, pa.string())], ["doc_id", "text"])
    found = []
    for sizes in ({"REMEMBERED": 50, "TOGETHER": 100}, {}):
        for name, size in sizes.items():
            monkeypatch.setattr(token_alignment, name, size)
        state = type("State", (), {"value": {"a": open(A, "rb").read(), "b": open(B, "rb").read()}})
        total, rows = Counter(), []
        for got in token_alignment._aligned([batch], state, "doc_id"):
            for row in got.to_pylist():
                if row["pair"] is None:
                    rows.append([row[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times")])
                else:
                    total.update(dict(zip(row["pair"], row["n"])))
        found.append((total, rows))
        monkeypatch.undo()
    assert found[0] == found[1] and sum(found[0][0].values()) == sum(r[3] for r in plain(given))


def test_terminals_label_components():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 30)
        a, b = (np.array(sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})) for _ in range(2))
        last = terminals(a, b)
        both = sorted(set(a) & set(b))
        want = [np.searchsorted(b, both[np.searchsorted(both, e)]) + len(a) for e in [*a, *b]]
        assert last.tolist() == want


def test_empty_table_and_missing_ids(spark):
    assert not align(spark.createDataFrame([], "doc_id string, text string"), A, B).collect()
    rows = align(spark.createDataFrame([(None, "a b"), (None, "a b"), ("x", None)], "doc_id string, text string"), A, B).collect()
    assert sorted((r.doc_id or "", r.n_groups, r.n_best, r.count_sum) for r in rows) == [("", 2, 2, 4), ("", 2, 2, 4), ("x", 0, 0, 0)]


def test_query_against_plain_version(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: w for d, w in zip(docs, plain([d.text for d in docs]))}
    got = queries.QUERIES["op13_token_alignment"](spark, SF).collect()
    assert len(got) == len(docs) and all(tuple(r)[1:] == want[r.doc_id] for r in got)
