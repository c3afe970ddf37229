"""Toxicity by a factorisation machine over hashed terms.

Terms are words and the first letters of longer words, hashed into a fixed number of places. A machine with a weight for
each place and a short vector for each place scores a text by the sum of the weights of its terms and of the products of
the vectors of each two of them, so that a term can count for more next to another one. It learns from the places that
tell the labels of a bounded sample apart best.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .frames import for_long_texts, if_small, ship, small_batches

ship(__name__)

WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled texts learned from, ``places`` the hashed terms, ``chosen`` those with weights.

    A term needs ``least_texts`` and ``least_gain`` to be chosen; pairs are shrunk more than single terms, as a few
    labels say less about them.
    """

    sample: int = 20_000
    places: int = 1 << 18
    prefix: int = 4
    chosen: int = 512
    factors: int = 4
    least_texts: int = 3
    least_gain: float = 12.0
    steps: int = 800
    rate: float = 0.05
    shrink: float = 1e-5
    shrink_pairs: float = 1e-3
    threshold: float = 0.7


def term_places(word: str, settings: Settings) -> tuple[int, ...]:
    """The places of a word and of its beginning."""
    found = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % settings.places]
    if len(word) > settings.prefix:
        found.append(zlib.crc32(f"^{word[: settings.prefix]}".encode("utf-8", "surrogatepass")) % settings.places)
    return tuple(found)


def _places(batches, settings: Settings) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        found = [
            sorted({p for w in set(WORD.findall((t.as_py() or "").lower())) for p in term_places(w, settings)}) for t in batch.column("text")
        ]
        yield pa.record_batch([batch.column("toxic"), pa.array(found, pa.list_(pa.int32()))], ["toxic", "places"])


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> dict:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); a label given twice counts if either is 1.

    Labels without a doc_id or value are ignored; without any label every text scores one half.
    """
    for_long_texts(docs.sparkSession)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stage_table(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample), "labels")
    texts = docs.select("doc_id", "text").join(if_small(known), "doc_id").select("toxic", "text")
    texts = texts.mapInArrow(lambda it: _places(it, settings), "toxic int, places array<int>")
    texts = stage_table(texts, "labelled-terms")
    n, positive = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    model = {"settings": settings, "chosen": {}, "bias": 0.0, "weights": np.zeros(0), "vectors": np.zeros((0, settings.factors))}
    if not n:
        return model
    # at most ``places`` rows
    each = texts.select("toxic", F.explode("places").alias("place")).groupBy("place").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    table = each.where(F.col("n") >= settings.least_texts).orderBy("place").toArrow()
    place, seen, toxic = (table.column(c).to_numpy().astype(np.float64) for c in ("place", "n", "k"))
    gain = _gain(seen, toxic, n, positive)
    best = [b for b in np.argsort(-gain, kind="stable")[: settings.chosen] if gain[b] >= settings.least_gain]
    chosen = {int(place[b]): i for i, b in enumerate(best)}
    model["chosen"] = chosen
    wanted = F.array(*[F.lit(p) for p in sorted(chosen)]).cast("array<int>")
    small = texts.select("toxic", F.array_sort(F.array_intersect("places", wanted)).alias("places"))
    rows = small.orderBy("toxic", F.xxhash64("places")).toArrow()  # a fixed order, so that sums are the same each time
    x = np.zeros((n, len(chosen)), np.float32)
    for i, places in enumerate(rows.column("places").to_pylist()):
        x[i, [chosen[p] for p in places]] = 1
    y = rows.column("toxic").to_numpy().astype(np.float32)
    model["bias"], model["weights"], model["vectors"] = _fit(x, y, settings)
    return model


def _gain(seen, toxic, n: float, positive: float):
    """How much knowing whether a term occurs tells about the label (G statistic)."""

    def part(count, expected):
        return np.where(count > 0, count * np.log(np.maximum(count, 1e-12) / np.maximum(expected, 1e-12)), 0)

    rate = positive / n
    rest, rest_toxic = n - seen, positive - toxic
    return part(toxic, seen * rate) + part(seen - toxic, seen * (1 - rate)) + part(rest_toxic, rest * rate) + part(rest - rest_toxic, rest * (1 - rate))


def margins(x: np.ndarray, bias: float, weights: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """bias + x w + half the sum over factors of (x v)^2 - x^2 v^2."""
    together = x @ vectors
    return bias + x @ weights + 0.5 * (together**2 - (x**2) @ (vectors**2)).sum(axis=1)


def _fit(x: np.ndarray, y: np.ndarray, settings: Settings) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic loss by Adam over the whole sample; ``x`` is 0 or 1, so it is its own square."""
    n, places = x.shape
    x = x.astype(np.float64)  # once, not in each product
    values = [np.zeros(1), np.zeros(places), np.random.default_rng(7).normal(0, 0.01, (places, settings.factors))]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, settings.steps + 1):
        bias, weights, vectors = values
        together = x @ vectors
        margin = bias[0] + x @ weights + 0.5 * ((together**2).sum(axis=1) - x @ (vectors**2).sum(axis=1))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / n
        single = x.T @ error
        slopes = [
            error.sum(keepdims=True),
            single + settings.shrink * weights,
            x.T @ (error[:, None] * together) - vectors * single[:, None] + settings.shrink_pairs * vectors,
        ]
        for v, g, m, s in zip(values, slopes, first, second):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return float(values[0][0]), values[1], values[2]


def _scores(batches, sent) -> Iterator[pa.RecordBatch]:
    model = sent.value
    settings, chosen, weights, vectors = (model[k] for k in ("settings", "chosen", "weights", "vectors"))
    known: dict[str, tuple[int, ...]] = {}
    for batch in small_batches(batches):
        x = np.zeros((len(batch), len(chosen)), np.float32)
        for i, text in enumerate(batch.column("text")):
            for word in set(WORD.findall((text.as_py() or "").lower())):
                at = known.get(word)
                if at is None:
                    at = tuple(chosen[p] for p in term_places(word, settings) if p in chosen)
                    if len(known) >= 1 << 18:
                        known.clear()
                    if len(word) <= 48:
                        known[word] = at
                for j in at:
                    x[i, j] = 1
        scores = 1 / (1 + np.exp(-np.clip(margins(x, model["bias"], weights, vectors), -30, 30)))
        yield pa.record_batch([*batch.columns[:-1], pa.array(scores.astype(np.float64))], [*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, score (0 to 1), predicted (1 from the threshold on).

    Whole texts are scored; a missing text counts as empty and scores what a text without known terms does; repeated rows
    each have a score; an empty table gives an empty one; other columns are left out.
    """
    for_long_texts(docs.sparkSession)
    settings = model["settings"]
    plain = {**model, "settings": settings}
    sent = docs.sparkSession.sparkContext.broadcast(_portable(plain))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(lambda it: _scores(it, _Unpacked(sent)), f"doc_id {id_type}, score double")
    return scored.withColumn("predicted", (F.col("score") >= settings.threshold).cast("int"))


def _portable(model: dict) -> dict:
    """Broadcast values are unpacked by name, and the package may not be installed there; so settings go as a dict."""
    return {**model, "settings": dict(vars(model["settings"]))}


class _Unpacked:
    def __init__(self, sent):
        self.sent = sent

    @property
    def value(self) -> dict:
        return {**self.sent.value, "settings": Settings(**self.sent.value["settings"])}
