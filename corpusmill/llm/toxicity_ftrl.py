"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or absent: its lower-case words, the starts of words (three to seven bytes, so that
inflected forms share evidence), pairs of neighbours, and pairs that skip one word. They are hashed into 2^22 buckets. FTRL gives each coordinate a
learning rate of its own, and its L1 term leaves most weights exactly zero: what goes to the tasks is the short list of
the others, at most ``2^22`` of them.

Null and empty texts have no features and get the score of the intercept. Repeated rows are scored alike; extra columns pass
through untouched. Every word of a text counts when scoring; only fitting is bounded (see ``fit``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import Words, append_columns, scramble

BITS = 22
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_STARTS = range(3, 8)
_SALT = 0x9E3779B97F4A7C15
_MASK = (1 << BITS) - 1


def features(texts: list, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts and buckets of their features, in order, each pair once; only ``chosen`` buckets if given."""
    w = Words([(t or "").lower() for t in texts], _WORD)
    h = w.hash(w.start, w.end)
    found = [(w.text, h)]
    for size in _STARTS:
        own = np.flatnonzero(w.end - w.start >= size)
        found.append((w.text[own], w.hash(w.start[own], w.start[own] + size) + np.uint64(size * _SALT % 2**64)))
    for apart in (1, 2):
        own = np.flatnonzero(w.text[apart:] == w.text[:-apart])
        found.append((w.text[own], scramble(h[own] * np.uint64(_SALT) + h[own + apart]) + np.uint64(apart)))
    pairs = []
    for text, hashes in found:
        bucket = (scramble(hashes) & np.uint64(_MASK)).astype(np.int64)
        if chosen is not None:
            own = chosen[bucket]
            text, bucket = text[own], bucket[own]
        pairs.append(text.astype(np.int64) << BITS | bucket)
    pairs = np.unique(np.concatenate(pairs))
    return pairs >> BITS, pairs & _MASK


def train(rows: list[np.ndarray], y: np.ndarray, epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1,
          seed: int = 7) -> dict:
    """FTRL-proximal, one document at a time. Coordinate i has the rate alpha / (beta + sqrt(n_i)), n_i the sum of its squared
    gradients, and the weight 0 while |z_i| <= l1. The intercept is not penalised. With ``l1``
    at ``epochs``, what a single document has stays at zero."""
    size = _MASK + 1
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    rng = np.random.default_rng(seed)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i = rows[k]
            w, b = weights(i), -zb / ((beta + nb ** 0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y[k]
            grown = np.sqrt(n[i] + g * g) - np.sqrt(n[i])
            z[i] += g - grown / alpha * w
            n[i] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb ** 0.5) / alpha * b
            nb += g * g
    w = weights(np.arange(size))
    at = np.flatnonzero(w).astype(np.int32)
    return {"at": at, "w": w[at], "b": -zb / ((beta + nb ** 0.5) / alpha)}


def fit(docs: DataFrame, labels: DataFrame, limit: int = 5000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict:
    """Fit on labelled documents. Fitting alone is bounded, at any size of the corpus: the ``limit`` labelled documents
    with the smallest hash of their id. Without labels the intercept is 0 and every score a half."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)") \
        .groupBy("id").agg(F.max("y").alias("y"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(limit))      # at most ``limit`` rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def work(texts):
        text, bucket = features(texts.to_pylist())
        cuts = np.searchsorted(text, np.arange(len(texts) + 1))
        return [pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())]

    got = append_columns(rows, ["text"], [T.StructField("f", T.BinaryType())], lambda: work).select("id", "y", "f").collect()
    got.sort(key=lambda r: r["id"])
    return train([np.frombuffer(r["f"], np.int32) for r in got], np.array([r["y"] for r in got], np.float64))


def score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """The documents and the probability of label 1 as ``name``, from whole texts."""
    spread = docs.sparkSession.sparkContext.broadcast((model["at"], model["w"].astype(np.float32), model["b"]))

    def start():
        at, w, b = spread.value
        dense = np.zeros(_MASK + 1, np.float32)
        dense[at] = w
        chosen = dense != 0

        def work(texts):
            text, bucket = features(texts.to_pylist(), chosen)
            total = b + np.bincount(text, weights=dense[bucket], minlength=len(texts))
            return [pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))]
        return work

    return append_columns(docs, [text_col], [T.StructField(name, T.DoubleType())], start)
