"""Quality classifier: gated-attention multiple-instance learning over the passages of a document.

A document is a bag of passages of 64 words. Each passage is encoded from the shapes of its words and from how much it
repeats itself; a learned layer embeds it. Gated attention (tanh branch times sigmoid branch) learns from document labels
alone which passages matter, and the score is a logistic function of the attention-weighted passage.

Nulls and empty texts are one passage without content, so they have a score. Every passage of every text is encoded when
scoring; only fitting is bounded (see ``fit``). Repeated rows are scored alike; extra columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import Words, append_columns, scramble

PASSAGE_WORDS = 64
SHAPES = 64
FEATURES = SHAPES + 4


_WORD = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])
#: Capitals, other letters (and what is not ASCII) and digits by class, other characters as they are.
_CLASS = np.array([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b > 127 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def encode_passages(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The passages of some texts, in order: one row of FEATURES numbers each; and each text's number of passages."""
    w = Words(texts, _WORD)
    passages = np.maximum(1, -(-w.count // PASSAGE_WORDS))
    k = int(passages.sum())
    out = np.zeros((k, FEATURES), np.float32)
    n = len(w.start)
    if not n:
        return out, passages
    before = np.cumsum(w.count) - w.count
    at = np.arange(n) - before[w.text]                                     # place in its text
    p = (np.cumsum(passages) - passages)[w.text] + at // PASSAGE_WORDS
    size = np.bincount(p, minlength=k).astype(np.float32)
    per = np.maximum(size, 1)
    kind = _CLASS[w.data]
    keep = np.ones(len(kind), bool)                                        # runs of a class count as two of a kind at most
    keep[2:] = (kind[2:] != kind[1:-1]) | (kind[2:] != kind[:-2])
    seen = np.concatenate([[0], np.cumsum(keep)])
    sums = w.running(kind, seen[:-1])
    sums[1:] = np.cumsum(np.where(keep, np.diff(sums), np.uint64(0)))
    shape = scramble((sums[w.end] - sums[w.start]) * w.unpower[seen[w.start]]) % np.uint64(SHAPES)
    out[:, :SHAPES] = np.bincount(p * SHAPES + shape.astype(np.int64), minlength=k * SHAPES).reshape(k, SHAPES) / per[:, None]
    codes = w.hash(w.start, w.end)
    padded = np.arange(k * PASSAGE_WORDS, dtype=np.uint64)                 # small numbers stand for no word
    padded[p * PASSAGE_WORDS + at % PASSAGE_WORDS] = codes
    ordered = np.sort(padded.reshape(k, PASSAGE_WORDS), axis=1)
    out[:, SHAPES] = 1 - (ordered[:, 1:] == ordered[:, :-1]).sum(1) / per
    again = (codes[1:] == codes[:-1]) & (p[1:] == p[:-1])
    out[:, SHAPES + 1] = np.bincount(p[1:], weights=again, minlength=k) / per
    out[:, SHAPES + 2] = np.bincount(p, weights=w.end - w.start, minlength=k) / per / 10
    out[:, SHAPES + 3] = np.log1p(size) / 4
    return out, passages


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(m, x, first):
    """``first``: index of each bag's first passage."""
    h = np.tanh(x @ m["W"] + m["b"])
    t, s = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * s) @ m["w"]
    bag = np.zeros(len(x), np.int64)
    bag[first[1:]] = 1
    bag = np.cumsum(bag)
    a = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return h, t, s, a, z, bag, _sigmoid(z @ m["c"] + m["c0"])


def _gradient(m, x, first, y, weight):
    h, t, s, a, z, bag, p = _forward(m, x, first)
    do = (p - y) * weight / weight.sum()
    g = {"c": z.T @ do, "c0": np.array([do.sum()])}
    dz = (do[:, None] * m["c"])[bag]
    da = (dz * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, first)[bag])
    g["w"] = (t * s).T @ de
    dg = de[:, None] * m["w"]
    dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh = (a[:, None] * dz + dt @ m["V"].T + ds @ m["U"].T) * (1 - h * h)
    g["W"], g["b"] = x.T @ dh, dh.sum(0)
    return g


def train(bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 40,
          rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> dict:
    """Adam over batches of bags, in numpy."""
    rng = np.random.default_rng(seed)
    def init(*shape):
        return rng.normal(0, shape[0] ** -0.5, shape)

    m = {"W": init(FEATURES, hidden), "b": np.zeros(hidden), "V": init(hidden, gate), "U": init(hidden, gate), "w": init(gate), "c": init(hidden), "c0": np.zeros(1)}
    mean, square = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), 128):
            own = order[i:i + 128]
            x = np.concatenate([bags[k] for k in own]).astype(np.float64)
            first = np.cumsum([0, *[len(bags[k]) for k in own[:-1]]])
            g = _gradient(m, x, first, y[own], weight[own])
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k in m:
                d = g[k] + decay * m[k]
                mean[k] = 0.9 * mean[k] + 0.1 * d
                square[k] = 0.999 * square[k] + 0.001 * d * d
                m[k] = m[k] - lr * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    return m


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, bag_limit: int = 64, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> dict:
    """Fit on labelled documents. Fitting alone is bounded, at any size of the corpus: ``per_class`` documents of each label,
    those with the smallest hash of their id, and of each ``bag_limit`` passages, evenly spaced. The loss is weighted back
    to the labels' true shares. Without rows of both labels the model is their smoothed share."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)") \
        .groupBy("id").agg(F.max("y").alias("y"))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = share.get(0, 0), share.get(1, 0)
    constant = {"constant": (n1 + 1) / (n0 + n1 + 2), "both": False}
    if not n0 or not n1:
        return constant
    pick = [known.filter(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(per_class) for v in (0, 1)]
    chosen = F.broadcast(pick[0].unionByName(pick[1]))                     # at most 2 * per_class rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def work(texts):
        x, passages = encode_passages(texts.to_pylist())
        out = []
        for last, n in zip(np.cumsum(passages), passages):
            own = x[last - n:last]
            out.append((own[np.linspace(0, n - 1, bag_limit).astype(int)] if n > bag_limit else own).tobytes())
        return [pa.array(out, pa.binary())]

    got = append_columns(rows, ["text"], [T.StructField("bag", T.BinaryType())], lambda: work).select("id", "y", "bag").collect()
    got.sort(key=lambda r: r["id"])
    y = np.array([r["y"] for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        return constant
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in got]
    weight = np.where(y == 1, n1 / (y == 1).sum(), n0 / (y == 0).sum()) / (n0 + n1)
    return train(bags, y, weight) | {"both": True}


def score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """The documents and the probability of label 1 as ``name``, from whole texts."""
    def work(texts):
        if not model["both"] or not len(texts):
            return [pa.array(np.full(len(texts), model.get("constant", 0.0)))]
        x, passages = encode_passages(texts.to_pylist())
        return [pa.array(_forward(model, x.astype(np.float64), np.cumsum(passages) - passages)[-1])]

    return append_columns(docs, [text_col], [T.StructField(name, T.DoubleType())], lambda: work)
