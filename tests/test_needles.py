"""Substring search where the texts lie, against brute force."""

import random

from pyspark.sql import functions as F

from corpusmill.functions import needles as N
from corpusmill.operators import search as Q


def brute(queries, chunks, k):
    out = []
    for qid in {q for q, _ in queries if q is not None}:
        hits = []
        for needle in [n.lower() for q, n in queries if q == qid and n]:
            for c, path, text in chunks:
                there = 100 if needle in path.lower() else 0
                n = text.lower().count(needle) if text is not None else 0
                if c is not None and (n or there):
                    hits.append((text is None, -(n + there), path, c))
        out += [(qid, r, c, path, None if none else -score) for r, (none, score, path, c) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=str)


def test_exact_search_equals_brute_force(spark, monkeypatch):
    """Overlapping, short, long, repeated and missing needles; texts that are null, empty, or lie across a stretch."""
    monkeypatch.setattr(N, "SLICE", 50)                                     # in this process only
    rng = random.Random(11)
    bits = ["ab", "aB", "x", "Ünter", " ", "-", "zz", "a long word here, ", "#", "\n", "\u20ac"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    chunks = [(i, f"Src{i % 7}/{'zz' if i % 5 else 'ab'}/{i}", t) for i, t in enumerate(texts)] + [(500, "src1/none", None), (None, "src1/x", "ab"), (7, "src3/again", "zz zz")]
    asked = [t[i:i + rng.randint(1, 40)] for t in texts if t for i in [rng.randrange(len(t))]] + ["src", "SRC1", "zzz", "a", "", None, "b" * 3000]
    queries = [(f"q{i % 90}", n) for i, n in enumerate(asked)] + [("q0", asked[0]), (None, "ab"), ("none", "src1/none")]
    c = spark.createDataFrame(chunks, "chunk_id bigint, source_path string, text string")
    q = spark.createDataFrame(queries, "query_id string, text string")
    want = brute(queries, chunks, 5)
    for block in (1 << 24, 4000):
        assert sorted(map(tuple, Q.exact_search(q, c.repartition(3), 5, block).collect()), key=str) == want
    needles = N.Needles(list({n.lower().encode() for _, n in queries if n}))
    import pyarrow as pa
    body = [t.lower().encode() for t in texts]
    text, needle, n = needles.occurrences(pa.array([b"skipped", *body], pa.binary()).slice(1))
    assert {(t, j): m for t, j, m in zip(text.tolist(), needle.tolist(), n.tolist())} == {(t, j): b.count(w) for t, b in enumerate(body) for j, w in enumerate(needles.needles) if w in b}


def test_exact_search_shuffles_no_texts(spark):
    """Needles without an inner word once met all texts in joins that carry the texts."""
    c = spark.range(40).select(F.col("id").alias("chunk_id"), F.concat(F.lit("src1/"), "id").alias("source_path"), F.lit("some words").alias("text"))
    q = spark.createDataFrame([(f"q{i}", "src1"[:1 + i % 4]) for i in range(8)], "query_id string, text string")
    plan = Q.exact_search(q, c, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "chunk_id" in plan
