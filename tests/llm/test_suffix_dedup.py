"""Suffix arrays and long-repeat removal against sorting and a table of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import queries, suffix_dedup
from corpusmill.llm.suffix_array import permuted_common_prefixes, suffix_array

SF = "/root/testdata/sf0.001"


def brute(texts, length=200):
    """(spans, kept bytes) of each text by counting every string of the corpus."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.md5(r[i:i + length]).digest() for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[hashlib.md5(r[i:i + length]).digest()] > 1:
                gone[i:i + length] = b"\1" * length
        edges = [i for i in range(len(r) + 1) if (gone[i] if i < len(r) else 0) != (gone[i - 1] if i else 0)]
        out.append((list(zip(edges[::2], edges[1::2])), bytes(b for b, g in zip(r, gone) if not g)))
    return out


def test_suffix_array_and_prefixes():
    rng = random.Random(5)
    for _ in range(400):
        s = bytes(rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(70)))
        if rng.random() < 0.3:
            s = (s[:rng.randrange(1, 6)] * 40)[:70]
        data = np.frombuffer(s, np.uint8)
        order = suffix_array(data)
        assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        shared = permuted_common_prefixes(data, order)
        for a, b in zip(order[:-1].tolist(), order[1:].tolist()):
            k = next((k for k in range(len(s)) if a + k >= len(s) or b + k >= len(s) or s[a + k] != s[b + k]), 0)
            assert shared[b] == k


def corpus(seed=7):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé日") for _ in range(rng.randrange(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(60), prose(45)
    texts = [f"{prose(rng.randrange(0, 60))} {passage} {prose(rng.randrange(0, 60))}" for _ in range(30)]
    texts += [f"{prose(9)}{other[:rng.randrange(150, 230)]}{prose(5)}" for _ in range(12)]
    texts += [prose(80)] * 5 + ["ab" * 400, "b" + "ab" * 150, "z" * 199, "z" * 200, "y" * 201, "long" * 5000, "", None, " ", "x" * 199, prose(300), passage + passage]
    near = prose(400).split(" ")
    for k in range(6):
        near[70 * k] = "changed"
        texts.append(" ".join(near))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("length,piece,shard", [(200, 32, 1 << 20), (200, 32, 3000), (60, 8, 1 << 20), (60, 8, 500)])
def test_equals_table_of_all_strings(spark, length, piece, shard):
    """With small shards, hot anchors take the way by strings; the result is the same."""
    texts = corpus()
    docs = spark.createDataFrame([(k % 7 or None, t, "kept") for k, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(5).withColumn("print", F.lit(1))
    got = suffix_dedup.drop_repeats(docs, length=length, piece=piece, shard=shard)
    assert got.columns == [*docs.columns, "_spans", "kept_bytes"]
    rows = sorted((r.text or "", [tuple(x) for x in r._spans], bytes(r.kept_bytes)) for r in got.collect())
    assert rows == sorted((t or "", spans, kept) for t, (spans, kept) in zip(texts, brute(texts, length)))


def test_empty_table(spark):
    assert suffix_dedup.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_table_of_all_strings(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((d.doc_id, len((d.text or "").encode()), sum(e - s for s, e in spans), len(spans), hashlib.sha256(kept).hexdigest())
                  for d, (spans, kept) in zip(docs, brute([d.text for d in docs])))
    assert sum(w[2] for w in want) > 0
    got = queries.op11_suffix_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == want
