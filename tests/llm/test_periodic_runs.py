"""Runs of repeated words against a search of all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and not any(w[i:j + q - r] == w[i + r:j + q] for r in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_suffix_tree_extensions():
    rng = random.Random(4)
    for _ in range(60):
        s = [rng.randrange(rng.choice([1, 2, 9])) for _ in range(rng.randrange(2, 50))]
        tree = periodic_runs.SuffixTree(s)
        assert np.argsort(tree.rank).tolist() == sorted(range(len(s) + 1), key=lambda i: s[i:])
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                k = next((k for k in range(len(s)) if j + k >= len(s) or s[i + k] != s[j + k]), 0)
                assert tree.common(np.array([i]), np.array([j]))[0] == k == tree.common(np.array([j]), np.array([i]))[0]


def test_all_periods():
    rng = random.Random(2)
    for _ in range(500):
        w = [b"%d" % rng.randrange(rng.choice([1, 2, 5])) for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = ([b"%d" % rng.randrange(6) for _ in range(rng.randrange(1, 9))] * 12)[:rng.randrange(5, 90)]
        for least, times in ((24, 3), (6, 2), (8, 3)):
            assert list(map(tuple, periodic_runs.word_runs(w, least, times).tolist())) == brute(w, least, times)


def test_rows(spark):
    texts = [None, "", " \n\t\x0b ", "one", "a " * 23, "a " * 24, "a b c " * 40, "x " * 3000 + "end", "long" * 5000, "p q r " * 9 + "s t " * 20 + "p q r " * 9, "a " * 24]
    docs = spark.createDataFrame([(k if k % 3 else None, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, runs int").withColumn("collapsed", F.lit(2))
    got = periodic_runs.find_runs(docs)
    assert got.columns == ["doc_id", "text", "runs", "collapsed", "_runs", "_collapsed"]
    for r in got.collect():
        want = brute(words(r.text))
        assert [tuple(x) for x in r._runs] == want and r._collapsed == collapsed(words(r.text), want)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0


def test_query(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    sha, some = lambda t: hashlib.sha256(t.encode()).hexdigest(), 0
    for d in docs:
        w, h = words(d.text), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs, r = brute(w), got[d.doc_id]
        some += len(runs)
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(runs), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(w, runs)))
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert some
