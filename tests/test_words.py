"""Words split in numpy against the expressions, and leaves described from one reading against the plain forms."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import words as X
from corpusmill.operators import search as Q
from corpusmill.operators import tree as H

TEXTS = ["The quick Fox_1 a B2 zz", "", None, "über naïve_x Œuvre ½ ª² x—y", "a", "THE the x", "tail", "İK K ſ日本 мир", "_ __ 9", " ", "end of"]


def rows(spark):
    every = [chr(c) for low, high in X.PLAIN for c in range(low, high)]
    return spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "q".join(every), " ".join(every)])], "id long, text string").coalesce(1)


@pytest.mark.parametrize("size", [1, 8, 4 << 20])
def test_words_are_those_of_the_expressions(spark, monkeypatch, size):
    monkeypatch.setattr(X, "SLICE", size)
    lower, folds = F.lower("text"), dict(zip(Q.LATIN_ACCENTED, Q.LATIN_PLAIN))
    for own, given, tokens in ((X.lex_words, lower, T.tokens_lex), (X.desc_words, F.col("text"), T.tokens_desc),
                               (lambda a: X.unicode_words(a, folds), F.when(~lower.rlike(X.ODD), lower), Q.fts_tokens)):
        table = rows(spark).select("id", given.alias("text"), F.coalesce(tokens(F.col("text")), F.array()).alias("want")).filter("text IS NOT NULL OR id = 2").orderBy("id").toArrow().combine_chunks()
        texts, got = table["text"].combine_chunks(), {}
        for low, high in X.slices(texts):
            owner, words = own(texts.slice(low, high - low))
            for i, w in zip(owner, words.to_pylist()):
                got.setdefault(low + int(i), []).append(w)
        assert [got.get(i, []) for i in range(len(texts))] == table["want"].to_pylist()


def test_leaves_are_described_from_one_reading(spark):
    leaves = rows(spark).select(F.concat(F.lit("l"), "id").alias("leaf_id"), "text", F.array(F.lit("n"), F.lit(None).cast("string"), F.concat(F.lit("id"), "id")).alias("names"))
    got = {r.leaf_id: (sorted(r["values"]), r.words) for r in H.describe_leaves(leaves).collect()}
    words = F.array_distinct(T.tokens_desc(F.col("text")))
    both = leaves.select("leaf_id", F.coalesce(words, F.array()).alias("values"), F.filter(F.concat(F.coalesce(words, F.array()), "names"), lambda t: t.isNotNull()).alias("tokens"))
    marked = {r.child_id: r.words for r in H._marked(both.select(F.col("leaf_id").alias("child_id"), F.explode("tokens").alias("token")), "child_id", "token").collect()}
    assert got == {r.leaf_id: (sorted(r["values"]), marked[r.leaf_id]) for r in both.collect()}
