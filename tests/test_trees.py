"""Tree search against all leaves at once, digests against planted damage, declared relations branch by branch."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import snapshots as V
from corpusmill.operators import tree as H
from corpusmill.session import cut_lineage

WORDS = [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def forest(spark):
    rng = random.Random(5)
    leaves = [(f"l{i:03d}", f"ns{i % 3}", f"g{i % 5}", f"h{i}") for i in range(90)]
    texts = {leaf[0]: set(rng.sample(WORDS, rng.randrange(1, 6))) for leaf in leaves}
    edges, nodes = H.build_levels(spark.createDataFrame(leaves, "leaf_id string, namespace string, group_key string, content_hash string"), 3)
    words = spark.createDataFrame([(k, w) for k, ws in texts.items() for w in ws], "leaf_id string, value string")
    lex = H.roll_counts(edges, words, 2).groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("lex"))
    top = nodes.groupBy("namespace").agg(F.max("level").alias("_t"))
    table = nodes.join(top, "namespace").withColumn("is_root", F.col("level") == F.col("_t")).join(lex, "node_id").join(H.roll_bits(edges, words.withColumnRenamed("value", "token")).select("node_id", "bits"), "node_id")
    none = F.array().cast("array<string>")
    table = cut_lineage(table.withColumn("entities", none).withColumn("kinds", none).withColumn("stale", F.substring("node_id", 6, 1) == "a"))
    return leaves, texts, edges, table, words


@pytest.mark.parametrize("roots,beam,depth", [(1, 1, 12), (2, 2, 2), (9, 99, 12)])
def test_search_finds_what_all_leaves_hold(spark, forest, roots, beam, depth):
    leaves, texts, edges, table, words = forest
    rng = random.Random(7)
    asked = {}
    for i in range(12):
        terms = rng.sample(WORDS + ["absent"], rng.randrange(1, 5))
        asked[i] = (terms, rng.choice([None, None, terms[0].upper()]), rng.sample(["ns0", "ns1", "ns2", "nowhere"], rng.randrange(0, 4)))
    q = spark.createDataFrame([(i, t, m) for i, (t, m, _) in asked.items()] + [(99, [], None)], "query_id int, terms array<string>, must string")
    scopes = spark.createDataFrame([(i, n) for i, (_, _, ns) in asked.items() for n in ns] + [(99, "ns0")], "query_id int, namespace string")
    hits, stats = H.search_trees(q, scopes, table, edges, words, k=5, roots=roots, beam=beam, depth=depth)
    got, want = {(r.query_id, r.rank, r.leaf_id, r.overlap) for r in hits.collect()}, set()
    for i, (terms, must, ns) in asked.items():
        found = [(-len(texts[leaf] & set(terms)), leaf) for leaf, n, _, _ in leaves if n in ns and texts[leaf] & set(terms) and (must is None or must.lower() in texts[leaf])]
        want |= {(i, k + 1, leaf, -o) for k, (o, leaf) in enumerate(sorted(found)[:5])}
    assert got == want
    by = {r.query_id: r for r in stats.collect()}
    assert set(by) == set(asked) | {99} and by[99].unexplored == 0
    assert any(r.fallback for r in by.values()) == (beam < 99)


def test_damage_is_traced_to_its_leaves(spark, forest):
    leaves, _, edges, _, _ = forest
    schema = "leaf_id string, content_hash string"
    before = cut_lineage(H.node_digests(edges, spark.createDataFrame([(r[0], r[3]) for r in leaves], schema)))
    for broken in (set(), {"l004"}, {"l000", "l031", "l089"}):
        now = spark.createDataFrame([(r[0], r[3] + "!" * (r[0] in broken)) for r in leaves if r[0] != "l031" or "l031" not in broken], schema)
        found = H.locate_damage(edges, before, H.node_digests(edges, now)).collect()
        assert {r.leaf_id for r in found} == broken and len(found) == len(broken)
    lists = edges.groupBy("node_id").agg(F.collect_list("child_id").alias("children"))
    same = H.validate_digests(edges, before, spark.createDataFrame([(r[0], r[3]) for r in leaves], schema), lists)
    assert all(r.violations == 0 for r in same.collect())


def test_relations_by_branch(spark):
    notes = spark.createDataFrame([
        ("D-0001", "first"), ("D-0002", "supersedes D-0001 and D-0999, see D-0003"), ("D-0003", "Replaces\nD-0002/01/77 now"), ("D-0004", "this amends D-0001; supersedes nothing"),
        ("D-0005", "supersedes D-0005. It refines D-0001"), ("D-0006", "supersedes D-0001. It refines D-0002"), ("D-0007", "folds the old\nrule into D-0003"), ("D-0008", None),
        ("D-0009", "revises D-0888 and D-0009"), ("D-0010", "never supersedesD-0001")], "note_id string, text string")
    index = spark.createDataFrame([("D-0004", "open", "D-0010", None), ("D-0007", "Folded", None, "D-0010"), ("D-0008", "superseded", None, None), ("D-0009", "closed", None, None)],
                                  "note_id string, state_raw string, superseded_by string, folded_by string")
    rel = V.supersession_relations(notes, index)
    assert {tuple(r) for r in rel.collect()} == {
        ("D-0002", "supersedes", "D-0001", "text"), ("D-0002", "unresolved", "D-0999", "text"), ("D-0004", "revises", "D-0001", "text"), ("D-0005", "unresolved", "D-0005", "text"),
        ("D-0005", "revises", "D-0001", "text"), ("D-0006", "supersedes", "D-0001", "text"), ("D-0007", "revises", "D-0003", "text"),
        ("D-0010", "supersedes", "D-0004", "index"), ("D-0010", "folds", "D-0007", "index")}
    status = {r.note_id: (r.superseded_by, r.folded_into, r.revised_by, r.unresolved, r.status) for r in V.relation_status(notes, rel, index).collect()}
    assert status["D-0001"] == (2, 0, 2, 0, "superseded") and status["D-0004"] == (1, 0, 0, 0, "superseded") and status["D-0007"] == (0, 1, 0, 0, "folded")
    assert status["D-0008"][4] == "superseded" and status["D-0009"][4] == "closed" and status["D-0003"] == (0, 0, 1, 0, "current") and status["D-0002"][3] == 1
