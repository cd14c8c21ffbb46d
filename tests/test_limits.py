"""Chains and paths longer than any fixed number of rounds."""

from corpusmill.operators import graph


def test_long_supersession_chain(spark):
    n = 70
    records = spark.createDataFrame([(f"r{i:03d}", "n", "current" if i == n else "superseded") for i in range(n + 1)], "rvid string, namespace string, status string")
    edges = spark.createDataFrame([(f"r{i + 1:03d}", f"r{i:03d}") for i in range(n)], "src string, dst string")
    live = {r.rvid: r.has_live_successor for r in graph.resolve_supersession(records, edges).collect()}
    assert live == {f"r{i:03d}": i < n for i in range(n + 1)}


def test_deep_relative_reference(spark):
    files = spark.createDataFrame([("x/target.md",), ("target.md",)], "source_path string")
    refs = spark.createDataFrame([("x/a/b/c/d/e/f.md", "../../../../../target.md")], "src_path string, target string")
    assert [(r.resolved, r.how) for r in graph.resolve_refs(refs, files).collect()] == [("x/target.md", "relative")]
