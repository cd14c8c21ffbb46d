"""Walks over links and cycle membership against closures computed in Python."""

import random

from corpusmill.operators import graph as G


def closure(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    reach = {}
    for a in {x for e in edges for x in e}:
        seen, stack = set(), list(out.get(a, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += out.get(x, ())
        reach[a] = seen
    return reach


def test_walk_equals_closure(spark):
    rng = random.Random(6)
    links, own = set(), {}
    for g in range(30):                                     # chains, cycles, branches, dense knots
        n, base = rng.randrange(2, 12), g * 100
        for i in range(n - 1):
            links.add((base + i, base + i + 1))
        for _ in range(rng.randrange(4)):
            links.add((base + rng.randrange(n), base + rng.randrange(n)))
        for i in range(n):
            if rng.random() < 0.3:
                own[base + i] = (rng.randrange(50), rng.randrange(50, 99))
    reach = closure(links)
    want = set()
    for v in set(reach) | set(own):
        got = [own[x] for x in {v, *reach.get(v, ())} if x in own]
        if got:
            want.add((v, min(a for a, _ in got), max(b for _, b in got)))
    df = G.walk_through(spark.createDataFrame(sorted(links), "node long, over long"), spark.createDataFrame([(k, *v) for k, v in own.items()], "node long, lo long, hi long"))
    assert {(r.node, r.lo, r.hi) for r in df.collect()} == want


def test_long_chain_settles_in_doubling_rounds(spark, monkeypatch):
    written = []
    cut = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(1) or cut(df))
    n = 5000
    links = spark.range(n).selectExpr("id AS node", "id + 1 AS over")
    got = G.walk_through(links, spark.createDataFrame([(n, 7, 7)], "node long, lo long, hi long"))
    assert got.count() == n + 1 and got.filter("lo <> 7").count() == 0
    assert len(written) - 2 <= 2 * 14                       # two tables a round


def test_cycle_members(spark):
    rng = random.Random(9)
    edges = {(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (9, 9), (9, 10)}           # 3 lies between two cycles
    edges |= {(1000 + i, 1000 + (i + 1) % 40) for i in range(40)} | {(1010, 1100), (1100, 1101), (1101, 1030), (1200, 1000)}
    edges |= {(2000 + i, 2001 + i) for i in range(300)}                                   # a loose chain
    for g in range(25):
        n, base = rng.randrange(2, 14), 10_000 + g * 100
        for _ in range(rng.randrange(1, 2 * n)):
            edges.add((base + rng.randrange(n), base + rng.randrange(n)))
    want = {a for a, r in closure(edges).items() if a in r}
    df = spark.createDataFrame(sorted(edges), "src long, dst long")
    comps = {r.id: r.scc for r in G.cycle_components(df).collect()}
    assert set(comps) == want and 3 not in want
    reach = closure(edges)
    assert all((comps[a] == comps[b]) == (b in reach[a] and a in reach[b]) for a in want for b in want)
    assert G.cycle_members(df.limit(0)).count() == 0
