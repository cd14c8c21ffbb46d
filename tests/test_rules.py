"""Rules without a SQL twin against small independent restatements."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunking as C
from corpusmill.operators import evaluation as E
from corpusmill.operators import graph as G
from corpusmill.operators import numbering as N
from corpusmill.operators import search as Q
from corpusmill.operators import selection as L
from corpusmill.operators import textops as P
from corpusmill.operators import timeline as M
from corpusmill.operators import tree as H
from corpusmill.sources import files as SF


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# ---- chunking ----------------------------------------------------------------------------------------------------
def random_text(rng):
    parts = ["", "short", "é" * 7, "word " * 6, "```", "# head", "## sub é", "~~~ x", "   ", "#not a head"]
    return "\n".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) + rng.choice(["", "\n"])


def open_after(text, end):
    """Is a fence open after the first ``end`` bytes?"""
    return sum(bool(re.match(r"\s*(```|~~~)", x)) for x in text.encode()[:end].decode().splitlines()) % 2 == 1


def test_blocks_are_cut_at_the_first_allowed_line(spark):
    rng, most = random.Random(1), 20
    texts = [random_text(rng) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(7)
    got = {}
    for r in sorted(C.chunk_blocks(df, most).collect(), key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).append(r)

    def may_end(text, start, end):
        """May a block that starts at ``start`` end behind the line that stops at ``end``?"""
        body = text.encode()[start:end].decode()
        blank = not body.splitlines()[-1].strip()
        return not open_after(text, end) and (len(body) >= 2 * most or (blank and len(body) >= most))

    for i, text in enumerate(texts):
        raw = text.encode()
        stops = [k + 1 for k, c in enumerate(raw) if c == 10 and k + 1 < len(raw)]
        covered = 0
        for c in got.get(i, []):
            assert raw[c.start:c.end].decode() == c.text and c.text.strip()
            assert not raw[covered:c.start].strip()                        # only blank blocks are left out
            assert c.end == len(raw) or may_end(text, c.start, c.end)
            assert not any(may_end(text, c.start, s) for s in stops if c.start < s < c.end)
            covered = c.end
        assert not raw[covered:].strip()


def test_sections_tile_the_text_and_carry_the_breadcrumb(spark):
    text = "intro\n# A #\nx\n```\n# not\n```\n## B\ny\n# C\nz"
    got = [r.asDict() for r in C.chunk_sections(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), 1000).orderBy("chunk_index").collect()]
    assert [(g["section_path"], g["heading"]) for g in got] == [(None, None), ("A", "A"), ("A / B", "B"), ("C", "C")]
    assert "".join(g["text"] for g in got) == text
    assert [g["end"] for g in got[:-1]] == [g["start"] for g in got[1:]]


def test_outline_skips_fences(spark):
    text = "# A\n```\n# no\n```\n## B\n### C\n## D\n# E"
    got = [(r.title, r.section_path, text.encode()[r.start:r.end].decode()) for r in
           C.outline(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).orderBy("ordinal").collect()]
    assert [g[:2] for g in got] == [("A", "A"), ("B", "A > B"), ("C", "A > B > C"), ("D", "A > D"), ("E", "E")]
    assert got[1][2] == "## B\n### C\n" and got[0][2].endswith("## D\n")


def test_a_fence_closes_on_its_own_mark(spark):
    text = "```\n~~~\n# no\n```\n# yes\n~~~~\n```\n# no\n~~~\n## end"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    assert rows(C.headings(df), "line_no", "title") == [(4, "yes"), (9, "end")]
    assert [text.encode()[r.start:].decode().split("\n")[0] for r in C.headings(df).orderBy("line_no").collect()] == ["# yes", "## end"]


# ---- NULL groups, scopes, labels ---------------------------------------------------------------------------------
def test_null_groups_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, v bigint")
    assert sorted((str(r.g), r.v, r.pos) for r in N.number_rows(df, ["g"], ["v"]).collect()) == [("None", 2, 0), ("None", 3, 1), ("a", 1, 0)]
    got = N.scan_in_order(df, ["g"], ["v"], sums={"s": F.col("v")}, lags={"p": F.col("v")})
    assert sorted((str(r.g), r.v, r.s, r.p) for r in got.collect()) == [("None", 2, 2, None), ("None", 3, 5, 2), ("a", 1, 1, None)]


def test_scope_without_request_is_empty(spark):
    hits = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", None), ("r", "a")], "query_id string, namespace string")
    grant = spark.createDataFrame([("q", "a"), ("r", "a")], "query_id string, namespace string")
    ask = spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, namespace string")
    ok, bad = P.apply_scope(hits, ask, grant)
    assert rows(ok, "query_id", "namespace") == [("q", "a")] and rows(bad, "query_id", "violations") == [("q", 2), ("r", 1)]
    assert P.apply_scope(hits, ask.limit(0), grant)[0].count() == 0


def test_labels_and_objects_in_answers(spark):
    df = spark.createDataFrame([("Label: cat",), ("(cat)",), ("cat!",), ("```json\nCat\n```",), ("plain c here",), ("so c++ it is",)], "answer string").withColumn("truncated", F.lit(False))
    got = [(r.label, r.confidence_pct) for r in P.normalise_labels(df.coalesce(1), ["cat", "c++"], "classify").collect()]
    assert got == [("cat", 80)] * 4 + [(None, 20), ("c++", 60)]
    df = spark.createDataFrame([('a {"k": {"x": 1}} {"k": "2"}',), ('{"k": "1"} }',), ('{"k": ',), ("}{",), ("",), (None,)], "answer string").withColumn("truncated", F.lit(False))
    got = [(r.k, r.parsed) for r in P.normalise_extraction(df.coalesce(1), ["k"]).collect()]
    assert got == [('{"x":1}', True), ("1", True), (None, False), (None, False), (None, False), (None, False)]


def test_references_fold_their_segments(spark):
    files = spark.createDataFrame([("x/t.md",), ("t.md",), ("x/Only.md",)], "source_path string")
    refs = spark.createDataFrame([("x/a.md", "..\\..\\..\\t.md"), ("x/a.md", "'./y/.././t.md'"), ("z/a.md", "q/ONLY.MD"), ("z/a.md", "./../x/t.md")], "src_path string, target string")
    assert [r.resolved for r in G.resolve_refs(refs, files).orderBy("src_path", "target").collect()] == ["x/t.md", "t.md", "x/t.md", "x/Only.md"]


def test_two_chunks_of_a_path_are_two_labels(spark):
    hits = spark.createDataFrame([("q", 1, "p", "h", 1), ("q", 2, "p", "h", 2), ("q", 3, "p", "", 3)], "query_id string, rank bigint, source_path string, content_hash string, chunk_id bigint") \
        .withColumn("status", F.lit("current"))
    labels = spark.createDataFrame([("q", "l1", "required", "p", "h", 1), ("q", "l2", "required", "p", "h", 2), ("q", "l0", "required", "p", "h", 2), ("q", "s", "stale", "p", None, None)],
                                   "query_id string, label_id string, role string, source_path string, content_hash string, chunk_id bigint") \
        .withColumn("group_id", F.lit(None).cast("string")).withColumn("mode", F.lit(None).cast("string"))
    assert rows(E.relevance_flags(hits, labels, ["query_id"]), "rank", "relevant") == [(1, True), (2, True), (3, False)]
    bad = E.bad_hits(hits.select("query_id").distinct(), hits, labels, ["query_id"]).first()
    assert (bad.explicit_stale, bad.wrong_version) == (1, 0)


# ---- files -------------------------------------------------------------------------------------------------------
def test_scan_ledger_and_manifest(spark, tmp_path):
    for p, body in (("a/x.md", "one"), ("a/skip/y.md", "two"), ("b/z.txt", "three"), ("b/z.bin", "four")):
        f = tmp_path / "root" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(body)
    df = SF.scan_corpus(spark, str(tmp_path / "root"), include=["*.md", "*.txt"], exclude_dirs=["skip"])
    assert rows(df, "source_path", "size") == [("a/x.md", 3), ("b/z.txt", 5)]
    assert rows(SF.scan_corpus(spark, str(tmp_path / "root"), max_files=1), "source_path") == [("a/skip/y.md",)]
    ledger = tmp_path / "l.jsonl"
    ledger.write_text('{"kind":"card","target":"t","bytes":3}\n\n{"kind":"card","target":"t","bytes":true}\n{"kind":"card","target":"t","bytes":2.5}\nnope\n')
    good, bad = SF.read_ledger(spark, str(ledger))
    assert rows(good, "kind", "bytes") == [("card", 3)]
    assert rows(bad, "reject_reason") == [("bad_bytes",), ("bad_bytes",), ("invalid_json",)]
    with pytest.raises(Exception, match="bad ledger line"):
        SF.read_ledger(spark, str(ledger), fail_fast=True)[0].collect()
    data = spark.range(100).withColumn("k", F.col("id") % 3)
    m1 = SF.write_with_manifest(data.repartition(5), str(tmp_path / "o1"), str(tmp_path / "m"), ["id", "k"], ["k"], "k")
    m2 = SF.write_with_manifest(data.coalesce(1), str(tmp_path / "o2"), str(tmp_path / "m"), ["id", "k"], kind="k")
    assert rows(m1, "kind", "rows", "digest") == rows(m2, "kind", "rows", "digest")


# ---- numbering, graph, tree --------------------------------------------------------------------------------------
@pytest.mark.parametrize("parts", [1, 7])
def test_numbering_and_scans_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(parts)
    data = [(1 if rng.random() < 0.7 else rng.randint(2, 4), i, rng.randint(0, 9)) for i in range(400)]
    df = spark.createDataFrame(data, "g int, t int, v int").repartition(parts)
    expect, run = [], {}
    for g, t, v in data:
        n, total, prev = run.get(g, (0, 0, None))
        expect.append((g, t, n, total + v, prev))
        run[g] = (n + 1, total + v, v)
    assert rows(N.number_rows(df, ["g"], ["t"], "n", 5), "g", "t", "n") == sorted(e[:3] for e in expect)
    out = N.scan_in_order(df, ["g"], ["t"], {"s": F.col("v")}, {"p": F.col("v")}, {"f": F.when(F.col("v") > 7, F.col("v"))}, 5)
    got = {(r.g, r.t): (r.s, r.p, r.f) for r in out.collect()}
    last: dict = {}
    for (g, t, _, s, p), (_, _, v) in zip(expect, data):
        last[g] = v if v > 7 else last.get(g)
        assert got[(g, t)] == (s, p, last[g])


def walk_live(nodes, succ, start):
    """Per-start walk: through successors that are not current, same namespace only."""
    seen, todo, live = {start}, [start], set()
    while todo:
        for s in succ.get(todo.pop(), ()):
            if s in seen or nodes[s][0] != nodes[start][0]:
                continue
            seen.add(s)
            if nodes[s][1] == "current":
                live.add(s)
            else:
                todo.append(s)
    return bool(live)


def test_live_successors_with_cycles(spark):
    rng = random.Random(3)
    nodes = {f"n{i}": (rng.choice("ab"), rng.choice(["current", "superseded", "superseded"])) for i in range(60)}
    edges = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(80)} | {("n1", "n2"), ("n2", "n1")}
    succ: dict = {}
    for s, d in edges:
        if s != d:
            succ.setdefault(d, set()).add(s)
    r = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "rvid string, namespace string, status string")
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    got = {x.rvid: (x.has_live_successor, x.immediate_live) for x in G.resolve_supersession(r, e).collect()}
    for n in nodes:
        direct = sum(nodes[s][0] == nodes[n][0] and nodes[s][1] == "current" for s in succ.get(n, ()))
        assert got[n] == (walk_live(nodes, succ, n), direct), n


@pytest.mark.parametrize("n,fanout,sizes", [(17, 16, [9, 8]), (33, 16, [11, 11, 11]), (1, 4, [1]), (4, 4, [4])])
def test_even_groups(spark, n, fanout, sizes):
    leaves = spark.createDataFrame([(f"l{i:03d}", "ns", "g", f"{i:03d}") for i in range(n)], "leaf_id string, namespace string, group_key string, content_hash string")
    edges, nodes = H.build_levels(leaves, fanout)
    got = [r.n_children for r in nodes.filter("level = 0").orderBy("idx").collect()]
    assert got == sizes
    assert all(r.violations == 0 for r in H.validate_tree(nodes, edges, fanout).collect())


def test_presence_filter_has_no_false_negatives(spark):
    tokens = spark.range(300).select((F.col("id") % 5).alias("leaf_id"), F.concat(F.lit("tok"), "id").alias("token"))
    bits = H.presence_bits(tokens, "leaf_id")
    missing = tokens.join(bits, "leaf_id").filter(~F.forall(H.presence_positions(F.col("token")), lambda p: F.array_contains("bits", p)))
    assert missing.count() == 0
    import hashlib
    h = hashlib.sha256(b"a6bloom\x00tok7").digest()
    h1, h2 = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:16], "little") | 1
    got = spark.range(1).select(H.presence_positions(F.lit("tok7")).alias("p")).first().p
    assert got == [(h1 + i * h2) % 2048 for i in range(7)]


def test_unbounded_walk_reaches_what_it_must(tables):
    from corpusmill.plans import tree as P

    edges, nodes = P.tree(tables)
    nt = P.node_table(tables, edges, nodes)
    q = P.nav_queries(tables)
    sure, stats = H.descend(q, nt, edges, beam=1 << 30, depth=10)
    lost = q.select("query_id", F.col("query_id").alias("leaf_id")).join(sure, ["query_id", "leaf_id"], "left_anti")
    assert lost.count() == 0 and stats.filter("fallback").count() == 0


# ---- search ------------------------------------------------------------------------------------------------------
def test_containment_never_misses(spark):
    rng = random.Random(5)
    alphabet = ["ab", "abc", "x", "ünter", " ", "-", ", ", "zz", "long word here", "#"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 30))) for _ in range(80)]
    needles = [t[i:i + rng.randint(1, 18)] for t in texts for i in [rng.randrange(len(t))]]
    t = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, hay string")
    q = spark.createDataFrame(list(enumerate(needles)), "query_id bigint, needle string")
    cand = set(rows(Q.containment_candidates(q, t), "query_id", "chunk_id"))
    need = {(i, j) for i, n in enumerate(needles) for j, x in enumerate(texts) if n in x}
    assert need <= cand


def test_embedding_job_statuses_and_determinism(spark):
    t = spark.createDataFrame([(1, "alpha"), (2, "  "), (3, "x" * 100), (4, "beta")], "target_id bigint, text string")
    have = spark.createDataFrame([(4, "s")], "target_id bigint, space_id string")
    run = lambda p: rows(Q.embed_corpus(t.repartition(p), lambda: Q.stand_in_model(4), "s", 10, have), "target_id", "status", "embedding")
    a, b = run(1), run(3)
    assert a == b and [(r[0], r[1], r[2] is not None) for r in a] == [(1, "embedded", True), (2, "empty", False), (3, "oversize", False)]


def test_query_expansion_order_and_cap(spark):
    t = spark.createDataFrame([(1, ["a", "b"], ["L", "L"], ["dir/file.md"], ["failure"])], "task_id int, terms array<string>, literals array<string>, paths array<string>, kinds array<string>")
    got = [(r.mode, r.purpose, r.text, r.path_prefix, r.kind) for r in Q.expand_queries(t).orderBy("query_index").collect()]
    assert got == [("fts", "primary", "a b", "", ""), ("exact", "literal", "L", "", ""), ("exact", "path", "file.md", "", ""),
                   ("fts", "path_scoped", "a b", "dir/file.md", ""), ("fts", "kind:failure", "a b", "", "failure")]


def test_postings_table_round_trip(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma") for i in range(20)], "chunk_id bigint, text string")
    post = Q.postings(chunks)
    Q.save_postings(post, str(tmp_path / "p"), buckets=4)
    terms = spark.createDataFrame([("alpha",), ("beta1",)], "term string")
    back = Q.load_postings(spark, str(tmp_path / "p"), terms, buckets=4)
    assert rows(back, "term", "chunk_id", "tf", "dl") == rows(post.join(terms, "term"), "term", "chunk_id", "tf", "dl")


# ---- selection ---------------------------------------------------------------------------------------------------
def test_diversity_closed_form_equals_the_greedy_loop(spark):
    rng = random.Random(7)
    data = [(q, f"s{rng.randrange(4)}", rng.randrange(6) * 4, r) for q in range(40) for r in range(1, 13)]
    got = {(r.query_id, r.rank): r.position for r in L.diversify(
        spark.createDataFrame(data, "query_id int, source_path string, base_score bigint, rank int"), 8).collect()}
    for q in range(40):
        left, used, place = [d for d in data if d[0] == q], {}, 1
        while left:
            best = min(left, key=lambda d: (-(d[2] - 8 * used.get(d[1], 0)), d[3]))
            left.remove(best)
            used[best[1]] = used.get(best[1], 0) + 1
            assert got[(q, best[3])] == place
            place += 1


def test_successors_come_first_and_cycles_last(spark):
    data = [(1, r, i, False) for i, r in enumerate("abcdef", 1)] + [(2, r, i, False) for i, r in enumerate("abc", 1)] + [(3, "a", 1, False), (3, "b", 2, True)]
    df = spark.createDataFrame(data, "query_id int, rvid string, position bigint, hard boolean")
    e = spark.createDataFrame([("e", "a"), ("f", "e"), ("c", "b"), ("b", "c"), ("zz", "d")], "src string, dst string")
    got = L.reorder_superseded(df, e)
    order = lambda q: [r.rvid for r in got.filter(F.col("query_id") == q).orderBy("position").collect()]
    assert order(1) == ["d", "f", "e", "a", "b", "c"]
    assert order(2) == ["a", "b", "c"] and order(3) == ["a", "b"]


def test_budget_walk_skips_and_goes_on(spark):
    rng = random.Random(9)
    data = [(q, p, f"r{p}", f"s{rng.randrange(3)}", rng.randrange(1, 60), "dup" if rng.random() < 0.1 else None) for q in range(20) for p in range(1, 16)]
    out = L.select_within_budget(spark.createDataFrame(data, "query_id int, position bigint, rvid string, source_path string, tokens bigint, blocked string"), 150, 5, 2, 12)
    got = {(r.query_id, r.position): r.outcome for r in out.collect()}
    for q in range(20):
        used, src = 0, []
        for _, p, _, s, tok, blocked in sorted(d for d in data if d[0] == q):
            want = (blocked or ("source_diversity_cap" if src.count(s) >= 2 else "max_excerpts" if len(src) >= 5 else
                                "token_budget" if used + tok + 12 > 150 else "selected"))
            if want == "selected":
                used, src = used + tok + 12, src + [s]
            assert got[(q, p)] == want


# ---- geometry ----------------------------------------------------------------------------------------------------
def test_assignment_is_exact_and_lexicographic():
    rng = random.Random(11)
    for _ in range(150):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        cost = [[None if rng.random() < 0.3 else rng.randint(0, 3) for _ in range(m)] for _ in range(n)]
        best = None
        for cols in itertools.product(range(m + 1), repeat=n):
            pairs = [(i, j) for i, j in enumerate(cols) if j < m]
            if len({j for _, j in pairs}) < len(pairs) or any(cost[i][j] is None for i, j in pairs):
                continue
            score = (-len(pairs), sum(cost[i][j] for i, j in pairs), cols)
            best = min(best, (score, pairs)) if best else (score, pairs)
        assert M._assign(cost) == best[1]


def test_stable_tracks(spark):
    rows_ = [("m", 0, 0, 0, 0, "cat", 0, 0, 10, 10), ("m", 0, 0, 0, 1, "dog", 0, 0, 10, 10), ("m", 1, 100, 0, 0, "cat", 2, 0, 10, 10),
             ("m", 2, 200, 0, None, None, None, None, None, None), ("m", 3, 300, 0, 0, "cat", 3, 0, 10, 10), ("m", 4, 400, 1, 0, "cat", 3, 0, 10, 10)]
    df = spark.createDataFrame(rows_, "media string, sample bigint, ts bigint, scene bigint, det bigint, class string, x bigint, y bigint, w bigint, h bigint")
    got = rows(M.track_stable(df), "sample", "det", "track", "link", "missed")
    assert got == [(0, 0, 0, "birth", 0), (0, 1, 1, "birth", 0), (1, 0, 0, "iou", 0), (3, 0, 0, "iou", 1), (4, 0, 2, "birth", 0)]
    assert rows(M.gap_rows(M.track_stable(df)), "track", "gaps") == [(0, 1)]


def test_greedy_tracks_coast_and_die(spark):
    rows_ = [("m", f, 0, "a", x, 0, 10, 10) for f, x in ((0, 0), (1, 1), (2, 100), (3, 100), (4, 100), (5, 1))]
    df = spark.createDataFrame(rows_, "media string, frame bigint, det bigint, class string, x bigint, y bigint, w bigint, h bigint")
    assert [r.track for r in M.track_greedy(df, 0.3, 2).orderBy("frame").collect()] == [0, 0, 1, 1, 1, 2]


def test_nms_keeps_the_best(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.9, 0, 0, 10, 10), (1, "a", 2, 0.8, 1, 0, 11, 10), (1, "a", 3, 0.7, 50, 50, 60, 60), (1, "b", 4, 0.1, 0, 0, 10, 10)],
                               "image int, class string, id int, score double, x1 int, y1 int, x2 int, y2 int")
    assert rows(M.nms(df, 0.5), "class", "id", "keep_order") == [("a", 1, 1), ("a", 3, 2), ("b", 4, 1)]


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(13)
    base = ["".join(rng.choice("01") for _ in range(32)) for _ in range(15)]
    codes = base + ["".join(c if rng.random() > 0.08 else "10"[int(c)] for c in b) for b in base] + [base[0]] * 5
    pairs, members = M.near_dup_pairs(spark.createDataFrame(list(enumerate(codes)), "id int, bits string"), 4, 32)
    dist = lambda a, b: sum(x != y for x, y in zip(a, b))
    want = sorted((a, b, dist(a, b)) for a in set(codes) for b in set(codes) if a < b and dist(a, b) <= 4)
    assert rows(pairs, "hash_a", "hash_b", "distance") == want and members.count() == len(codes)
