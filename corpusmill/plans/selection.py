"""Selection queries: fusion of lexical and all-terms channels over the benchmark queries, then every selection step."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import inverted as I
from corpusmill.operators import selection as L
from corpusmill.plans import shapes as S
from corpusmill.plans.registry import query
from corpusmill.plans.search import bench_queries, both_hits, folded_index, lexical_hits
from corpusmill.session import cut_lineage

DEPTH = 20
# Second channel: the same passages matched on folded tokens (accents removed, stopwords kept).
S.register_cte("occ", f"""SELECT query_id, 'rv' || chunk_id AS rvid, 'lexical' AS channel, rank, score FROM lex_hits WHERE rank <= {DEPTH}
  UNION ALL SELECT query_id, 'rv' || chunk_id, 'folded', rank, score FROM fts_hits WHERE rank <= {DEPTH}""", ["lex_hits", "fts_hits"])
S.register_cte("fused", """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, rvid) AS fused_rank FROM (
  SELECT query_id, rvid, sum((1000000 + (60 + rank) // 2) // (60 + rank))::BIGINT AS rrf_score, array_to_string(list_sort(list(channel)), ',') AS channels,
   max(score) AS relevance FROM occ GROUP BY 1, 2)""", ["occ"])
S.register_cte("cands", """SELECT f.query_id, f.rvid, f.fused_rank AS rank, f.rrf_score, f.relevance, r.record_id, r.kind, r.namespace, r.lang, r.source_path AS full_path,
  r.namespace || '/' || r.lang AS source_path, r.content_hash, r.status, r.authority_level, r.n_chars, r.text,
  CASE WHEN l.toxic = 1 THEN 'privacy' WHEN l.quality = 0 THEN 'forbidden' END AS rule, r.status <> 'current' OR r.lang = 'es' AS is_stale,
  CASE f.query_id % 3 WHEN 0 THEN 'current_only' WHEN 1 THEN 'prefer_current' ELSE 'any' END AS q_mode, CASE f.query_id % 2 WHEN 0 THEN 'debug' ELSE 'act' END AS q_stage
  FROM fused f JOIN records r USING (rvid) LEFT JOIN labels l ON l.doc_id = r.doc_id""", ["fused", "records"])
S.register_cte("scored", """SELECT *, rule IS NOT NULL OR (q_mode = 'current_only' AND is_stale) AS hard,
  (relevance + 3000000 * CASE authority_level WHEN 'authoritative' THEN 4 WHEN 'curated' THEN 3 WHEN 'source_material' THEN 2 ELSE 1 END
   + 6000000 * CASE status WHEN 'current' THEN 3 ELSE 1 END + 2000000 * (CASE WHEN namespace = 'src1' THEN 1 ELSE 0 END)
   + 2000000 * (CASE WHEN starts_with(full_path, 'src2') OR starts_with(full_path, 'src3/en') THEN 1 ELSE 0 END)
   + 2000000 * (CASE WHEN (q_stage = 'debug' AND kind = 'failure') OR (q_stage = 'act' AND kind = 'procedure') THEN 1 ELSE 0 END)
   + 2000000 * (CASE WHEN q_stage = 'act' AND kind = 'procedure' THEN 1 ELSE 0 END) + 2000000 * (CASE WHEN q_stage = 'debug' AND kind = 'failure' THEN 1 ELSE 0 END)
   - CASE WHEN rule IS NOT NULL OR (q_mode = 'current_only' AND is_stale) THEN 1000000000 ELSE 0 END
   - CASE WHEN q_mode = 'prefer_current' AND is_stale THEN 20000000 ELSE 0 END)::BIGINT AS base_score FROM cands""", ["cands"])
S.register_cte("ordered", """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY effective_score DESC, rank) AS position FROM (
  SELECT *, base_score - 8000000 * (row_number() OVER (PARTITION BY query_id, source_path ORDER BY base_score DESC, rank) - 1) AS effective_score FROM scored)""", ["scored"])
S.register_cte("budgeted_rows", """SELECT query_id, rvid, position, source_path, ceil(n_chars_c / 4.0)::BIGINT AS tokens,
   CASE WHEN hard THEN 'hard_filter' WHEN dup > 1 THEN 'duplicate_content' END AS blocked, n_chars_c, full_path, record_id, text, status FROM (
   SELECT *, length(text) AS n_chars_c, row_number() OVER (PARTITION BY query_id, content_hash ORDER BY position) AS dup FROM ordered)""", ["ordered"])
S.register_cte("walked", """SELECT query_id, position, rvid, CASE WHEN blocked IS NOT NULL THEN blocked WHEN tokens + 12 > 2000 THEN 'token_budget' ELSE 'selected' END AS outcome,
    CASE WHEN blocked IS NULL AND tokens + 12 <= 2000 THEN tokens + 12 ELSE 0 END AS used, CASE WHEN blocked IS NULL AND tokens + 12 <= 2000 THEN [source_path] ELSE []::VARCHAR[] END AS srcs
   FROM budgeted_rows WHERE position = 1
   UNION ALL SELECT query_id, position, rvid, outcome, used + CASE WHEN outcome = 'selected' THEN tokens + 12 ELSE 0 END,
     CASE WHEN outcome = 'selected' THEN list_append(srcs, source_path) ELSE srcs END FROM (
     SELECT b.query_id, b.position, b.rvid, b.tokens, b.source_path, w.used, w.srcs, CASE WHEN b.blocked IS NOT NULL THEN b.blocked
       WHEN len(list_filter(w.srcs, lambda s: s = b.source_path)) >= 2 THEN 'source_diversity_cap' WHEN len(w.srcs) >= 6 THEN 'max_excerpts'
       WHEN w.used + b.tokens + 12 > 2000 THEN 'token_budget' ELSE 'selected' END AS outcome
     FROM walked w JOIN budgeted_rows b ON b.query_id = w.query_id AND b.position = w.position + 1)""", ["budgeted_rows"])
S.register_cte("outcomes", "SELECT b.*, w.outcome FROM budgeted_rows b JOIN walked w USING (query_id, position, rvid)", ["walked"])


def occurrences(t, hits=None):
    """``hits``: the (lexical, folded) ones, else from the session's indexes."""
    a, b = hits or (lexical_hits(t, DEPTH), I.any_terms(folded_index(t), bench_queries(t), DEPTH))
    of = lambda df, channel: df.select("query_id", F.concat(F.lit("rv"), "chunk_id").alias("rvid"), F.lit(channel).alias("channel"), "rank", "score")
    return of(a, "lexical").unionByName(of(b, "folded"))


def candidates(t, occ=None):
    """The pools; ``occ`` are the written occurrences where they are wanted for something else too."""
    occ = cut_lineage(occurrences(t)) if occ is None else occ
    best = occ.groupBy("query_id", "rvid").agg(F.max("score").alias("relevance"))
    # written before it meets the records, so that Spark knows how small it is and leaves the texts of all others where they are
    pool = cut_lineage(L.fuse(occ).withColumnRenamed("fused_rank", "rank").join(best, ["query_id", "rvid"]))
    r = S.records(t, S.found(t, pool, "rvid", "rv")).withColumnRenamed("source_path", "full_path").withColumn("source_path", F.concat_ws("/", "namespace", "lang"))
    lab = t.labels.select("doc_id", "quality", "toxic")
    q = F.col("query_id")
    # retrieval ends here: the pools (queries x depth rows) are written once, the selection steps start from them
    return cut_lineage(pool.join(r, "rvid").join(lab, "doc_id", "left")
            .withColumn("q_mode", F.when(q % 3 == 0, "current_only").when(q % 3 == 1, "prefer_current").otherwise("any"))
            .withColumn("q_stage", F.when(q % 2 == 0, "debug").otherwise("act")))


def filtered(t, occ=None):
    c = candidates(t, occ).withColumn("group_path", F.col("source_path")).withColumn("source_path", F.col("full_path"))
    rules = c.select("query_id", "source_path", F.lit(None).cast("string").alias("content_hash"),
                     F.when(F.col("toxic") == 1, "privacy").when(F.col("quality") == 0, "forbidden").alias("reason"), F.lit(0).alias("priority")).filter("reason IS NOT NULL")
    stale = c.filter("lang = 'es'").select("query_id", "source_path", "content_hash")
    return L.hard_filter(c, rules, stale)


def ordered(t, occ=None):
    a = F.array(F.lit("src2"), F.lit("src3/en"))
    c = filtered(t, occ).withColumns({"q_namespace": F.lit("src1"), "q_components": a, "q_failures": F.col("q_stage") == "debug"})
    s = L.score_candidates(c)
    return L.diversify(s.withColumn("source_path", F.col("group_path")))


def budgeted(t, occ=None):
    o = ordered(t, occ)
    key = F.concat(F.lit("cch\u0000"), "content_hash")
    return L.collapse_duplicates(o, key)


def outcomes(t, occ=None):
    b = budgeted(t, occ).withColumn("tokens", F.ceil(F.length("text") / F.lit(4)).cast("bigint")).withColumn(
        "blocked", F.when(F.col("hard"), "hard_filter").when(~F.col("cluster_head"), "duplicate_content"))
    return cut_lineage(L.select_within_budget(b, 2000, 6, 2))


@query("rank_fusion", S.with_ctes("fused", "SELECT query_id, rvid, rrf_score, channels, fused_rank FROM fused"))
def _fusion(t):
    return L.fuse(occurrences(t))


@query("hard_filters", S.with_ctes("cands", "SELECT query_id, rvid, rule AS hard_reason, is_stale FROM cands"))
def _hard(t):
    return filtered(t).select("query_id", "rvid", "hard_reason", "is_stale")


@query("feature_scores", S.with_ctes("scored", "SELECT query_id, rvid, rank, base_score, hard FROM scored"))
def _scores(t):
    return ordered(t).select("query_id", "rvid", "rank", "base_score", "hard")


@query("source_diversity", S.with_ctes("ordered", "SELECT query_id, rvid, position, effective_score FROM ordered"))
def _diversity(t):
    return ordered(t).select("query_id", "rvid", "position", "effective_score")


@query("supersession_reorder")
def _reorder(t):
    return L.reorder_superseded(ordered(t), S.supersessions(t)).select("query_id", "rvid", "position", "superseded_demote")


@query("duplicate_collapse", S.with_ctes("ordered", """
SELECT query_id, rvid, 'ec_' || substring(sha256('cch' || chr(0) || content_hash), 1, 16) AS cluster_id, row_number() OVER w = 1 AS cluster_head,
 count(*) OVER (PARTITION BY query_id, content_hash) AS cluster_size, (sum(rrf_score) OVER (PARTITION BY query_id, content_hash))::BIGINT AS cluster_rrf,
 CASE WHEN row_number() OVER w = 1 THEN array_to_string(list(rvid) OVER (PARTITION BY query_id, content_hash ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), ',') END AS members
FROM ordered WINDOW w AS (PARTITION BY query_id, content_hash ORDER BY position)"""))
def _collapse(t):
    return budgeted(t).select("query_id", "rvid", "cluster_id", "cluster_head", "cluster_size", "cluster_rrf", F.array_join("members", ",").alias("members"))


@query("budget_selection", S.with_ctes("outcomes", "SELECT query_id, rvid, position, tokens, outcome FROM outcomes", recursive=True))
def _budget(t):
    return outcomes(t).select("query_id", "rvid", "position", "tokens", "outcome")


@query("budget_accounting", S.with_ctes("outcomes", """
SELECT query_id, (sum(CASE WHEN outcome = 'selected' THEN tokens + 12 ELSE 0 END))::BIGINT AS used, (2000 - sum(CASE WHEN outcome = 'selected' THEN tokens + 12 ELSE 0 END))::BIGINT AS remaining,
 count(*) FILTER (outcome = 'selected') AS excerpts, coalesce(sum(tokens) FILTER (outcome = 'selected'), 0)::BIGINT AS body_tokens, count(*) FILTER (outcome <> 'selected') AS omitted,
 bool_or(outcome IN ('token_budget', 'max_excerpts')) AS truncated FROM outcomes GROUP BY 1""", recursive=True))
def _accounting(t):
    return L.budget_accounting(outcomes(t), 2000)


@query("prefix_expansion", S.with_ctes("lex_hits", """
WITH c AS (SELECT h.query_id, h.rank, d.text, ceil(length(d.text) / 4.0)::BIGINT AS tok FROM lex_hits h JOIN documents d ON d.doc_id = h.chunk_id WHERE rank <= 20),
s AS (SELECT *, sum(tok) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM c)
SELECT query_id, rank, CASE WHEN rank = 1 AND tok > 600 THEN 600 ELSE tok END AS tokens, rank = 1 AND tok > 600 AS truncated,
 sha256(CASE WHEN rank = 1 AND tok > 600 THEN substring(text, 1, 2400) ELSE text END) AS text_hash FROM s WHERE cum <= 600 OR rank = 1"""))
def _prefix(t):
    hits = cut_lineage(lexical_hits(t, 20))
    c = hits.join(S.corpus(t, S.found(t, hits)).select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id").withColumn("rvid", F.col("chunk_id"))
    return L.expand_prefix(c, 600).select("query_id", "rank", "tokens", "truncated", F.sha2("text_out", 256).alias("text_hash"))


@query("window_fit", S.with_ctes("outcomes", """
SELECT query_id, rvid, position, CASE WHEN ceil((sum(n_chars_c) OVER (PARTITION BY query_id ORDER BY position) + 900) / 4.0) <= 1500 THEN 'kept' ELSE 'transport_overflow' END AS fit,
 false AS frame_overflow FROM outcomes WHERE outcome = 'selected'""", recursive=True))
def _fit(t):
    sel = outcomes(t).filter("outcome = 'selected'").withColumn("chars", F.length("text"))
    return L.fit_window(sel, 900, 4000, 2500).select("query_id", "rvid", "position", "fit", "frame_overflow")


# Requirements: some evidence at all, something of a namespace, a literal word, and the record that ranks first for the passage.
S.register_cte("reqs", """SELECT item_id AS query_id, 'any' AS req_id, 'any_evidence' AS type, '' AS value FROM benchmark
  UNION ALL SELECT item_id, 'path', 'path', 'src' || (item_id % 20) || '/' FROM benchmark UNION ALL SELECT item_id, 'literal', 'literal', regexp_extract(text, '[a-z]{6,}') FROM benchmark
  UNION ALL SELECT query_id, 'record', 'record', 'rv' || chunk_id FROM lex_hits WHERE rank = 1""", ["lex_hits"])
S.register_cte("cov", """WITH m AS (SELECT r.query_id, r.req_id, o.rvid, o.outcome FROM reqs r JOIN outcomes o ON r.query_id = o.query_id AND CASE r.type WHEN 'any_evidence' THEN true
    WHEN 'path' THEN starts_with(o.full_path, rtrim(r.value, '/')) WHEN 'literal' THEN r.value <> '' AND contains(lower(o.text || ' ' || o.full_path || ' ' || o.record_id), lower(r.value))
    ELSE o.rvid = r.value OR o.record_id = r.value END)
  SELECT r.query_id, r.req_id, r.type, s.by IS NOT NULL AS satisfied, s.by AS satisfied_by, CASE WHEN s.by IS NULL THEN EXISTS (SELECT 1 FROM m WHERE m.query_id = r.query_id AND m.req_id = r.req_id) END AS expandable
  FROM reqs r LEFT JOIN (SELECT query_id, req_id, array_to_string(list_sort(list_distinct(list(rvid))), ',') AS by FROM m WHERE outcome = 'selected' GROUP BY 1, 2) s USING (query_id, req_id)""", ["reqs", "outcomes"])


def requirements(t, occ):
    """``occ``: the occurrences, whose first lexical ones are records that must be covered."""
    b, q = t.benchmark, F.col("item_id").alias("query_id")
    mk = lambda i, ty, v: b.select(q, F.lit(i).alias("req_id"), F.lit(ty).alias("type"), v.alias("value"))
    top = occ.filter("channel = 'lexical' AND rank = 1").select("query_id", F.lit("record").alias("req_id"), F.lit("record").alias("type"), F.col("rvid").alias("value"))
    return (mk("any", "any_evidence", F.lit("")).union(mk("path", "path", F.concat(F.lit("src"), F.col("item_id") % 20, F.lit("/"))))
            .union(mk("literal", "literal", F.regexp_extract("text", "[a-z]{6,}", 0))).union(top))


def covered(t, occ, out):
    o = out.withColumn("source_path", F.col("full_path"))
    cols = ["query_id", "rvid", "record_id", "source_path", "text"]
    return L.coverage(requirements(t, occ), o.filter("outcome = 'selected'").select(*cols), o.select(*cols))


@query("evidence_coverage", S.with_ctes("cov", "SELECT * FROM cov", recursive=True))
def _coverage(t):
    occ = cut_lineage(occurrences(t, both_hits(t, DEPTH)))
    return covered(t, occ, outcomes(t, occ))


@query("packet_disposition", S.with_ctes("cov", """
WITH f AS (SELECT query_id, bool_or(status <> 'current' AND outcome = 'selected' AND query_id % 5 = 0) AS pf, count(*) FILTER (outcome = 'selected' AND status = 'current') > count(DISTINCT CASE WHEN outcome = 'selected' AND status = 'current' THEN record_id END) AS cf FROM outcomes GROUP BY 1),
m AS (SELECT query_id, count(*) FILTER (NOT satisfied) AS missing, count(*) FILTER (NOT satisfied AND NOT expandable) AS lost FROM cov GROUP BY 1)
SELECT b.item_id AS query_id, CASE WHEN pf THEN 'provenance_failed' WHEN cf THEN 'conflicted' WHEN missing > 0 AND lost = 0 THEN 'needs_expansion' WHEN missing > 0 THEN 'abstain' ELSE 'answerable' END AS disposition
FROM benchmark b LEFT JOIN f ON f.query_id = b.item_id LEFT JOIN m ON m.query_id = b.item_id""", recursive=True))
def _disposition(t):
    return dispositions(t)


def dispositions(t):
    occ = cut_lineage(occurrences(t))
    o = outcomes(t, occ)
    sel, cur = F.col("outcome") == "selected", F.col("status") == "current"
    flags = o.groupBy("query_id").agg(
        F.bool_or(~cur & sel & (F.col("query_id") % 5 == 0)).alias("provenance_failed"),
        (F.count_if(sel & cur) > F.count_distinct(F.when(sel & cur, F.col("record_id")))).alias("conflicted"))
    return L.disposition(bench_queries(t), covered(t, occ, o), flags)


# Decisions: the records read as policy records; French ones stand, German ones are invariants.
S.register_cte("decisions", """SELECT rvid AS decision_id, CASE lang WHEN 'fr' THEN 'standing_prohibition' WHEN 'de' THEN 'invariant' ELSE 'ordinary' END AS binding_scope,
   CASE WHEN status = 'source_stale' THEN 'folded' ELSE status END AS status, EXISTS (SELECT 1 FROM supersessions s WHERE s.dst = r.rvid) AS has_edge,
   CASE WHEN n_chars % 4 = 0 THEN NULL ELSE namespace END AS plane, kind AS module, CASE WHEN n_chars % 5 = 0 THEN 'gate-' || lang ELSE 'none' END AS enforced_by,
   n_chars % 97 AS day, doc_id // 100 AS iteration, authority_level AS authority, 'h' || (doc_id // 500) AS ingested_through FROM records r""", ["records", "supersessions"])


def decisions(t):
    succ = S.supersessions(t).groupBy(F.col("dst").alias("rvid")).agg(F.collect_list("src").alias("superseded_by"))
    n = F.col("n_chars")
    empty = F.array().cast("array<string>")
    return S.records(t).join(succ, "rvid", "left").select(
        F.col("rvid").alias("decision_id"),
        F.when(F.col("lang") == "fr", "standing_prohibition").when(F.col("lang") == "de", "invariant").otherwise("ordinary").alias("binding_scope"),
        F.when(F.col("status") == "source_stale", "folded").otherwise(F.col("status")).alias("status"), "superseded_by",
        F.when(n % 4 == 0, empty).otherwise(F.array("namespace")).alias("planes"), F.array("kind").alias("affected_modules"),
        F.when(n % 5 == 0, F.concat(F.lit("gate-"), "lang")).otherwise("none").alias("enforced_by"), (n % 97).alias("date"),
        F.expr("doc_id div 100").alias("iteration"), F.col("authority_level").alias("authority"), F.concat(F.lit("h"), F.expr("doc_id div 500")).alias("ingested_through"))


@query("standing_decisions", S.with_ctes("decisions", """
WITH g AS (SELECT coalesce(plane, module) AS category, count(*) AS members, count(*) FILTER (enforced_by = 'none') AS hot, count(*) FILTER (enforced_by <> 'none') AS enforced
  FROM decisions WHERE binding_scope <> 'ordinary' AND NOT (status IN ('superseded', 'folded') AND has_edge) GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY category) <= 8 AS pinned, (SELECT sum(members) FROM g)::BIGINT AS asserted_count FROM g"""))
def _standing(t):
    return L.standing_view(decisions(t), 8)


@query("relevant_decisions", S.with_ctes("decisions", """
WITH o AS (SELECT * FROM decisions WHERE binding_scope = 'ordinary' AND status = 'current' ORDER BY day DESC, iteration DESC, decision_id DESC LIMIT 256),
r AS (SELECT * FROM o WHERE plane IN ('src1', 'src2') OR module = 'procedure')
SELECT decision_id, authority, CASE WHEN (SELECT bool_or(ingested_through <> 'h0') FROM decisions) THEN 'stale' ELSE 'current' END AS currentness FROM r
ORDER BY CASE authority WHEN 'authoritative' THEN 4 WHEN 'curated' THEN 3 WHEN 'source_material' THEN 2 ELSE 1 END DESC, decision_id LIMIT 20"""))
def _relevant(t):
    return L.relevant_decisions(decisions(t), ["procedure"], ["src1", "src2"], 20, head="h0").select("decision_id", "authority", "currentness")


@query("stage_funnel", S.with_ctes("outcomes", """
WITH rows AS (SELECT 1 AS stage_no, 'hard_filter' AS stage, CASE WHEN blocked = 'hard_filter' THEN blocked END AS reason FROM outcomes
  UNION ALL SELECT 2, 'collapse', CASE WHEN blocked = 'duplicate_content' THEN blocked END FROM outcomes WHERE coalesce(blocked, '') <> 'hard_filter'
  UNION ALL SELECT 3, 'budget', CASE WHEN outcome <> 'selected' THEN outcome END FROM outcomes WHERE blocked IS NULL),
p AS (SELECT stage_no, stage, coalesce(reason, 'passed') AS reason, count(*) AS n FROM rows GROUP BY ALL)
SELECT *, (sum(n) OVER (PARTITION BY stage_no))::BIGINT AS candidates_in, coalesce(sum(CASE WHEN reason = 'passed' THEN n END) OVER (PARTITION BY stage_no), 0)::BIGINT AS candidates_out FROM p""", recursive=True))
def _funnel(t):
    o = outcomes(t)
    b = F.col("blocked")
    st = lambda no, name, df, reason: df.select(F.lit(no).alias("stage_no"), F.lit(name).alias("stage"), reason.alias("reason"))
    rows = (st(1, "hard_filter", o, F.when(b == "hard_filter", b))
            .union(st(2, "collapse", o.filter("coalesce(blocked, '') <> 'hard_filter'"), F.when(b == "duplicate_content", b)))
            .union(st(3, "budget", o.filter("blocked IS NULL"), F.when(F.col("outcome") != "selected", F.col("outcome")))))
    return L.stage_funnel(rows)
