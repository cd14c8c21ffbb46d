"""Evaluation queries. Passages contained in documents are the labels, BM25 hits are what is measured."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import evaluation as E
from corpusmill.operators import search as Q
from corpusmill.plans import shapes as S
from corpusmill.plans.registry import all_sql, query
from corpusmill.plans.search import bench_queries, lexical_hits, vector_hits
from corpusmill.plans.selection import dispositions, ordered, outcomes
from corpusmill.session import cut_lineage

KS = [1, 5, 10]
DEPTH = 20


def pp(n: str, d: str, e: int = 0) -> str:
    return f"(CASE WHEN ({d}) <= 0 THEN {e} ELSE (({n}) * 1000000 + ({d}) // 2) // ({d}) END)::BIGINT"


def mean(c: str, n: str = "count(*)") -> str:
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE (sum({c}) + {n} // 2) // {n} END)::BIGINT"


S.register_cte("contained", "SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
# The expected version of a French source is its edited text, so its hits are of the wrong version.
S.register_cte("elabels", """SELECT query_id, 'req' || doc_id AS label_id, 'required' AS role, 'g_any' AS group_id, 'any' AS mode, c.source_path,
    CASE WHEN c.lang = 'fr' THEN sha256(c.text || ' rev2') WHEN c.lang = 'en' THEN c.content_hash END AS content_hash FROM contained JOIN corpus c USING (doc_id)
  UNION ALL SELECT query_id, 'all' || doc_id, 'evidence', 'g_all', 'all', c.source_path, NULL FROM contained JOIN corpus c USING (doc_id)
  UNION ALL SELECT h.query_id, 'bad' || h.chunk_id, CASE WHEN l.toxic = 1 THEN 'forbidden' ELSE 'distractor' END, NULL, NULL, h.source_path, NULL
    FROM (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, d.source || '/' || d.lang || '/' || d.doc_id AS source_path FROM benchmark b JOIN documents d ON b.item_id % 20 = substring(d.source, 4)::INT) h
    JOIN labels l ON l.doc_id = h.chunk_id WHERE l.toxic = 1 OR l.quality = 0""", ["corpus", "contained"])
S.register_cte("ehits", f"""SELECT h.query_id, h.rank, h.chunk_id, h.source_path, r.content_hash, r.status, r.namespace, ceil(length(r.text) / 4.0)::BIGINT AS tokens, h.score
  FROM lex_hits h JOIN records r ON r.doc_id = h.chunk_id WHERE h.rank <= {DEPTH}""", ["lex_hits", "records"])
S.register_cte("equeries", "SELECT item_id AS query_id, NOT EXISTS (SELECT 1 FROM contained c WHERE c.query_id = item_id) AS no_answer_expected FROM benchmark", ["contained"])


def passage_pairs(t):
    """Exact containment of a passage in a document, found through shared inner words, then verified."""
    q = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    texts = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("hay"))
    cand = Q.containment_candidates(q, texts)
    return texts.join(cand, "chunk_id").join(q, "query_id").filter(F.contains("hay", "needle")).select("query_id", F.col("chunk_id").alias("doc_id"))


@query("passage_labels", S.with_ctes("contained", "SELECT * FROM contained"))
def _passages(t):
    return passage_pairs(t)


class Fixture:
    """Labels, queries and hits of one evaluation; the small tables are cut from their lineage because many metrics read them."""

    def __init__(self, t):
        self.t = t
        c = S.corpus(t).select("doc_id", "source_path", "lang", "content_hash", F.sha2(F.concat("text", F.lit(" rev2")), 256).alias("rev2"), "namespace")
        pairs = cut_lineage(passage_pairs(t)).join(c, "doc_id")
        no = F.lit(None).cast("string")
        req = pairs.select(
            "query_id", F.concat(F.lit("req"), "doc_id").alias("label_id"), F.lit("required").alias("role"), F.lit("g_any").alias("group_id"), F.lit("any").alias("mode"),
            "source_path", F.when(F.col("lang") == "fr", F.col("rev2")).when(F.col("lang") == "en", F.col("content_hash")).alias("content_hash"))
        ev = pairs.select("query_id", F.concat(F.lit("all"), "doc_id"), F.lit("evidence"), F.lit("g_all"), F.lit("all"), "source_path", no)
        judged = c.join(t.labels.filter("toxic = 1 OR quality = 0"), "doc_id")
        bad = t.benchmark.select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("namespace")).join(judged, "namespace").select(
            "query_id", F.concat(F.lit("bad"), "doc_id"), F.when(F.col("toxic") == 1, "forbidden").otherwise("distractor"), no, no, "source_path", no)
        self.labels = cut_lineage(req.union(ev).union(bad))
        has = self.labels.filter("role = 'required'").select("query_id").distinct().withColumn("_h", F.lit(True))
        self.queries = bench_queries(t).select("query_id").join(has, "query_id", "left").select("query_id", F.col("_h").isNull().alias("no_answer_expected"))
        hits = cut_lineage(lexical_hits(t, DEPTH))
        r = S.records(t, S.found(t, hits)).select(F.col("doc_id").alias("chunk_id"), "content_hash", "status", "namespace", F.ceil(F.length("text") / F.lit(4)).cast("bigint").alias("tokens"))
        self.hits = cut_lineage(hits.join(r, "chunk_id"))


@query("label_matching", S.with_ctes("elabels ehits", """
SELECT h.query_id, h.rank, l.label_id, l.role FROM ehits h JOIN elabels l ON h.query_id = l.query_id AND h.source_path = l.source_path AND (l.content_hash IS NULL OR l.content_hash = h.content_hash)"""))
def _match(t):
    f = Fixture(t)
    return E.match_labels(f.hits, f.labels).select("query_id", "rank", "label_id", "role")


S.register_cte("e_recall", f"""WITH m AS (SELECT h.query_id, l.label_id, min(h.rank) AS first FROM ehits h JOIN elabels l ON l.role = 'required' AND h.query_id = l.query_id AND h.source_path = l.source_path
    AND (l.content_hash IS NULL OR l.content_hash = h.content_hash) GROUP BY 1, 2), n AS (SELECT query_id, count(*) AS n FROM elabels WHERE role = 'required' GROUP BY 1),
   a AS (SELECT query_id, min(first) AS f, {', '.join(f"count(*) FILTER (first <= {k}) AS m{k}" for k in KS)} FROM m GROUP BY 1)
  SELECT q.query_id, coalesce(n.n, 0) AS num_required, {', '.join(f"coalesce(m{k}, 0) AS matched_at_{k}, {pp(f'coalesce(m{k}, 0)', 'coalesce(n.n, 0)', 1000000)} AS recall_at_{k}" for k in KS)},
   coalesce(f, 0) AS first_relevant_rank, (CASE WHEN f > 0 THEN (1000000 + f // 2) // f ELSE 0 END)::BIGINT AS rr FROM equeries q LEFT JOIN n USING (query_id) LEFT JOIN a USING (query_id)""", ["ehits", "elabels", "equeries"])


@query("recall_mrr", S.with_ctes("e_recall", "SELECT * FROM e_recall"))
def _recall(t):
    f = Fixture(t)
    return E.recall_mrr(f.queries, f.hits, f.labels, KS)


# One chunk per path and one label per path once duplicates are dropped, so crediting is the plain first match here.
S.register_cte("e_rel", """SELECT h.*, EXISTS (SELECT 1 FROM elabels l WHERE l.role IN ('required', 'evidence') AND l.query_id = h.query_id AND l.source_path = h.source_path
   AND (l.content_hash IS NULL OR l.content_hash = h.content_hash)) AS relevant FROM ehits h""", ["ehits", "elabels"])
_G = "1000000000000 // floor(log2({r} + 1) * 1000000 + 0.5)::BIGINT"
S.register_cte("e_prec", f"""WITH n AS (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT query_id, source_path, content_hash FROM elabels WHERE role IN ('required', 'evidence')) GROUP BY 1),
   a AS (SELECT query_id, count(*) AS h, {', '.join(f"count(*) FILTER (relevant AND rank <= {k}) AS r{k}, sum({_G.format(r='rank')}) FILTER (relevant AND rank <= {k}) AS d{k}" for k in KS)} FROM e_rel GROUP BY 1),
   g AS (SELECT i, sum({_G.format(r='i')}) OVER (ORDER BY i) AS idcg FROM range(1, 11) t(i))
  SELECT q.query_id, coalesce(h, 0) AS n_hits, {', '.join(f"{pp(f'coalesce(r{k}, 0)', f'least(coalesce(h, 0), {k})', 1000000)} AS precision_at_{k}, {pp(f'coalesce(d{k}, 0)', f'coalesce((SELECT idcg FROM g WHERE i = least(coalesce(n.n, 0), {k})), 0)', 1000000)} AS ndcg_at_{k}" for k in KS)}
  FROM equeries q LEFT JOIN a USING (query_id) LEFT JOIN n USING (query_id)""", ["e_rel", "equeries"])


@query("precision_ndcg", S.with_ctes("e_prec", "SELECT * FROM e_prec"))
def _precision(t):
    f = Fixture(t)
    return E.precision_ndcg(f.queries, E.relevance_flags(f.hits, f.labels), f.labels, KS)


S.register_cte("e_groups", f"""WITH m AS (SELECT l.query_id, l.group_id, l.mode, l.label_id, EXISTS (SELECT 1 FROM ehits h WHERE h.query_id = l.query_id AND h.source_path = l.source_path
     AND (l.content_hash IS NULL OR l.content_hash = h.content_hash)) AS hit FROM elabels l WHERE group_id IS NOT NULL),
   g AS (SELECT query_id, group_id, CASE WHEN mode = 'all' THEN bool_and(hit) ELSE bool_or(hit) END AS ok FROM m GROUP BY query_id, group_id, mode),
   a AS (SELECT query_id, count(*) AS n, count(*) FILTER (ok) AS k FROM g GROUP BY 1)
  SELECT query_id, coalesce(n, 0) AS groups_total, coalesce(k, 0) AS groups_satisfied, {pp('coalesce(k, 0)', 'coalesce(n, 0)', 1000000)} AS coverage FROM equeries LEFT JOIN a USING (query_id)""", ["ehits", "elabels", "equeries"])


@query("evidence_groups", S.with_ctes("e_groups", "SELECT * FROM e_groups"))
def _groups(t):
    f = Fixture(t)
    return E.group_coverage(f.queries, f.hits, f.labels)


S.register_cte("e_bad", f"""WITH h AS (SELECT h.*, status <> 'current' AS st, EXISTS (SELECT 1 FROM elabels l WHERE l.role = 'forbidden' AND l.query_id = h.query_id AND l.source_path = h.source_path) AS fb,
     EXISTS (SELECT 1 FROM elabels l WHERE l.role = 'distractor' AND l.query_id = h.query_id AND l.source_path = h.source_path) AS ds,
     coalesce((SELECT min(l.content_hash) FROM elabels l WHERE l.role = 'required' AND l.query_id = h.query_id AND l.source_path = h.source_path) <> h.content_hash, false) AS wr FROM ehits h),
   a AS (SELECT query_id, count(*) AS n_hits, 0::BIGINT AS explicit_stale, count(*) FILTER (wr) AS wrong_version, count(*) FILTER (st) AS stale_status, count(*) FILTER (fb) AS forbidden, 0::BIGINT AS privacy,
     count(*) FILTER (ds) AS distractor, count(*) FILTER (fb OR ds OR wr) AS judged_irrelevant, bool_or(rank = 1 AND (fb OR wr)) AS top1_bad FROM h GROUP BY 1)
  SELECT query_id, coalesce(n_hits, 0) AS n_hits, coalesce(explicit_stale, 0) AS explicit_stale, coalesce(wrong_version, 0) AS wrong_version, coalesce(stale_status, 0) AS stale_status, coalesce(forbidden, 0) AS forbidden,
   coalesce(privacy, 0) AS privacy, coalesce(distractor, 0) AS distractor, coalesce(judged_irrelevant, 0) AS judged_irrelevant, coalesce(top1_bad, false) AS top1_bad, coalesce(wrong_version + stale_status, 0) > 0 AS stale_affected,
   {pp('coalesce(wrong_version + stale_status, 0)', 'coalesce(n_hits, 0)')} AS stale_rate, {pp('coalesce(judged_irrelevant, 0)', 'coalesce(n_hits, 0)')} AS irrelevant_rate FROM equeries LEFT JOIN a USING (query_id)""", ["ehits", "elabels", "equeries"])


@query("bad_hits", S.with_ctes("e_bad", "SELECT * FROM e_bad"))
def _bad(t):
    f = Fixture(t)
    return E.bad_hits(f.queries, f.hits, f.labels)


S.register_cte("e_div", f"""WITH a AS (SELECT query_id, count(*) AS n, count(*) - count(DISTINCT content_hash) AS d, {', '.join(f"count(DISTINCT CASE WHEN rank <= {k} THEN namespace END) AS s{k}" for k in KS)} FROM ehits GROUP BY 1)
  SELECT query_id, {pp('coalesce(d, 0)', 'coalesce(n, 0)')} AS duplicate_burden, {', '.join(f"{pp(f'coalesce(s{k}, 0)', f'least(coalesce(n, 0), {k})', 1000000)} AS diversity_at_{k}" for k in KS)} FROM equeries LEFT JOIN a USING (query_id)""", ["ehits", "equeries"])


@query("duplicates_and_diversity", S.with_ctes("e_div", "SELECT * FROM e_div"))
def _dups(t):
    f = Fixture(t)
    return E.dup_and_diversity(f.queries, f.hits.withColumn("source_path", F.col("namespace")), F.col("content_hash"), KS)


@query("provenance_validation", S.with_ctes("ehits", """
WITH p AS (SELECT h.*, r.lang, r.text, r.content_hash AS chash, octet_length(encode(r.text)) AS nb FROM ehits h JOIN records r ON r.doc_id = h.chunk_id),
q AS (SELECT query_id, rank, CASE lang WHEN 'fr' THEN sha256(text || ' rev2') ELSE content_hash END AS content_hash, chash, status, lang, text, nb,
  CASE WHEN lang = 'es' THEN nb + 5 ELSE nb END AS e, lang <> 'de' AS exists FROM p)
SELECT query_id, rank, array_to_string(list_filter([
  CASE WHEN NOT (CASE WHEN exists THEN content_hash = chash ELSE status = 'deleted' END) THEN 'content_hash_matches_source' END,
  CASE WHEN NOT exists OR e > nb THEN 'snippet_derives_from_span' END, CASE WHEN NOT exists THEN 'source_exists_or_tombstoned' END, CASE WHEN NOT exists OR e > nb THEN 'span_in_bounds' END,
  CASE WHEN NOT (CASE WHEN exists AND content_hash = chash THEN status = 'current' ELSE status <> 'current' END) THEN 'status_correct' END], lambda x: x IS NOT NULL), ',') AS failed_checks FROM q"""))
def _provenance(t):
    f = Fixture(t)
    c = S.corpus(t, S.found(t, f.hits))
    lens = c.select(F.col("doc_id").alias("chunk_id"), "lang", F.octet_length("text").cast("bigint").alias("nb"), F.sha2(F.concat("text", F.lit(" rev2")), 256).alias("rev2"),
                    F.substring(E.collapse_ws(F.substring("text", 1, 60)), 1, 20).alias("snippet"))
    h = f.hits.join(lens, "chunk_id").withColumn("content_hash", F.when(F.col("lang") == "fr", F.col("rev2")).otherwise(F.col("content_hash"))).withColumn(
        "span_start", F.lit(0).cast("bigint")).withColumn("span_end", F.when(F.col("lang") == "es", F.col("nb") + 5).otherwise(F.col("nb")))
    known = c.filter("lang <> 'de'").select("source_path", F.col("content_hash").alias("corpus_hash"), F.col("text").alias("corpus_text"))
    return E.validate_provenance(h, known).select("query_id", "rank", F.array_join("failed_checks", ",").alias("failed_checks"))


S.register_cte("e_tok", f"""WITH a AS (SELECT query_id, count(*) AS n, sum(tokens) AS tok, sum(tokens) FILTER (relevant) AS rt,
     count(*) FILTER (EXISTS (SELECT 1 FROM elabels l WHERE l.role = 'distractor' AND l.query_id = e_rel.query_id AND l.source_path = e_rel.source_path)) AS dh FROM e_rel GROUP BY 1),
   d AS (SELECT DISTINCT query_id FROM elabels WHERE role = 'distractor')
  SELECT q.query_id, {pp('coalesce(rt, 0)', 'coalesce(tok, 0)')} AS relevant_token_ratio, coalesce(n, 0) = 0 AS abstained,
   no_answer_expected AND CASE WHEN d.query_id IS NOT NULL THEN coalesce(dh, 0) > 0 ELSE coalesce(n, 0) > 0 END AS no_answer_false_positive, no_answer_expected
  FROM equeries q LEFT JOIN a USING (query_id) LEFT JOIN d USING (query_id)""", ["e_rel", "equeries"])


@query("tokens_and_abstention", S.with_ctes("e_tok", "SELECT * FROM e_tok"))
def _tokens(t):
    f = Fixture(t)
    return E.token_and_abstain(f.queries, E.relevance_flags(f.hits, f.labels), f.labels)


_AGG = f"""SELECT count(*) AS num_queries, {', '.join(f"{mean(f'recall_at_{k}')} AS recall_at_{k}_macro, {mean(f'precision_at_{k}')} AS precision_at_{k}_macro, {mean(f'ndcg_at_{k}')} AS ndcg_at_{k}_macro, {mean(f'diversity_at_{k}')} AS diversity_at_{k}_macro, {pp(f'sum(matched_at_{k})', 'sum(num_required)', 1000000)} AS recall_at_{k}_micro" for k in KS)},
  {mean('rr')} AS rr_macro, (CASE WHEN count(*) FILTER (groups_total > 0) = 0 THEN 1000000 ELSE (sum(CASE WHEN groups_total > 0 THEN coverage ELSE 0 END) + count(*) FILTER (groups_total > 0) // 2) // count(*) FILTER (groups_total > 0) END)::BIGINT AS group_coverage_macro,
  {pp('count(*) FILTER (stale_affected)', 'count(*)')} AS stale_source_rate, {mean('stale_rate')} AS stale_rate_macro, {pp('count(*) FILTER (forbidden > 0)', 'count(*)')} AS forbidden_rate,
  {pp('count(*) FILTER (privacy > 0)', 'count(*)')} AS privacy_rate, {mean('irrelevant_rate')} AS irrelevant_rate_macro, {mean('duplicate_burden')} AS duplicate_burden_macro, {mean('relevant_token_ratio')} AS relevant_token_ratio_macro,
  {pp('count(*) FILTER (no_answer_false_positive)', 'count(*) FILTER (no_answer_expected)')} AS no_answer_fp_rate
 FROM e_recall JOIN e_prec USING (query_id) JOIN e_groups USING (query_id) JOIN e_bad USING (query_id) JOIN e_div2 USING (query_id) JOIN e_tok USING (query_id)"""
S.register_cte("e_div2", f"""WITH a AS (SELECT query_id, count(*) AS n, count(*) - count(DISTINCT content_hash) AS d, {', '.join(f"count(DISTINCT CASE WHEN rank <= {k} THEN source_path END) AS s{k}" for k in KS)} FROM ehits GROUP BY 1)
  SELECT query_id, {pp('coalesce(d, 0)', 'coalesce(n, 0)')} AS duplicate_burden, {', '.join(f"{pp(f'coalesce(s{k}, 0)', f'least(coalesce(n, 0), {k})', 1000000)} AS diversity_at_{k}" for k in KS)} FROM equeries LEFT JOIN a USING (query_id)""", ["ehits", "equeries"])


@query("evaluation_report", S.with_ctes("e_recall e_prec e_groups e_bad e_div2 e_tok", _AGG))
def _report(t):
    f = Fixture(t)
    return E.aggregate_eval(E.evaluate(f.queries, f.hits, f.labels, KS, F.col("content_hash")), KS)


def staged(f):
    """Raw hits, and the same with non-current records taken out, as two stages of one hit table."""
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy("rank")
    cur = f.hits.filter("status = 'current'").withColumn("rank", F.row_number().over(w).cast("bigint"))
    hits = f.hits.withColumn("stage", F.lit("raw")).unionByName(cur.withColumn("stage", F.lit("current")))
    stages = F.explode(F.array(F.lit("raw"), F.lit("current"))).alias("stage")
    return f.queries.select("*", stages), hits


S.register_cte("ehits_cur", "SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM ehits WHERE status = 'current'", ["ehits"])
_ST = f"""WITH h AS (SELECT 'raw' AS stage, * FROM ehits UNION ALL SELECT 'current', * FROM ehits_cur), q AS (SELECT s AS stage, query_id FROM equeries, unnest(['raw', 'current']) u(s)),
 m AS (SELECT h.stage, h.query_id, l.label_id, min(h.rank) AS first FROM h JOIN elabels l ON l.role = 'required' AND h.query_id = l.query_id AND h.source_path = l.source_path AND (l.content_hash IS NULL OR l.content_hash = h.content_hash) GROUP BY ALL),
 n AS (SELECT query_id, count(*) AS n FROM elabels WHERE role = 'required' GROUP BY 1),
 p AS (SELECT q.stage, q.query_id, coalesce(max(n.n), 0) AS n, min(first) AS f, count(*) FILTER (first <= 1) AS m1, count(*) FILTER (first <= 5) AS m5, count(*) FILTER (first <= 10) AS m10 FROM q LEFT JOIN n USING (query_id) LEFT JOIN m USING (stage, query_id) GROUP BY ALL),
 r AS (SELECT *, {', '.join(f"{pp(f'm{k}', 'n', 1000000)} AS r{k}" for k in KS)}, CASE WHEN f > 0 THEN (1000000 + f // 2) // f ELSE 0 END AS rr FROM p)"""


@query("stage_metrics", S.with_ctes("elabels ehits_cur equeries", _ST + f"SELECT stage, count(*) AS num_queries, {', '.join(f'{mean(f'r{k}')} AS recall_at_{k}' for k in KS)}, {mean('rr')} AS mrr FROM r GROUP BY 1"))
def _stages(t):
    f = Fixture(t)
    q, hits = staged(f)
    per = E.recall_mrr(q, hits, f.labels, KS, ["stage", "query_id"])
    n = F.count("*")
    return per.groupBy("stage").agg(n.alias("num_queries"), *[E.mean_ppm(E.lsum(F.col(f"recall_at_{k}")), n).alias(f"recall_at_{k}") for k in KS],
                                    E.mean_ppm(E.lsum(F.col("rr")), n).alias("mrr"))


@query("run_comparison", S.with_ctes("elabels ehits_cur equeries", _ST + """
SELECT a.query_id, b.r1 > a.r1 AS rescued, (b.r1 - a.r1)::BIGINT AS delta_recall_at_1, (b.r5 - a.r5)::BIGINT AS delta_recall_at_5, (b.r10 - a.r10)::BIGINT AS delta_recall_at_10, (b.rr - a.rr)::BIGINT AS delta_rr
FROM r a JOIN r b USING (query_id) WHERE a.stage = 'raw' AND b.stage = 'current'"""))
def _compare(t):
    f = Fixture(t)
    q, hits = staged(f)
    ev = cut_lineage(E.evaluate(q, hits, f.labels, KS, F.col("content_hash"), ["stage", "query_id"]))
    pick = lambda s: ev.filter(F.col("stage") == s).drop("stage")
    return E.compare_runs(pick("raw"), pick("current"), KS).select("query_id", "rescued", *[f"delta_recall_at_{k}" for k in KS], "delta_rr")


# Two channels over vectors: the exemplar's own neighbours, and a "lexical" one that ranks the vectors of its label by id.
@query("channel_attribution", S.with_ctes("vec_hits", """
WITH lex AS (SELECT label AS query_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS lr FROM embeddings),
u AS (SELECT query_id, vec_id, max(lr) AS lr, max(vr) AS vr FROM (SELECT query_id, vec_id, lr, NULL AS vr FROM lex WHERE lr <= 15 UNION ALL SELECT query_id, target_id, NULL, rank FROM vec_hits WHERE rank <= 15) GROUP BY 1, 2),
s AS (SELECT *, coalesce((1000000 + (60 + lr) // 2) // (60 + lr), 0) + coalesce((1000000 + (60 + vr) // 2) // (60 + vr), 0) AS rrf FROM u),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, vec_id) AS fr FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lr NULLS LAST, fr) AS lo FROM f)
SELECT o.query_id, count(lr) AS lexical_hits, count(vr) AS vector_hits, count(*) FILTER (vr IS NULL) AS unique_to_lexical, count(*) FILTER (lr IS NULL) AS unique_to_vector, count(*) FILTER (fr > lr) AS demoted_by_fusion,
 bool_or(lr IS NULL OR lo <> fr) AS fusion_reordered, count(*) FILTER (lr IS NULL AND e.label = o.query_id) AS rescued_by_vector FROM o JOIN embeddings e USING (vec_id) GROUP BY 1"""))
def _channels(t):
    from pyspark.sql import Window as W

    from corpusmill.operators import selection as L

    w = W.partitionBy("label").orderBy("vec_id")
    lex = t.embeddings.select(F.col("label").alias("query_id"), F.col("vec_id").alias("rvid"), F.row_number().over(w).alias("rank")).filter("rank <= 15")
    occ = cut_lineage(lex.withColumn("channel", F.lit("lexical")).unionByName(vector_hits(t, 15).select("query_id", F.col("target_id").alias("rvid"), "rank", F.lit("vector").alias("channel"))))
    per = occ.groupBy("query_id", "rvid").agg(F.max(F.when(F.col("channel") == "lexical", F.col("rank"))).alias("lexical_rank"), F.max(F.when(F.col("channel") == "vector", F.col("rank"))).alias("vector_rank"))
    hits = L.fuse(occ).join(per, ["query_id", "rvid"]).withColumn("rank", F.col("fused_rank")).withColumn("source_path", F.col("rvid").cast("string")).withColumn("content_hash", F.lit("v"))
    labels = t.embeddings.select(F.col("label").alias("query_id"), F.col("vec_id").alias("label_id"), F.lit("required").alias("role"), F.lit(None).cast("string").alias("group_id"),
                                 F.lit(None).cast("string").alias("mode"), F.col("vec_id").cast("string").alias("source_path"), F.lit(None).cast("string").alias("content_hash"))
    return E.channel_attribution(hits, labels)


@query("selection_conformance", S.with_ctes("supersessions outcomes", """
WITH o AS (SELECT o.*, r.namespace, CASE o.query_id % 3 WHEN 0 THEN 'current_only' ELSE 'any' END AS mode FROM outcomes o JOIN records r USING (rvid)),
g AS (SELECT DISTINCT item_id AS query_id, source AS namespace FROM benchmark, documents WHERE lang <> 'de' AND length(source) = 4),
p AS (SELECT a.query_id, a.rvid, a.position AS hp, arg_min(b.position, b.rvid) AS sp FROM o a JOIN supersessions s ON s.dst = a.rvid JOIN o b ON b.rvid = s.src AND b.query_id = a.query_id WHERE a.outcome = 'selected' AND b.outcome = 'selected' GROUP BY 1, 2, 3)
SELECT o.query_id, count(*) AS candidates, count(*) FILTER (outcome = 'selected') AS selected, count(*) FILTER (g.namespace IS NULL) AS cross_candidates, count(*) FILTER (g.namespace IS NULL AND outcome = 'selected') AS cross_selected,
 count(*) FILTER (status <> 'current') AS stale_candidates, count(*) FILTER (mode = 'current_only' AND outcome = 'selected' AND status <> 'current') AS stale_leaks,
 count(*) FILTER (mode = 'current_only' AND outcome = 'selected' AND status <> 'current') AS noncurrent_leaks,
 (SELECT count(*) FROM p WHERE p.query_id = o.query_id) AS pairs, (SELECT count(*) FROM p WHERE p.query_id = o.query_id AND sp < hp) AS pairs_in_order
FROM o LEFT JOIN g ON g.query_id = o.query_id AND g.namespace = o.namespace GROUP BY o.query_id""", recursive=True))
def _conformance(t):
    o = outcomes(t).withColumn("selection_rank", F.col("position")).withColumn("selected", F.col("outcome") == "selected").withColumn(
        "mode", F.when(F.col("query_id") % 3 == 0, "current_only").otherwise("any")).withColumn("effective_current", F.lit(None).cast("boolean"))
    ns = t.documents.filter("lang <> 'de' AND length(source) = 4").select(F.col("source").alias("namespace")).distinct()
    grants = o.select("query_id", "namespace").distinct().join(ns, "namespace", "left_semi")
    return E.selection_conformance(o, grants, S.supersessions(t))


@query("reason_codes", S.with_ctes("scored", """
SELECT code AS reason_code, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN rule IS NOT NULL THEN 'hard_filter_' || rule END, CASE WHEN q_mode = 'current_only' AND is_stale THEN 'hard_filter_stale' END,
  CASE WHEN q_mode = 'prefer_current' AND is_stale THEN 'stale_demote' END, 'authority_boost', 'fusion_rrf'], lambda x: x IS NOT NULL)) AS code FROM scored) GROUP BY 1"""))
def _codes(t):
    return E.reason_code_coverage(ordered(t))


@query("disposition_accuracy", f"""
WITH j AS (SELECT CASE WHEN length(text) > 400 THEN 'answerable' ELSE 'abstain' END AS expected, disposition AS actual, count(*) AS n
  FROM benchmark JOIN ({all_sql()["packet_disposition"]}) ON query_id = item_id WHERE length(text) > 200 GROUP BY 1, 2)
SELECT expected, actual, n, (SELECT {pp("coalesce(sum(n) FILTER (expected = actual), 0)", "sum(n)", 1000000)} FROM j) AS accuracy FROM j""")
def _disposition_accuracy(t):
    expected = t.benchmark.select(F.col("item_id").alias("query_id"), F.when(F.length("text") > 400, "answerable").when(F.length("text") > 200, "abstain").alias("expected"))
    return E.disposition_accuracy(dispositions(t), expected)


@query("tier_calibration", """
WITH r AS (SELECT event_id AS item_id, CASE WHEN value > 30 THEN 'strong' WHEN value > 10 THEN 'mid' ELSE 'tiny' END AS tier, value > 50 AS nf, upper(event_type) AS answer,
  CASE WHEN user_id % 7 = 0 THEN 'click' ELSE event_type END AS gold, 3 AS ct, CASE WHEN value > 10 THEN 2 ELSE 0 END AS cm, CASE WHEN value > 30 THEN 1 ELSE 0 END AS cs FROM events),
a AS (SELECT count(*) AS n, count(*) FILTER (lower(answer) = gold) AS correct, count(*) FILTER (tier <> 'strong') AS accepted_below_top, count(*) FILTER (tier <> 'strong' AND lower(answer) <> gold AND NOT nf) AS false_approvals,
  count(*) FILTER (tier = 'strong' AND lower(answer) <> gold) AS wrong_at_top, count(*) FILTER (nf) AS flagged, sum(ct * 500 + cm * 3000 + cs * 27000)::BIGINT AS cost,
  count(*) FILTER (tier = 'tiny') AS resolved_tiny, count(*) FILTER (tier = 'mid') AS resolved_mid, count(*) FILTER (tier = 'strong') AS resolved_strong FROM r)
SELECT *, """ + pp("correct", "n") + " AS accuracy, " + pp("false_approvals", "accepted_below_top") + " AS false_approval_rate, (1000000 - " + pp("cost", "n * 27000") + ")::BIGINT AS saving FROM a")
def _calibration(t):
    v = F.col("value")
    res = t.events.select(
        F.col("event_id").alias("item_id"), F.upper("event_type").alias("answer"), F.when(v > 30, "strong").when(v > 10, "mid").otherwise("tiny").alias("accepted_tier"),
        (v > 50).alias("needs_frontier"), F.lit(3).alias("calls_tiny"), F.when(v > 10, 2).otherwise(0).alias("calls_mid"), F.when(v > 30, 1).otherwise(0).alias("calls_strong"))
    gold = t.events.select(F.col("event_id").alias("item_id"), F.when(F.col("user_id") % 7 == 0, "click").otherwise(F.col("event_type")).alias("gold"))
    return E.calibration(res, gold, {"tiny": 500, "mid": 3000, "strong": 27000}, "strong")


# Navigation costs: events per user is what a user's query examined, the users' decade is the scale.
S.register_cte("nav_costs", """SELECT user_id // 30 AS scale, (user_id // 30 + 1) * 1000 AS leaves, user_id, count(*) AS nodes_examined FROM events GROUP BY user_id""")


@query("navigation_curve", S.with_ctes("nav_costs", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY scale ORDER BY nodes_examined) - 1 AS i, count(*) OVER (PARTITION BY scale) AS n FROM nav_costs),
a AS (SELECT scale, leaves, max(n) AS queries, max(nodes_examined) FILTER (i = (50 * (n - 1) + 50) // 100) AS p50, max(nodes_examined) FILTER (i = (95 * (n - 1) + 50) // 100) AS p95, max(nodes_examined) AS max FROM o GROUP BY 1, 2),
s AS (SELECT *, (p50 * 1000000 // leaves)::BIGINT AS share FROM a)
SELECT *, coalesce(share <= lag(share) OVER (ORDER BY leaves), true) AS not_rising FROM s"""))
def _nav(t):
    costs = t.events.groupBy("user_id").agg(F.count("*").alias("nodes_examined")).select(
        F.expr("user_id div 30").alias("scale"), ((F.expr("user_id div 30") + 1) * 1000).alias("leaves"), "nodes_examined")
    return E.nav_curve(costs)
