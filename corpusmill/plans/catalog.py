"""Queries over the catalog: sources, snapshots, versions, graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import graph as G
from corpusmill.operators import snapshots as V
from corpusmill.plans import shapes as S
from corpusmill.plans.documents import note_refs, notes
from corpusmill.plans.registry import query
from corpusmill.sources import files as SF
from corpusmill.sources import records as SR



@query("corpus_scan", S.with_ctes("corpus", """
SELECT source_path, octet_length(encode(text))::BIGINT AS size, content_hash FROM corpus
WHERE lang <> 'es' AND NOT starts_with(source_path, 'src1/')"""))
def _scan(t):
    c = S.corpus(t).filter((F.col("lang") != "es") & ~F.col("source_path").startswith("src1/"))
    return c.select("source_path", F.octet_length("text").cast("bigint").alias("size"), "content_hash")


@query("folder_rollup", S.with_ctes("corpus", """
WITH f AS (SELECT string_split(namespace || '/' || lang || '/' || (n_chars // 1000) || '/' || doc_id, '/') AS p, n_chars AS b FROM corpus),
up AS (SELECT array_to_string(p[1:d], '/') AS folder, d AS depth, b FROM f, unnest([0, 1, 2]) u(d)),
sub AS (SELECT DISTINCT array_to_string(p[1:d], '/') AS folder, p[1:k] AS below FROM f, unnest([0, 1, 2]) u(d), unnest([1, 2, 3]) v(k) WHERE k > d)
SELECT folder, depth::BIGINT AS depth, count(*) AS files, (SELECT count(*) FROM sub s WHERE s.folder = up.folder) AS subfolders, sum(b)::BIGINT AS bytes
FROM up GROUP BY folder, depth"""))
def _rollup(t):
    files = S.corpus(t).select(
        F.concat_ws("/", "namespace", "lang", F.expr("n_chars div 1000").cast("string"), F.col("doc_id").cast("string")).alias("source_path"),
        F.col("n_chars").alias("size"))
    return SF.folder_rollup(files, 2)


# Ledger lines from the events; some are broken on purpose, depending on the event's own value.
S.register_cte("ledger_lines", """SELECT event_id, CASE WHEN value < 0.5 THEN '{"kind": "card"' WHEN value < 1 THEN '["card"]'
   WHEN value < 1.5 THEN '{"kind":"card","target":"t","bytes":3,"extra":1}' WHEN value < 2 THEN '{"kind":"card","target":"t"}'
   WHEN value < 2.5 THEN '{"kind":"nope","target":"t","bytes":3}' WHEN value < 3 THEN '{"kind":"card","target":"  ","bytes":3}'
   WHEN value < 3.5 THEN '{"kind":"card","target":"t","bytes":0}' WHEN value < 4 THEN '{"kind":"card","target":"t","bytes":"9"}'
   WHEN value < 4.5 THEN '{"kind":"card","target":"t","bytes":9,"note":7}' WHEN value < 4.6 THEN '  '
   ELSE '{"kind":"' || kind || '","target":"user:' || user_id || '","bytes":' || bytes || '}' END AS line FROM (
   SELECT *, CASE event_type WHEN 'signup' THEN 'boot_packet' WHEN 'view' THEN 'section' WHEN 'click' THEN 'card' WHEN 'purchase' THEN 'query'
     ELSE 'whole_doc_open' END AS kind, 1 + floor(abs(value) * 100)::BIGINT AS bytes FROM events)""")
S.register_cte("ledger", """SELECT event_id, CASE event_type WHEN 'signup' THEN 'boot_packet' WHEN 'view' THEN 'section' WHEN 'click' THEN 'card'
   WHEN 'purchase' THEN 'query' ELSE 'whole_doc_open' END AS kind, 'user:' || user_id AS target, 1 + floor(abs(value) * 100)::BIGINT AS bytes, ts FROM events""")


def ledger(t):
    e = F.col("event_type")
    kind = (F.when(e == "signup", "boot_packet").when(e == "view", "section").when(e == "click", "card")
            .when(e == "purchase", "query").otherwise("whole_doc_open"))
    return t.events.select("event_id", kind.alias("kind"), F.concat(F.lit("user:"), "user_id").alias("target"),
                           (F.floor(F.abs("value") * 100) + 1).cast("bigint").alias("bytes"), "ts", "value")


@query("ledger_quarantine", S.with_ctes("ledger_lines", """
SELECT coalesce(reason, 'good') AS verdict, coalesce(kind, '') AS kind, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM (
 SELECT CASE WHEN NOT json_valid(line) THEN 'invalid_json' WHEN line[1] <> '{' THEN 'not_an_object'
   WHEN contains(line, 'extra') THEN 'unknown_key' WHEN NOT contains(line, '"bytes"') THEN 'missing_key' WHEN contains(line, 'nope') THEN 'bad_kind'
   WHEN contains(line, '"  "') THEN 'bad_target' WHEN regexp_matches(line, '"bytes":(0|")') THEN 'bad_bytes' WHEN contains(line, '"note":7') THEN 'bad_note' END AS reason,
  CASE WHEN contains(line, 'user:') THEN regexp_extract(line, '"kind":"([a-z_]+)"', 1) END AS kind,
  CASE WHEN contains(line, 'user:') THEN regexp_extract(line, '"bytes":([0-9]+)', 1)::BIGINT ELSE 0 END AS bytes
 FROM ledger_lines WHERE trim(line) <> '') GROUP BY ALL"""))
def _quarantine(t):
    v = F.col("value")
    good = F.concat(F.lit('{"kind":"'), "kind", F.lit('","target":"'), "target", F.lit('","bytes":'), F.col("bytes").cast("string"), F.lit("}"))
    steps = [(0.5, '{"kind": "card"'), (1, '["card"]'), (1.5, '{"kind":"card","target":"t","bytes":3,"extra":1}'), (2, '{"kind":"card","target":"t"}'),
             (2.5, '{"kind":"nope","target":"t","bytes":3}'), (3, '{"kind":"card","target":"  ","bytes":3}'), (3.5, '{"kind":"card","target":"t","bytes":0}'),
             (4, '{"kind":"card","target":"t","bytes":"9"}'), (4.5, '{"kind":"card","target":"t","bytes":9,"note":7}'), (4.6, "  ")]
    line = good
    for top, text in reversed(steps):
        line = F.when(v < top, text).otherwise(line)
    out = SF.validate_ledger(ledger(t).select(line.alias("value")))
    is_good = F.col("reject_reason").isNull()
    return out.groupBy(F.coalesce("reject_reason", F.lit("good")).alias("verdict"), F.when(is_good, F.col("kind")).otherwise("").alias("kind")).agg(
        F.count("*").alias("n"), F.sum(F.when(is_good, F.col("bytes")).otherwise(0)).cast("bigint").alias("bytes"))


# Ingest batch: every record arrives once, and a second time under its record id (copies conflict unless the text is equal).
S.register_cte("batch", """SELECT doc_id AS seq, 'v' || (doc_id // 2) AS rvid, record_id, CASE WHEN n_chars % 13 = 0 THEN 'mystery' WHEN n_chars % 17 = 0 THEN 'source_chunk' ELSE kind END AS kind,
   namespace, CASE WHEN n_chars % 19 = 0 THEN 'fine' ELSE status END AS status, content_hash FROM records""", ["records"])
S.register_cte("catalog0", """SELECT DISTINCT 'v' || (doc_id // 2) AS rvid, first_value(namespace) OVER w AS namespace, first_value(content_hash) OVER w AS content_hash
   FROM records WHERE lang = 'fr' WINDOW w AS (PARTITION BY doc_id // 2 ORDER BY doc_id)""", ["records"])


@query("record_ingest", S.with_ctes("batch catalog0", """
WITH refs AS (SELECT 'v' || (doc_id // 2) AS rvid, 'v' || (n_chars % 400) AS ref FROM records WHERE kind = 'failure'),
ns AS (SELECT ref, coalesce(max(c.namespace), max(b.namespace)) AS ref_ns FROM (SELECT DISTINCT ref FROM refs) r
   LEFT JOIN catalog0 c ON c.rvid = r.ref LEFT JOIN (SELECT rvid, arg_max(namespace, seq) AS namespace FROM batch GROUP BY 1) b ON b.rvid = r.ref GROUP BY 1),
x AS (SELECT b.*, c.content_hash AS old, EXISTS (SELECT 1 FROM refs r JOIN ns n ON r.ref = n.ref WHERE r.rvid = b.rvid AND n.ref_ns <> b.namespace) AS crossing
  FROM batch b LEFT JOIN catalog0 c ON b.rvid = c.rvid),
y AS (SELECT *, CASE WHEN kind = 'source_chunk' THEN 'reserved_record_kind' WHEN kind = 'mystery' THEN 'unknown_record_kind' END AS bad,
  CASE WHEN status = 'fine' THEN 'invalid_status' WHEN crossing THEN 'cross_namespace_derivation' END AS late FROM x),
z AS (SELECT y.*, coalesce(old, (SELECT arg_min(p.content_hash, p.seq) FROM y p WHERE p.rvid = y.rvid AND p.seq < y.seq AND p.bad IS NULL AND p.late IS NULL)) AS cmp FROM y)
SELECT seq, rvid, CASE WHEN reason <> '' THEN 'rejected' WHEN cmp IS NOT NULL THEN 'unchanged' ELSE 'accepted' END AS outcome, reason FROM (
 SELECT *, coalesce(CASE WHEN bad IS NOT NULL THEN bad WHEN cmp IS NOT NULL AND cmp <> content_hash THEN 'record_version_conflict' WHEN cmp IS NULL THEN late END, '') AS reason FROM z)"""))
def _ingest(t):
    r = S.records(t)
    n = F.col("n_chars")
    rv = F.concat(F.lit("v"), F.expr("doc_id div 2"))
    batch = r.select(
        F.col("doc_id").alias("seq"), rv.alias("rvid"), "record_id",
        F.when(n % 13 == 0, "mystery").when(n % 17 == 0, "source_chunk").otherwise(F.col("kind")).alias("kind"), "namespace",
        F.when(n % 19 == 0, "fine").otherwise(F.col("status")).alias("status"), "text", "content_hash")
    existing = r.filter("lang = 'fr'").groupBy(rv.alias("rvid")).agg(
        F.min_by("namespace", "doc_id").alias("namespace"), F.min_by("content_hash", "doc_id").alias("content_hash"))
    refs = r.filter("kind = 'failure'").select(rv.alias("rvid"), F.concat(F.lit("v"), n % 400).alias("ref"))
    out = SR.ingest_records(batch, existing, refs, ["summary", "decision", "failure", "procedure"])
    return out.select("seq", "rvid", "outcome", F.coalesce("reason", F.lit("")).alias("reason"))


@query("vector_import", """
SELECT outcome, label, count(*) AS n FROM (SELECT e.label, CASE WHEN l.doc_id IS NULL THEN 'unknown_target'
  WHEN len(CASE WHEN e.label = 3 THEN e.embedding[1:10] ELSE e.embedding END) <> 64 THEN 'bad_dimension' ELSE 'imported' END AS outcome
  FROM embeddings e LEFT JOIN labels l ON e.vec_id = l.doc_id) GROUP BY ALL""")
def _vectors(t):
    vec = t.embeddings.select(
        F.col("vec_id").alias("target_id"), "label",
        F.when(F.col("label") == 3, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("embedding"))
    out = SR.import_vectors(vec.select("target_id", "embedding"), t.labels.select(F.col("doc_id").alias("target_id")), 64, "space/1")
    return out.join(vec.select("target_id", "label"), "target_id").groupBy("outcome", "label").agg(F.count("*").alias("n"))


@query("record_listing", S.with_ctes("records", """
SELECT rvid, record_id, kind, status FROM records WHERE kind = 'summary' AND status = 'current' AND starts_with(source_path, 'src1')
ORDER BY kind, record_id, rvid LIMIT 100"""))
def _listing(t):
    return SR.list_records(S.records(t), kind="summary", status="current", path_prefix="src1", limit=100).select(
        "rvid", "record_id", "kind", "status")


@query("record_fetch", S.with_ctes("records", """
WITH ids AS (SELECT DISTINCT 'rv' || l_partkey AS rvid FROM lineitem),
allowed AS (SELECT DISTINCT namespace FROM records WHERE authority_level = 'authoritative')
SELECT outcome, coalesce(namespace, '') AS namespace, count(*) AS n FROM (
 SELECT CASE WHEN r.rvid IS NULL THEN 'unresolved' WHEN a.namespace IS NULL THEN 'out_of_scope' WHEN r.status <> 'current' THEN 'not_current' ELSE 'found' END AS outcome,
  CASE WHEN r.rvid IS NOT NULL AND a.namespace IS NOT NULL AND r.status = 'current' THEN r.namespace END AS namespace
 FROM ids i LEFT JOIN records r USING (rvid) LEFT JOIN allowed a ON a.namespace = r.namespace) GROUP BY ALL"""))
def _fetch(t):
    r = S.records(t)
    ids = t.lineitem.select(F.concat(F.lit("rv"), "l_partkey").alias("rvid"))
    allowed = r.filter("authority_level = 'authoritative'").select("namespace")
    eff = r.select("rvid", (F.col("status") == "current").alias("effective_current"))
    out = SR.get_records(ids, r.select("rvid", "namespace", "kind", "source_path"), allowed, eff)
    return out.groupBy("outcome", F.coalesce("namespace", F.lit("")).alias("namespace")).agg(F.count("*").alias("n"))


_DIFF = """SELECT coalesce(p.namespace, c.namespace) AS namespace, coalesce(p.source_path, c.source_path) AS source_path,
  CASE WHEN c.content_hash IS NULL THEN 'deleted' WHEN p.content_hash IS NULL THEN 'added' WHEN p.content_hash = c.content_hash THEN 'unchanged' ELSE 'changed' END AS change,
  p.content_hash AS prev_hash, c.content_hash AS curr_hash FROM prev p FULL JOIN curr c ON p.namespace = c.namespace AND p.source_path = c.source_path"""
S.register_cte("diff", _DIFF, ["prev", "curr"])
S.register_cte("moves", """SELECT d.namespace, d.h AS content_hash, d.source_path AS from_path, a.source_path AS to_path FROM
  (SELECT namespace, prev_hash AS h, source_path, row_number() OVER (PARTITION BY namespace, prev_hash ORDER BY source_path) AS n FROM diff WHERE change = 'deleted') d
  JOIN (SELECT namespace, curr_hash AS h, source_path, row_number() OVER (PARTITION BY namespace, curr_hash ORDER BY source_path) AS n FROM diff WHERE change = 'added') a
  ON d.namespace = a.namespace AND d.h = a.h AND d.n = a.n""", ["diff"])


def snapshot_diff(t):
    return V.diff_snapshots(S.prev_snapshot(t), S.curr_snapshot(t))


@query("snapshot_diff", S.with_ctes("diff", "SELECT * FROM diff"))
def _diff(t):
    return snapshot_diff(t)


@query("move_detection", S.with_ctes("moves", "SELECT * FROM moves"))
def _moves(t):
    return V.detect_moves(snapshot_diff(t))


@query("ingest_run_summary", S.with_ctes("moves", """
SELECT namespace, count(*) FILTER (change <> 'deleted') AS seen, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'changed') AS changed,
 count(*) FILTER (change = 'unchanged') AS unchanged, count(*) FILTER (change = 'deleted') AS deleted,
 (SELECT count(*) FROM moves m WHERE m.namespace = diff.namespace) AS moved FROM diff GROUP BY namespace"""))
def _run_summary(t):
    d = snapshot_diff(t)
    return V.run_summary(d, V.detect_moves(d))


# Versions: every turn of a conversation is a new version of that conversation; very short turns fail to parse.
S.register_cte("versions", """SELECT conv_id AS document_id, conv_id || ':' || turn AS version_id, turn AS observed_at,
   CASE WHEN length(text) < 120 THEN 'failed' ELSE 'ok' END AS parse_status FROM conversations""")


def versions(t):
    return t.conversations.select(
        F.col("conv_id").alias("document_id"), F.concat_ws(":", "conv_id", "turn").alias("version_id"), F.col("turn").alias("observed_at"),
        F.when(F.length("text") < 120, "failed").otherwise("ok").alias("parse_status"))


@query("version_serving", S.with_ctes("versions", """
WITH g AS (SELECT document_id, arg_max(version_id, observed_at) AS latest_version_id, arg_max(version_id, observed_at) FILTER (parse_status = 'ok') AS current_version_id FROM versions GROUP BY 1)
SELECT *, CASE WHEN current_version_id IS NULL THEN 'unparsed' WHEN current_version_id = latest_version_id THEN 'active' ELSE 'stale_fallback' END AS serving_status FROM g"""))
def _serving(t):
    return V.serve_versions(versions(t))


@query("derived_purge", S.with_ctes("diff", """
SELECT p.namespace, count(*) AS kept FROM prev p WHERE NOT EXISTS (SELECT 1 FROM diff d WHERE d.change IN ('deleted', 'changed') AND d.namespace = p.namespace AND d.source_path = p.source_path) GROUP BY 1"""))
def _purge(t):
    vid = F.concat_ws("|", "namespace", "source_path").alias("version_id")
    gone = snapshot_diff(t).filter("change IN ('deleted', 'changed')").select(vid)
    return V.purge_derived(S.prev_snapshot(t).select("namespace", vid), gone).groupBy("namespace").agg(F.count("*").alias("kept"))


@query("staleness_sweep", S.with_ctes("records curr", """
SELECT r.rvid, CASE WHEN r.status = 'current' AND c.source_path IS NULL THEN 'source_stale' ELSE r.status END AS status
FROM records r LEFT JOIN curr c ON c.source_path = r.source_path AND c.content_hash = r.content_hash"""))
def _sweep(t):
    key = F.concat_ws("@", "source_path", "content_hash")
    now = S.curr_snapshot(t).select(key.alias("version_id"), F.lit(True).alias("_now"))
    known = S.records(t).select(key.alias("version_id")).distinct().join(now, "version_id", "left").select(
        "version_id", F.col("_now").isNotNull().alias("is_current"))
    r = S.records(t).select("rvid", "status", key.alias("source_version_id"))
    return V.mark_stale(r, known).select("rvid", "status")


def drift_entities(t):
    """Each logical record is an entity that declares the versions it was built from."""
    r = S.records(t).select("record_id", F.struct(F.concat("source_path", F.lit("#body")).alias("ref"), F.col("content_hash").alias("sha256")).alias("s"))
    return r.groupBy(F.col("record_id").alias("entity_id")).agg(F.collect_list("s").alias("sources"))


S.register_cte("drift", """SELECT r.record_id AS entity_id, count(*) AS n_sources, count(*) FILTER (c.content_hash IS NULL) AS missing,
   count(*) FILTER (c.content_hash <> r.content_hash) AS drifted FROM records r LEFT JOIN curr c ON c.source_path = r.source_path GROUP BY 1""", ["records", "curr"])


@query("source_drift", S.with_ctes("drift", """
SELECT *, CASE WHEN missing > 0 THEN 'unbacked' WHEN drifted > 0 THEN 'stale' ELSE 'fresh' END AS state FROM drift"""))
def _drift(t):
    return V.source_drift(drift_entities(t), S.curr_snapshot(t))[0]


@query("source_drift_budget", S.with_ctes("drift", """
SELECT count(*) AS entities, count(*) FILTER (missing + drifted > 0) AS stale, count(*) FILTER (missing + drifted > 0) * 100 > count(*) * 20 AS breach FROM drift"""))
def _drift_budget(t):
    return V.source_drift(drift_entities(t), S.curr_snapshot(t))[1]


@query("changed_since", S.with_ctes("records diff", """
SELECT DISTINCT record_id AS entity_id FROM records r WHERE EXISTS (SELECT 1 FROM diff d WHERE d.source_path = r.source_path AND d.change <> 'unchanged')"""))
def _changed_since(t):
    return V.touched_by(drift_entities(t), snapshot_diff(t).filter("change <> 'unchanged'").select("source_path"))


@query("corpus_digest", S.with_ctes("records", """
WITH h AS (SELECT sha256(rvid || chr(0) || namespace || chr(0) || status || chr(0) || content_hash) AS h FROM records),
s AS (SELECT count(*) AS "rows", sum(('0x' || h[1:15])::HUGEINT) AS a, sum(('0x' || h[16:30])::HUGEINT) AS b, sum(('0x' || h[31:45])::HUGEINT) AS c, sum(('0x' || h[46:60])::HUGEINT) AS d FROM h)
SELECT "rows", sha256("rows" || '|' || a || '|' || b || '|' || c || '|' || d) AS digest FROM s"""))
def _digest(t):
    return SF.corpus_digest(S.records(t), ["rvid", "namespace", "status", "content_hash"])


@query("declared_supersession", S.with_ctes("notes", """
WITH known AS (SELECT DISTINCT note_id FROM notes),
w AS (SELECT note_id, unnest(regexp_extract_all(text, '(?is)\\b(?:supersedes?|replaces?)\\b(.{0,80}?)(?:[.,;\\n]|$)', 1)) AS win FROM notes),
m AS (SELECT note_id, unnest(regexp_extract_all(win, 'D-[0-9]{4}(?:/[0-9]{2})*')) AS tok FROM w),
refs AS (SELECT note_id, substring(tok, 1, 6) AS ref_id FROM m UNION SELECT note_id, substring(tok, 1, 4) || unnest(regexp_extract_all(tok, '/([0-9]{2})', 1)) FROM m),
idx AS (SELECT 'D-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS note_id, CASE o_orderstatus WHEN 'F' THEN 'Superseded' WHEN 'P' THEN 'closed' ELSE 'open' END AS state_raw,
   CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'D-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') END AS superseded_by FROM orders),
e AS (SELECT ref_id AS target, note_id AS successor FROM refs WHERE ref_id <> note_id UNION SELECT note_id, superseded_by FROM idx WHERE superseded_by IS NOT NULL),
s AS (SELECT target AS note_id, count(*) AS n, min(successor) AS f FROM e GROUP BY 1),
st AS (SELECT note_id, min(lower(state_raw)) AS cell FROM idx GROUP BY 1)
SELECT note_id, coalesce(n, 0) AS n_successors, f AS first_successor,
 CASE WHEN n IS NOT NULL OR cell = 'superseded' THEN 'superseded' WHEN cell = 'closed' THEN 'closed' ELSE 'current' END AS status,
 CASE WHEN cell IS NULL THEN 'no_index_row' WHEN n IS NOT NULL AND cell <> 'superseded' THEN 'edge_without_annotation' WHEN n IS NULL AND cell = 'superseded' THEN 'annotation_without_target' END AS disagreement
FROM known LEFT JOIN s USING (note_id) LEFT JOIN st USING (note_id)"""))
def _declared(t):
    ids = notes(t).select("o_orderkey", "note_id")
    refs = note_refs(t).join(ids, "o_orderkey").select("note_id", "ref_id").distinct()
    num = lambda c: F.concat(F.lit("D-"), F.lpad((F.col(c) % 10000).cast("string"), 4, "0"))
    st = F.col("o_orderstatus")
    index = t.orders.select(
        num("o_orderkey").alias("note_id"), F.when(st == "F", "Superseded").when(st == "P", "closed").otherwise("open").alias("state_raw"),
        F.when((st == "F") & (F.col("o_totalprice") > 400000), num("o_custkey")).alias("superseded_by"))
    return V.derive_supersession(ids, refs, index)


# Notes that replace others in full, in part or by folding, some of which nobody wrote; the index adds its own edges.
S.register_cte("rel_notes", """SELECT 'D-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS note_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'this supersedes D-' || c || '/42/45, done. It amends D-' || third WHEN '2-HIGH' THEN 'it replaces D-' || c || ' and D-' || third || '. Refines D-0007'
   WHEN '3-MEDIUM' THEN 'amends the rule of D-' || c || ', reconciles it with D-' || third WHEN '4-NOT SPECIFIED' THEN 'folds the old rule into this: D-' || third ELSE 'mentions D-' || c END AS text
  FROM (SELECT *, lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS c, lpad((o_custkey // 3 % 10000)::VARCHAR, 4, '0') AS third FROM orders)""")
S.register_cte("rel_index", """SELECT 'D-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS note_id, CASE o_orderstatus WHEN 'F' THEN 'Superseded' WHEN 'P' THEN 'Folded in' WHEN 'O' THEN 'closed' END AS state_raw,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'D-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') END AS superseded_by,
  CASE WHEN o_totalprice < 100000 THEN 'D-' || lpad((o_custkey // 3 % 10000)::VARCHAR, 4, '0') END AS folded_by FROM orders""")
S.register_cte("rel", """SELECT * FROM (
 WITH w AS (SELECT note_id, unnest(list_concat(regexp_extract_all(text, '(?is)\\bsupersedes?\\b(.{0,80}?)(?:[.,;\\n]|$)', 1), regexp_extract_all(text, '(?is)\\breplaces?\\b(.{0,80}?)(?:[.,;\\n]|$)', 1))) AS win FROM rel_notes),
 m AS (SELECT note_id, unnest(regexp_extract_all(win, 'D-[0-9]{4}(?:/[0-9]{2})*')) AS tok FROM w),
 n AS (SELECT note_id, substring(tok, 1, 6) AS target FROM m UNION SELECT note_id, substring(tok, 1, 4) || unnest(regexp_extract_all(tok, '/([0-9]{2})', 1)) FROM m),
 f AS (SELECT note_id AS successor, CASE WHEN target <> note_id AND target IN (SELECT note_id FROM rel_notes) THEN 'supersedes' ELSE 'unresolved' END AS relation, target, 'text' AS said_in FROM n),
 p AS (SELECT DISTINCT note_id AS successor, unnest(regexp_extract_all(text, '(?is)\\b(?:revises?|refines?|amend(?:s|ed)?|RE-FROZEN|reconciles?|folds? the .*? into)\\b.{0,80}?(D-[0-9]{4})', 1)) AS target FROM rel_notes)
 SELECT * FROM f UNION ALL SELECT successor, 'revises', target, 'text' FROM p WHERE successor <> target AND target IN (SELECT note_id FROM rel_notes) AND successor NOT IN (SELECT successor FROM f WHERE relation = 'supersedes')
 UNION ALL SELECT DISTINCT superseded_by, 'supersedes', note_id, 'index' FROM rel_index WHERE superseded_by IS NOT NULL UNION ALL SELECT DISTINCT folded_by, 'folds', note_id, 'index' FROM rel_index WHERE folded_by IS NOT NULL)""", ["rel_notes", "rel_index"])


def relation_tables(t):
    num = lambda c: F.concat(F.lit("D-"), F.lpad((c % 10000).cast("string"), 4, "0"))
    me, cust, third = num(F.col("o_orderkey")), num(F.col("o_custkey")), num(F.expr("o_custkey div 3"))
    p, st, say = F.col("o_orderpriority"), F.col("o_orderstatus"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    text = (F.when(p == "1-URGENT", say("this supersedes ", cust, "/42/45, done. It amends ", third)).when(p == "2-HIGH", say("it replaces ", cust, " and ", third, ". Refines D-0007"))
            .when(p == "3-MEDIUM", say("amends the rule of ", cust, ", reconciles it with ", third)).when(p == "4-NOT SPECIFIED", say("folds the old rule into this: ", third))
            .otherwise(say("mentions ", cust)))
    index = t.orders.select(
        me.alias("note_id"), F.when(st == "F", "Superseded").when(st == "P", "Folded in").when(st == "O", "closed").alias("state_raw"),
        F.when((st == "F") & (F.col("o_totalprice") > 400000), cust).alias("superseded_by"), F.when(F.col("o_totalprice") < 100000, third).alias("folded_by"))
    return t.orders.select(me.alias("note_id"), text.alias("text")), index


@query("supersession_relations", S.with_ctes("rel", "SELECT * FROM rel"))
def _relations(t):
    return V.supersession_relations(*relation_tables(t))


@query("relation_status", S.with_ctes("rel", """
WITH o AS (SELECT target AS note_id, count(*) FILTER (relation = 'supersedes') AS superseded_by, count(*) FILTER (relation = 'folds') AS folded_into, count(*) FILTER (relation = 'revises') AS revised_by FROM rel WHERE relation <> 'unresolved' GROUP BY 1),
l AS (SELECT successor AS note_id, count(DISTINCT target) AS unresolved FROM rel WHERE relation = 'unresolved' GROUP BY 1), c AS (SELECT note_id, min(lower(state_raw)) AS cell FROM rel_index GROUP BY 1)
SELECT note_id, coalesce(superseded_by, 0) AS superseded_by, coalesce(folded_into, 0) AS folded_into, coalesce(revised_by, 0) AS revised_by, coalesce(unresolved, 0) AS unresolved,
 CASE WHEN superseded_by > 0 OR (coalesce(folded_into, 0) = 0 AND cell = 'superseded') THEN 'superseded' WHEN folded_into > 0 OR cell = 'folded in' THEN 'folded' WHEN cell = 'closed' THEN 'closed' ELSE 'current' END AS status
FROM (SELECT DISTINCT note_id FROM rel_notes) LEFT JOIN o USING (note_id) LEFT JOIN l USING (note_id) LEFT JOIN c USING (note_id)"""))
def _relation_status(t):
    n, index = relation_tables(t)
    return V.relation_status(n, V.supersession_relations(n, index), index)


# ---- graph -------------------------------------------------------------------------------------------------------
# A typed reference graph of the sales tables.
S.register_cte("ref_nodes", """SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'o' || o_orderkey FROM orders UNION ALL
   SELECT 'p' || p_partkey FROM part UNION ALL SELECT 's' || s_suppkey FROM supplier""")
S.register_cte("ref_edges", """SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'placed_by' AS kind, o_orderpriority = '1-URGENT' AS external,
   CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS external_ref FROM orders
   UNION ALL SELECT 'o' || l_orderkey, 'p' || (l_partkey + l_linenumber), 'contains', false, NULL FROM lineitem
   UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'supplied_by', false, NULL FROM lineitem""")


def ref_nodes(t):
    pick = lambda df, p, c: df.select(F.concat(F.lit(p), c).alias("id"))
    return (pick(t.customer, "c", "c_custkey").union(pick(t.orders, "o", "o_orderkey")).union(pick(t.part, "p", "p_partkey"))
            .union(pick(t.supplier, "s", "s_suppkey")))


def ref_edges(t):
    a = t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"), F.lit("placed_by").alias("kind"),
                        (F.col("o_orderpriority") == "1-URGENT").alias("external"),
                        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("external_ref"))
    no = [F.lit(False).alias("external"), F.lit(None).cast("string").alias("external_ref")]
    b = t.lineitem.select(F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), F.col("l_partkey") + F.col("l_linenumber")), F.lit("contains"), *no)
    c = t.lineitem.select(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), F.lit("supplied_by"), *no)
    return a.union(b).union(c)


@query("edge_neighbors", S.with_ctes("ref_edges", """
WITH ids AS (SELECT 'p' || p_partkey AS id FROM part WHERE p_size >= 49), b AS (SELECT src AS id, kind, dst AS neighbor FROM ref_edges UNION ALL SELECT dst, kind, src FROM ref_edges)
SELECT id, kind, neighbor, count(*) AS n FROM b WHERE id IN (SELECT id FROM ids) GROUP BY ALL"""))
def _neighbors(t):
    ids = t.part.filter("p_size >= 49").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return G.neighbors(ref_edges(t), ids, "both").groupBy("id", "kind", "neighbor").agg(F.count("*").alias("n"))


@query("degree_warnings", S.with_ctes("ref_edges", "SELECT src AS id, kind, count(*) AS degree FROM ref_edges GROUP BY ALL HAVING count(*) > 15"))
def _degrees(t):
    return G.degree_warnings(ref_edges(t))


@query("edge_integrity", S.with_ctes("ref_nodes ref_edges", """
SELECT e.kind, count(*) AS edges, count(*) FILTER (NOT external AND s.id IS NOT NULL AND d.id IS NOT NULL) AS resolved, count(*) FILTER (external) AS external,
 count(*) FILTER (s.id IS NULL) AS dangling_src, count(*) FILTER (NOT external AND d.id IS NULL) AS dangling_dst,
 count(*) FILTER (external AND external_ref IS NULL) AS external_without_ref
FROM ref_edges e LEFT JOIN ref_nodes s ON e.src = s.id LEFT JOIN ref_nodes d ON e.dst = d.id GROUP BY 1"""))
def _integrity(t):
    return G.edge_integrity(ref_nodes(t), ref_edges(t))


S.register_cte("resolved", """SELECT r.rvid, (SELECT count(*) FROM supersessions e JOIN records s ON e.src = s.rvid WHERE e.dst = r.rvid AND s.status = 'current' AND s.namespace = r.namespace) AS immediate_live,
   EXISTS (SELECT 1 FROM walk w JOIN records s ON s.rvid = w.node WHERE w.root = r.rvid AND s.status = 'current' AND w.node <> r.rvid) AS has_live_successor FROM records r""", ["walk"])
S.register_cte("walk", """SELECT e.dst AS root, e.src AS node FROM supersessions e JOIN records a ON a.rvid = e.dst JOIN records b ON b.rvid = e.src WHERE a.namespace = b.namespace
   UNION SELECT w.root, e.src FROM walk w JOIN records n ON n.rvid = w.node JOIN supersessions e ON e.dst = w.node JOIN records b ON b.rvid = e.src
   WHERE n.status <> 'current' AND b.namespace = n.namespace""", ["records", "supersessions"])


@query("live_successors", S.with_ctes("resolved", "SELECT rvid, immediate_live, immediate_live >= 2 AS conflicted, has_live_successor FROM resolved", recursive=True))
def _live(t):
    return G.resolve_supersession(S.records(t), S.supersessions(t))


@query("effective_current", S.with_ctes("resolved", """
SELECT r.rvid, r.status = 'current' AND NOT v.has_live_successor AS effective_current FROM records r JOIN resolved v USING (rvid)""", recursive=True))
def _effective(t):
    r = S.records(t)
    return G.effective_current(r, G.resolve_supersession(r, S.supersessions(t)))


# Cycles: the newest version of a record that has German text is (wrongly) said to be superseded by the oldest.
S.register_cte("cyclic", """SELECT src, dst FROM supersessions UNION ALL SELECT arg_min(rvid, doc_id), arg_max(rvid, doc_id) FROM records GROUP BY record_id
   HAVING bool_or(lang = 'de') AND count(*) > 1""", ["supersessions"])


@query("cycle_members", S.with_ctes("cyclic", """
WITH reach AS (SELECT src, dst FROM cyclic UNION SELECT r.src, c.dst FROM reach r JOIN cyclic c ON r.dst = c.src)
SELECT DISTINCT src AS id FROM reach WHERE src = dst""", recursive=True))
def _cycles(t):
    back = S.records(t).groupBy("record_id").agg(
        F.min_by("rvid", "doc_id").alias("src"), F.max_by("rvid", "doc_id").alias("dst"), F.bool_or(F.col("lang") == "de").alias("de"),
        F.count("*").alias("n")).filter("de AND n > 1").select("src", "dst")
    return G.cycle_members(S.supersessions(t).unionByName(back))


@query("ancestor_closure", """
WITH RECURSIVE up AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region),
a AS (SELECT child AS id, parent AS ancestor, 1::BIGINT AS depth FROM up WHERE child LIKE 'o%' UNION ALL SELECT a.id, u.parent, a.depth + 1 FROM a JOIN up u ON u.child = a.ancestor)
SELECT * FROM a""")
def _ancestors(t):
    e = lambda df, pc, c, pp, p: df.select(F.concat(F.lit(pc), c).alias("child"), F.concat(F.lit(pp), p).alias("parent"))
    up = (e(t.customer, "c", "c_custkey", "n", "c_nationkey").union(e(t.nation, "n", "n_nationkey", "r", "n_regionkey"))
          .union(e(t.orders, "o", "o_orderkey", "c", "o_custkey"))
          .union(t.region.select(F.concat(F.lit("r"), "r_regionkey"), F.lit("root"))))
    return G.ancestors(up, t.orders.select(F.concat(F.lit("o"), "o_orderkey").alias("id")))


@query("contradictions", S.with_ctes("supersessions", """
WITH decl AS (SELECT src, dst FROM supersessions UNION ALL SELECT dst, src FROM supersessions)
SELECT 'multiple_current' AS reason, min(rvid) AS a, max(rvid) AS b, count(DISTINCT rvid) AS n FROM records WHERE status = 'current' GROUP BY record_id HAVING count(DISTINCT rvid) > 1
UNION ALL SELECT 'declared', a, b, 2 FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM decl)"""))
def _contradictions(t):
    e = S.supersessions(t)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return G.contradictions(S.records(t), both)


@query("cross_namespace_edges", S.with_ctes("records", """
WITH e AS (SELECT r.rvid AS src, 'rv' || r.n_chars AS dst, 'derived_from' AS kind FROM records r)
SELECT e.src, e.dst, e.kind, a.namespace AS src_ns, b.namespace AS dst_ns FROM e JOIN records a ON a.rvid = e.src JOIN records b ON b.rvid = e.dst WHERE a.namespace <> b.namespace"""))
def _cross(t):
    r = S.records(t)
    return G.cross_namespace_edges(r, r.select(F.col("rvid").alias("src"), F.concat(F.lit("rv"), "n_chars").alias("dst"), F.lit("derived_from").alias("kind")))


@query("reference_resolution", S.with_ctes("corpus", """
WITH refs AS (SELECT source_path AS src_path, namespace, lang, CASE lang WHEN 'en' THEN '../en/' || (n_chars % 5000) WHEN 'fr' THEN namespace || '/fr/' || (doc_id // 2)
   WHEN 'de' THEN 'x/' || (n_chars % 2000) ELSE './' || doc_id END AS target FROM corpus),
q AS (SELECT *, CASE lang WHEN 'en' THEN namespace || substring(target, 3) WHEN 'es' THEN namespace || '/es/' || substring(target, 3) ELSE namespace || '/' || lang || '/' || target END AS rel,
  string_split(target, '/')[-1] AS base FROM refs)
SELECT src_path, target, coalesce(a.source_path, b.source_path, c.source_path) AS resolved,
 CASE WHEN a.source_path IS NOT NULL THEN 'relative' WHEN b.source_path IS NOT NULL THEN 'literal' WHEN c.source_path IS NOT NULL THEN 'basename' ELSE 'external' END AS how
FROM q LEFT JOIN corpus a ON a.source_path = q.rel LEFT JOIN corpus b ON b.source_path = q.target LEFT JOIN corpus c ON c.doc_id::VARCHAR = q.base"""))
def _refs(t):
    c, n = S.corpus(t), F.col("n_chars")
    lang = F.col("lang")
    target = (F.when(lang == "en", F.concat(F.lit("../en/"), n % 5000)).when(lang == "fr", F.concat("namespace", F.lit("/fr/"), F.expr("doc_id div 2")))
              .when(lang == "de", F.concat(F.lit("x/"), n % 2000)).otherwise(F.concat(F.lit("./"), "doc_id")))
    return G.resolve_refs(c.select(F.col("source_path").alias("src_path"), target.alias("target")), c.select("source_path"))


@query("derived_relationships", S.with_ctes("corpus", """
WITH f AS (SELECT 's' || l_suppkey AS module, 'p' || l_partkey AS name, bool_or(l_linestatus = 'F') AS p, bool_or(l_linestatus = 'O') AS r FROM lineitem GROUP BY ALL)
SELECT source_path AS src, 'in_module' AS kind, namespace AS dst FROM corpus UNION SELECT source_path, 'tests', namespace FROM corpus WHERE lang = 'es'
UNION SELECT source_path, 'skill_of_module', namespace FROM corpus WHERE ends_with(source_path, '0') UNION SELECT module, 'produces', name FROM f WHERE p UNION SELECT module, 'consumes', name FROM f WHERE r AND NOT p"""))
def _relationships(t):
    facts = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("module"), F.concat(F.lit("p"), "l_partkey").alias("name"),
                              F.when(F.col("l_linestatus") == "F", "produced").otherwise("referenced").alias("role"))
    p = F.col("source_path")
    return G.derive_relationships(S.corpus(t).select("source_path"), facts, F.element_at(F.split(p, "/"), 1),
                                  F.element_at(F.split(p, "/"), 2) == "es", p.endswith("0"))


@query("coverage_gaps", """
SELECT 'no_entity' AS gap, id FROM (SELECT DISTINCT l_partkey + 100 AS id FROM lineitem) WHERE id NOT IN (SELECT p_partkey FROM part)
UNION ALL SELECT 'unbacked_entity', p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey + 100 FROM lineitem)""")
def _gaps(t):
    return G.coverage_gaps(t.lineitem.select((F.col("l_partkey") + 100).alias("id")), t.part.select(F.col("p_partkey").alias("id")))


@query("field_conflicts", """
WITH j AS (SELECT s_suppkey AS id, s_nationkey AS an, c_nationkey AS bn, floor(s_acctbal / 1000)::BIGINT AS ab, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal / 1000)::BIGINT END AS bb
 FROM supplier JOIN customer ON s_suppkey = c_custkey)
SELECT id, 'nationkey' AS field, an::VARCHAR AS a_value, bn::VARCHAR AS b_value FROM j WHERE an <> bn UNION ALL SELECT id, 'balance', ab::VARCHAR, bb::VARCHAR FROM j WHERE ab <> bb""")
def _conflicts(t):
    k = lambda c: F.floor(F.col(c) / 1000).cast("bigint")
    a = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nationkey"), k("s_acctbal").alias("balance"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nationkey"), F.when(F.col("c_acctbal") > 0, k("c_acctbal")).alias("balance"))
    return G.field_conflicts(a, b, ["nationkey", "balance"])


@query("load_bearing", """
SELECT p_partkey AS id, p_size > 45 OR EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount > 0.09) AS load_bearing FROM part""")
def _load_bearing(t):
    ents = t.part.select(F.col("p_partkey").alias("id"), "p_size")
    return G.load_bearing(ents, t.lineitem.filter("l_discount > 0.09").select(F.col("l_partkey").alias("id")), F.col("p_size") > 45)


@query("uncovered_fields", """
WITH e AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN ['name', 'nation', 'segment', 'balance'] ELSE ['name', 'nation', 'segment'] END AS populated,
  CASE c_mktsegment WHEN 'BUILDING' THEN ['*'] WHEN 'AUTOMOBILE' THEN ['name', 'nation'] WHEN 'MACHINERY' THEN ['balance', 'segment', 'name'] ELSE [] END AS covered FROM customer)
SELECT id, f AS field FROM e, unnest(populated) u(f) WHERE NOT list_contains(covered, '*') AND NOT list_contains(covered, f)""")
def _uncovered(t):
    a = lambda *v: F.array(*[F.lit(x) for x in v])
    seg = F.col("c_mktsegment")
    src = lambda *fields: F.array(F.struct(F.lit("crm").alias("ref"), a(*fields).alias("fields")))
    two = F.array(F.struct(F.lit("crm").alias("ref"), a("balance", "segment").alias("fields")), F.struct(F.lit("web").alias("ref"), a("name").alias("fields")))
    sources = F.when(seg == "BUILDING", src("*")).when(seg == "AUTOMOBILE", src("name", "nation")).when(seg == "MACHINERY", two)
    ents = t.customer.select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") > 0, a("name", "nation", "segment", "balance")).otherwise(a("name", "nation", "segment")).alias("populated"),
        F.coalesce(sources, F.array().cast("array<struct<ref:string,fields:array<string>>>")).alias("sources"))
    return G.uncovered_fields(ents)


@query("alias_resolution", """
WITH e AS (SELECT s_name AS id, s_suppkey::VARCHAR AS alias FROM supplier UNION ALL SELECT c_name, c_custkey::VARCHAR FROM customer),
args AS (SELECT DISTINCT l_partkey::VARCHAR AS arg FROM lineitem UNION SELECT upper(c_name) FROM customer),
n AS (SELECT lower(alias) AS k, id, false AS own FROM e UNION SELECT lower(id), id, true FROM e),
u AS (SELECT k, count(DISTINCT id) AS n, min(id) AS one, max(CASE WHEN own THEN id END) AS exact FROM n GROUP BY 1)
SELECT arg, coalesce(exact, CASE WHEN n = 1 THEN one END) AS id, CASE WHEN coalesce(exact, CASE WHEN n = 1 THEN one END) IS NOT NULL THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS outcome
FROM args LEFT JOIN u ON u.k = lower(arg)""")
def _alias(t):
    e = t.supplier.select(F.col("s_name").alias("id"), F.array(F.col("s_suppkey").cast("string")).alias("aliases")).unionByName(
        t.customer.select(F.col("c_name").alias("id"), F.array(F.col("c_custkey").cast("string")).alias("aliases")))
    args = t.lineitem.select(F.col("l_partkey").cast("string").alias("arg")).union(t.customer.select(F.upper("c_name")))
    return G.resolve_alias(e, args)


