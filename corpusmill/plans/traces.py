"""Event, state and review queries. A user's events are a run: signup opens a stage, purchase closes it."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import events as T
from corpusmill.plans import shapes as S
from corpusmill.plans.registry import query
from corpusmill.session import cut_lineage

S.register_cte("ev", """SELECT user_id AS run_id, event_id, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'stage_start' WHEN 'purchase' THEN 'stage_end' WHEN 'error' THEN 'error' ELSE 'tool_' || event_type END AS type,
   CASE WHEN event_type = 'purchase' AND value > 15 THEN 'passed' END AS status, CASE WHEN event_type = 'purchase' AND value <= 40 THEN floor(value * 10)::BIGINT END AS duration_ms, 'm' || (event_id % 7) AS model,
   lpad(epoch_us(ts)::VARCHAR, 20, '0') || '-' || lpad(event_id::VARCHAR, 12, '0') AS seq FROM events""")
S.register_cte("runs", "SELECT user_id AS run_id, max(value) > 60 AS failed FROM events GROUP BY 1")


def us(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def ev(t):
    e, v = F.col("event_type"), F.col("value")
    return t.events.select(
        F.col("user_id").alias("run_id"), "event_id", us("ts").alias("us"),
        F.when(e == "signup", "stage_start").when(e == "purchase", "stage_end").when(e == "error", "error").otherwise(F.concat(F.lit("tool_"), e)).alias("type"),
        F.when((e == "purchase") & (v > 15), "passed").alias("status"), F.when((e == "purchase") & (v <= 40), F.floor(v * 10)).cast("bigint").alias("duration_ms"),
        F.concat(F.lit("m"), F.col("event_id") % 7).alias("model"),
        F.concat_ws("-", F.lpad(us("ts").cast("string"), 20, "0"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("seq"))


def runs(t):
    return t.events.groupBy(F.col("user_id").alias("run_id")).agg((F.max("value") > 60).alias("failed"))


S.register_cte("seg", """SELECT *, sum(CASE WHEN type = 'stage_start' THEN 1 ELSE 0 END) OVER w + coalesce(sum(CASE WHEN type = 'stage_end' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stage_no
  FROM ev WINDOW w AS (PARTITION BY run_id ORDER BY seq)""", ["ev"])
S.register_cte("stg", """SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY stage_no) AS stage_index, first_seq, last_seq, n AS events, had_error,
   CASE WHEN explicit IS NOT NULL THEN explicit WHEN had_error THEN 'failed' WHEN failed THEN 'incomplete' ELSE 'ok' END AS status, end_ms AS duration_ms FROM (
   SELECT run_id, stage_no, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n, bool_or(type = 'error') AS had_error, max(status) FILTER (type = 'stage_end') AS explicit, max(duration_ms) FILTER (type = 'stage_end') AS end_ms
   FROM seg GROUP BY 1, 2) JOIN runs USING (run_id)""", ["seg", "runs"])


def stage_rows(t):
    return T.stages(T.segment_stages(ev(t)), runs(t))


@query("stage_segmentation", S.with_ctes("seg", "SELECT run_id, event_id, stage_no::BIGINT AS stage_no FROM seg"))
def _segments(t):
    return T.segment_stages(ev(t)).select("run_id", "event_id", "stage_no")


@query("stage_status", S.with_ctes("stg", "SELECT * FROM stg"))
def _stages(t):
    return stage_rows(t)


@query("episode_rollup", S.with_ctes("ev", """
SELECT run_id, count(*) AS events, min(seq) AS first_seq, max(seq) AS last_seq, count(*) FILTER (type = 'stage_start') AS n_stage_start, count(*) FILTER (type = 'stage_end') AS n_stage_end,
 count(*) FILTER (type = 'error') AS n_error, count(*) FILTER (type = 'tool_view') AS n_tool_view, count(DISTINCT model) AS models,
 CASE WHEN count(*) FILTER (type = 'stage_end' AND status IS NOT NULL) > 0 THEN 'passed' WHEN bool_or(type = 'error') THEN 'failed' WHEN NOT bool_or(type = 'stage_end') THEN 'incomplete' ELSE 'ok' END AS final_status FROM ev GROUP BY 1"""))
def _episodes(t):
    return T.episodes(ev(t), ["stage_start", "stage_end", "error", "tool_view"])


@query("failure_signatures", """
WITH f AS (SELECT event_id, sha256(('user' || user_id % 10) || '|' || array_to_string(list_sort(list_distinct([CASE WHEN value > 20 THEN 'big' ELSE 'small' END, 'click'])), ',') || '|' || event_type || '|' || CASE WHEN value > 40 THEN 'rare' ELSE '' END) AS signature FROM events WHERE event_type = 'error')
SELECT signature, min(event_id) AS record_id, count(*) AS occurrences FROM f GROUP BY 1""")
def _failures(t):
    v = F.col("value")
    f = t.events.filter("event_type = 'error'").select(
        F.col("event_id").alias("failure_id"),
        T.failure_signature(F.array(F.concat(F.lit("USER"), F.col("user_id") % 10)), F.array(F.lit("click"), F.when(v > 20, "Big").otherwise("small"), F.lit("Click")),
                            F.array("event_type"), F.when(v > 40, F.array(F.lit("rare"))).otherwise(F.array().cast("array<string>"))).alias("signature"))
    return T.failure_records(f)


@query("latest_report", """
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def _latest(t):
    return T.latest_by(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


# Orders are the plan of their customer, shipped lines are the reports.
S.register_cte("plan", "SELECT 'c' || o_custkey AS plan_id, o_orderkey AS worker_id, CASE WHEN o_custkey % 2 = 0 THEN 'on_each' ELSE 'on_all' END AS report_back FROM orders")
S.register_cte("reports", """SELECT 'c' || CASE WHEN l_discount = 0.1 THEN l_suppkey ELSE coalesce(o_custkey, -1) END AS plan_id, l_orderkey + CASE WHEN l_tax = 0.08 AND l_quantity > 45 THEN 20000000 ELSE 0 END AS worker_id, l_linenumber, l_shipdate,
   CASE l_linestatus WHEN 'F' THEN CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'done' END ELSE 'running' END AS state FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 20""")


def plan(t):
    return t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("plan_id"), F.col("o_orderkey").alias("worker_id"), F.when(F.col("o_custkey") % 2 == 0, "on_each").otherwise("on_all").alias("report_back"))


def reports(t):
    l = t.lineitem.filter("l_quantity > 20").join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    st = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "R", "failed").otherwise("done")).otherwise("running")
    return l.select(F.concat(F.lit("c"), F.when(F.col("l_discount") == 0.1, F.col("l_suppkey")).otherwise(F.coalesce("o_custkey", F.lit(-1)))).alias("plan_id"),
                    (F.col("l_orderkey") + F.when((F.col("l_tax") == 0.08) & (F.col("l_quantity") > 45), 20000000).otherwise(0)).alias("worker_id"), "l_linenumber", "l_shipdate", st.alias("state"))


@query("wave_state", S.with_ctes("plan reports", """
WITH l AS (SELECT plan_id, worker_id, arg_max(state, (l_shipdate, l_linenumber, state)) AS state FROM reports GROUP BY 1, 2),
j AS (SELECT p.plan_id, p.report_back, coalesce(l.state, 'unreported') AS s FROM plan p LEFT JOIN l ON l.plan_id = p.plan_id AND l.worker_id = p.worker_id),
g AS (SELECT plan_id, report_back, count(*) AS members, count(*) FILTER (s = 'running') AS running, count(*) FILTER (s = 'done') AS done, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'unreported') AS unreported FROM j GROUP BY 1, 2)
SELECT *, done + failed AS terminal, CASE WHEN report_back = 'on_each' THEN done + failed > 0 ELSE done + failed = members END AS ready FROM g"""))
def _wave(t):
    return T.wave_state(plan(t), T.latest_by(reports(t), ["plan_id", "worker_id"], ["l_shipdate", "l_linenumber", "state"]))


@query("dispatch_reconciliation", S.with_ctes("plan reports", """
WITH p AS (SELECT DISTINCT worker_id, plan_id FROM plan), r AS (SELECT DISTINCT worker_id, plan_id FROM reports)
SELECT 'missing' AS finding, plan_id, worker_id FROM p WHERE worker_id NOT IN (SELECT worker_id FROM r) UNION ALL SELECT 'orphan', plan_id, worker_id FROM r WHERE worker_id NOT IN (SELECT worker_id FROM p)
UNION ALL SELECT 'plan_mismatch', plan_id, worker_id FROM r WHERE worker_id IN (SELECT worker_id FROM p) AND NOT EXISTS (SELECT 1 FROM p WHERE p.worker_id = r.worker_id AND p.plan_id = r.plan_id)"""))
def _reconcile(t):
    return T.reconcile(plan(t), reports(t))


S.register_cte("sttimes", """SELECT 'user:' || run_id AS context, stage_index, CASE WHEN run_id % 10 = 0 THEN NULL ELSE start_us + 1000 * coalesce(sum(coalesce(duration_ms, 0)) OVER (PARTITION BY run_id ORDER BY stage_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT END AS ts_us, status
   FROM stg JOIN (SELECT run_id, min(us) AS start_us FROM ev GROUP BY 1) USING (run_id)""", ["stg"])


@query("stitched_timeline", S.with_ctes("sttimes plan", """
SELECT ts_us, context, 'episode' AS source, 'stage:' || status AS kind, stage_index::VARCHAR AS detail, stage_index AS seq, ts_us IS NULL AS undated FROM sttimes
UNION ALL SELECT epoch_us(o_orderdate), 'order:' || o_orderkey, 'plan', 'plan_created', 'c' || o_custkey, 0, false FROM orders"""))
def _timeline(t):
    start = ev(t).groupBy("run_id").agg(F.min("us").alias("start_us"))
    st = cut_lineage(stage_rows(t).join(start, "run_id"))
    st = st.withColumn("context", F.concat(F.lit("user:"), "run_id")).withColumn("start_us", F.when(F.col("run_id") % 10 != 0, F.col("start_us")))
    a = T.stage_times(st).select("ts_us", "context", F.lit("episode").alias("source"), F.concat(F.lit("stage:"), "status").alias("kind"),
                                 F.col("stage_index").cast("string").alias("detail"), F.col("stage_index").alias("seq"))
    b = t.orders.select(us("o_orderdate").alias("ts_us"), F.concat(F.lit("order:"), "o_orderkey").alias("context"), F.lit("plan").alias("source"), F.lit("plan_created").alias("kind"),
                        F.concat(F.lit("c"), "o_custkey").alias("detail"), F.lit(0).cast("bigint").alias("seq"))
    return T.stitch_timeline(a, b)


# Working state: each event of a user is a write that claims the previous event's count as its parent; some claims are stale.
S.register_cte("writes", """SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN value > 30 THEN 0 ELSE row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) // 2 END AS parent,
   CASE WHEN value > 25 THEN 'other' ELSE 'ns' || user_id % 3 END AS namespace FROM events""")


def writes(t):
    from corpusmill.operators.numbering import number_rows

    n = number_rows(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "i").withColumn("seq", F.col("i") + 1)
    return n.select(F.col("user_id").alias("task_id"), "seq", F.when(F.col("value") > 30, 0).otherwise(F.expr("seq div 2")).alias("parent"),
                    F.when(F.col("value") > 25, "other").otherwise(F.concat(F.lit("ns"), F.col("user_id") % 3)).alias("namespace"))


S.register_cte("cas", """SELECT task_id, seq, parent = 0 AS accepted, CASE WHEN parent = 0 THEN 1 ELSE 0 END AS head, CASE WHEN parent = 0 THEN namespace END AS scope, CASE WHEN parent <> 0 THEN 'cas_conflict' END AS reason FROM writes WHERE seq = 1
   UNION ALL SELECT w.task_id, w.seq, CASE WHEN c.head > 0 AND w.namespace <> c.scope THEN false ELSE w.parent = c.head END, c.head + CASE WHEN NOT (c.head > 0 AND w.namespace <> c.scope) AND w.parent = c.head THEN 1 ELSE 0 END,
     CASE WHEN c.head = 0 AND w.parent = 0 THEN w.namespace ELSE c.scope END, CASE WHEN c.head > 0 AND w.namespace <> c.scope THEN 'namespace_immutable' WHEN w.parent <> c.head THEN 'cas_conflict' END
   FROM cas c JOIN writes w ON w.task_id = c.task_id AND w.seq = c.seq + 1""", ["writes"])


@query("state_compare_and_set", S.with_ctes("cas", "SELECT task_id, seq, accepted, CASE WHEN accepted THEN head END::BIGINT AS version, reason FROM cas", recursive=True))
def _cas(t):
    return T.apply_state_writes(writes(t))


@query("active_heads", S.with_ctes("versions", "SELECT document_id AS task_id, max(observed_at) AS version, arg_max(parse_status, observed_at) AS parse_status, count(*) AS versions FROM versions GROUP BY 1"))
def _heads(t):
    from corpusmill.plans.catalog import versions

    return T.active_heads(versions(t).select(F.col("document_id").alias("task_id"), F.col("observed_at").alias("version"), "parse_status"))


@query("state_lifecycle", """
WITH h AS (SELECT conv_id AS task_id, max(turn) AS version, CASE WHEN max(turn) >= 6 THEN 'archived' ELSE 'active' END AS lifecycle, 'ns' || conv_id % 4 AS namespace FROM conversations GROUP BY 1),
c AS (SELECT DISTINCT conv_id AS task_id FROM conversations WHERE role = 'system')
SELECT task_id, version, namespace, CASE WHEN c.task_id IS NOT NULL AND lifecycle = 'active' THEN 'archived' ELSE lifecycle END AS lifecycle, CASE WHEN c.task_id IS NULL THEN 'untouched' WHEN lifecycle = 'active' THEN 'closed' ELSE 'already_closed' END AS outcome, NULL::VARCHAR AS forked_from
FROM h LEFT JOIN c USING (task_id) UNION ALL SELECT task_id + 1000000, 1, namespace, 'active', 'forked', task_id || '@' || version FROM h JOIN c USING (task_id)""")
def _lifecycle(t):
    h = t.conversations.groupBy(F.col("conv_id").alias("task_id")).agg(F.max("turn").alias("version")).withColumn(
        "lifecycle", F.when(F.col("version") >= 6, "archived").otherwise("active")).withColumn("namespace", F.concat(F.lit("ns"), F.col("task_id") % 4))
    c = t.conversations.filter("role = 'system'").select(F.col("conv_id").alias("task_id"))
    done = T.close_tasks(h, c).select("task_id", "version", "namespace", "lifecycle", "outcome", F.lit(None).cast("string").alias("forked_from"))
    f = T.fork(h, c.distinct().withColumn("new_task_id", F.col("task_id") + 1000000))
    return done.unionByName(f.select("task_id", "version", "namespace", F.lit("active").alias("lifecycle"), F.lit("forked").alias("outcome"), "forked_from"))


@query("state_promotion", """
WITH h AS (SELECT conv_id AS task_id, max(turn) AS version FROM conversations GROUP BY 1)
SELECT 'rv_' || substring(sha256(task_id || chr(0) || version), 1, 24) AS src, task_id || '@' || version AS dst, 'derived_from' AS kind FROM h""")
def _promote(t):
    h = t.conversations.groupBy(F.col("conv_id").alias("task_id")).agg(F.max("turn").alias("version")).withColumn("namespace", F.lit("ns"))
    return T.promote(h)[1]


S.register_cte("queue", """SELECT 'rq-' || doc_id AS review_id, doc_id AS item_id, conf AS confidence_pct, coalesce(flag, 'low_confidence') AS reason FROM (
   SELECT l.doc_id, least(95, d.n_chars // 50)::BIGINT AS conf, CASE WHEN toxic = 1 THEN 'uncategorized' END AS flag FROM labels l JOIN documents d USING (doc_id)) WHERE conf < 50""")


def review_queue(t):
    items = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        F.col("doc_id").alias("item_id"), F.least(F.lit(95), F.expr("n_chars div 50")).cast("bigint").alias("confidence_pct"), F.when(F.col("toxic") == 1, "uncategorized").alias("flag_reason"))
    return T.flag_items(items, 50)


@query("review_flagging", S.with_ctes("queue", "SELECT *, 'open' AS status FROM queue"))
def _flag(t):
    return review_queue(t)


@query("review_selection", S.with_ctes("queue", "SELECT review_id, reason FROM queue WHERE reason = 'uncategorized' ORDER BY review_id LIMIT 10"))
def _select_open(t):
    return T.select_open(review_queue(t), 10, ["uncategorized"]).select("review_id", "reason")


@query("review_resolution", S.with_ctes("queue", """
WITH r AS (SELECT 'rq-' || doc_id AS review_id, CASE WHEN lang <> 'es' THEN lang END AS answer, n_chars % 100 AS c, lang = 'de' AS w FROM documents WHERE lang <> 'en' OR n_chars % 2 = 0)
SELECT q.review_id, CASE WHEN r.review_id IS NULL THEN 'open' WHEN r.answer IS NULL OR w OR c < 40 THEN 'escalated' ELSE 'resolved' END AS status, CASE WHEN r.answer IS NOT NULL AND NOT w AND c >= 40 THEN r.answer END AS answer FROM queue q LEFT JOIN r USING (review_id)"""))
def _resolve(t):
    r = t.documents.filter("lang <> 'en' OR n_chars % 2 = 0").select(
        F.concat(F.lit("rq-"), "doc_id").alias("review_id"), F.when(F.col("lang") != "es", F.col("lang")).alias("answer"), (F.col("n_chars") % 100).alias("confidence_pct"), (F.col("lang") == "de").alias("wants_escalation"))
    return T.apply_resolutions(review_queue(t), r, 40)[0].select("review_id", "status", "answer")


@query("label_groups", """
WITH i AS (SELECT l.doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN d.lang <> 'en' AND quality = 1 THEN 'foreign' END], lambda x: x IS NOT NULL) AS labels, least(95, d.n_chars // 50)::BIGINT AS conf FROM labels l JOIN documents d USING (doc_id)),
x AS (SELECT unnest(CASE WHEN len(labels) = 0 THEN ['(none)'] ELSE labels END) AS label, conf FROM i)
SELECT label, count(*) AS items, sum(conf)::BIGINT AS confidence_sum, ((sum(conf) * 2 + count(*)) // (count(*) * 2))::BIGINT AS mean_pct FROM x GROUP BY 1""")
def _groups(t):
    d = t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id")
    labels = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.when((F.col("lang") != "en") & (F.col("quality") == 1), "foreign")))
    return T.group_labels(d.select(F.col("doc_id").alias("item_id"), labels.alias("labels"), F.least(F.lit(95), F.expr("n_chars div 50")).cast("bigint").alias("confidence_pct")))
