"""Audit and reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import audit as A
from corpusmill.plans import shapes as S
from corpusmill.plans.catalog import ledger
from corpusmill.plans.evaluation import pp
from corpusmill.plans.registry import query


@query("ledger_summary", S.with_ctes("ledger", f"""
WITH g AS (SELECT target, count(*) AS entries, coalesce(sum(bytes) FILTER (kind = 'boot_packet'), 0)::BIGINT AS boot_bytes, coalesce(sum(bytes) FILTER (kind = 'whole_doc_open'), 0)::BIGINT AS whole_bytes,
  coalesce(sum(bytes) FILTER (kind IN ('section', 'card', 'query')), 0)::BIGINT AS bounded_bytes, count(*) FILTER (kind IN ('section', 'card', 'query')) AS n_queries, count(*) FILTER (kind = 'whole_doc_open' AND bytes > 40000) AS oversize_opens FROM ledger GROUP BY 1)
SELECT *, {pp('bounded_bytes', 'bounded_bytes + whole_bytes + boot_bytes')} AS bounded_fraction, {pp('bounded_bytes', 'bounded_bytes + whole_bytes')} AS discretionary_fraction, CASE WHEN boot_bytes <= 20000 THEN 'pass' ELSE 'warn' END AS boot_bar,
 whole_bytes > 0 AND bounded_bytes = 0 AS zero_bounded_gate, bounded_bytes = 0 OR bounded_bytes * 1000000 < (bounded_bytes + whole_bytes) * 700000 AS fraction_gate FROM g"""))
def _summary(t):
    return A.ledger_summary(ledger(t), ["target"], 700_000)


@query("log_cross_check", """
SELECT 'unbacked' AS finding, key FROM (SELECT DISTINCT 'u' || user_id AS key FROM events WHERE event_type = 'error') WHERE key NOT IN (SELECT 'u' || user_id FROM events WHERE value > 40)
UNION ALL SELECT 'unrecorded', key FROM (SELECT DISTINCT 'u' || user_id AS key FROM events WHERE value > 40) WHERE key NOT IN (SELECT 'u' || user_id FROM events WHERE event_type = 'error')""")
def _cross(t):
    k = F.concat(F.lit("u"), "user_id").alias("key")
    return A.cross_check(t.events.filter("event_type = 'error'").select(k), t.events.filter("value > 40").select(k))


@query("budget_status", S.with_ctes("records", """
WITH b AS (SELECT 'summary' AS class, 1500 AS budget UNION ALL SELECT 'decision', 2500 UNION ALL SELECT 'failure', NULL),
j AS (SELECT rvid AS item, kind AS class, n_chars AS size, coalesce(CASE WHEN n_chars % 50 = 0 THEN 5000 END, b.budget)::BIGINT AS budget, b.class IS NOT NULL AS known FROM records r LEFT JOIN b ON b.class = r.kind)
SELECT item, class, size, budget, CASE WHEN budget IS NULL AND NOT known THEN 'unlisted' WHEN budget IS NULL THEN 'nocap' WHEN size * 100 > budget * 100 THEN 'over' WHEN size * 100 >= budget * 90 THEN 'warn' ELSE 'ok' END AS status, coalesce(size * 100 > budget * 110, false) AS red FROM j"""))
def _budget(t):
    r = S.records(t)
    b = t.spark.createDataFrame([("summary", 1500), ("decision", 2500), ("failure", None)], "class string, budget bigint")
    o = r.filter("n_chars % 50 = 0").select(F.col("rvid").alias("item"), F.lit(5000).alias("budget"))
    return A.budget_status(r.select(F.col("rvid").alias("item"), F.col("kind").alias("class"), F.col("n_chars").alias("size")), b, o)


@query("status_pivot", S.with_ctes("records", """
SELECT namespace, count(*) AS total, count(*) FILTER (status = 'current') AS current, count(*) FILTER (status = 'superseded') AS superseded, count(*) FILTER (status NOT IN ('current', 'superseded')) AS other FROM records GROUP BY 1"""))
def _pivot(t):
    return A.status_pivot(S.records(t), "namespace", "status", ["current", "superseded"])


@query("unit_provenance", """
WITH p AS (SELECT 'u' || o_custkey AS unit, max(o_orderstatus) AS state FROM orders GROUP BY 1), t AS (SELECT 'u' || user_id AS unit, bool_and(value < 55) AS passed FROM events GROUP BY 1),
c AS (SELECT 'u' || l_partkey AS unit, arg_max(l_orderkey * 10 + l_linenumber, (l_shipdate, l_orderkey * 10 + l_linenumber)) AS last_change, count(*) AS changes FROM lineitem GROUP BY 1)
SELECT unit, state, passed, last_change, coalesce(changes, 0) AS changes, CASE WHEN passed IS NULL THEN 'planned_only' WHEN NOT passed THEN 'failing' WHEN state IS NULL THEN 'tested_only' ELSE 'verified' END AS status FROM p FULL JOIN t USING (unit) LEFT JOIN c USING (unit)""")
def _units(t):
    u = lambda c: F.concat(F.lit("u"), c).alias("unit")
    return A.unit_provenance(
        t.orders.select(u("o_custkey"), F.col("o_orderstatus").alias("state")), t.events.select(u("user_id"), (F.col("value") < 55).alias("passed")),
        t.lineitem.select(u("l_partkey"), F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("change_id")))


def _day(c):
    return F.expr(f"timestampdiff(DAY, TIMESTAMP_NTZ'1992-01-01 00:00:00', {c})")


def change_log(t):
    return t.orders.select(F.col("o_orderkey").alias("record_id"), _day("o_orderdate").alias("at"))


def change_members(t):
    return t.lineitem.select(F.col("l_orderkey").alias("record_id"), F.col("l_suppkey").alias("member"))


@query("iteration_build", """
WITH d AS (SELECT o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS dd FROM orders),
per AS (SELECT DISTINCT dd // 90 AS period, (dd // 90) * 90 AS f, (dd // 90) * 90 + 89 AS l FROM d)
SELECT period, count(DISTINCT o_orderkey) AS records, count(DISTINCT l_suppkey) AS members FROM per JOIN d ON d.dd BETWEEN f AND l LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def _iterations(t):
    log = change_log(t)
    per = log.select(F.expr("at div 90").alias("period")).distinct().select("period", (F.col("period") * 90).alias("first"), (F.col("period") * 90 + 89).alias("last"))
    return A.iteration_build(per, log, change_members(t))


@query("new_since", """
WITH d AS (SELECT o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS dd FROM orders)
SELECT l_suppkey AS member, arg_min(o_orderkey, (dd, o_orderkey)) AS first_record, count(*) AS n FROM d JOIN lineitem ON l_orderkey = o_orderkey WHERE dd > 2000 GROUP BY 1""")
def _new(t):
    return A.new_since(change_log(t), change_members(t), 2000)


@query("entity_validation", """
WITH e AS (SELECT CASE WHEN p_size = 50 THEN 'Part:' ELSE 'part:' END || p_partkey AS id, CASE p_type WHEN 'PROMO' THEN 'gone' ELSE 'live' END AS status, CASE WHEN p_size < 3 THEN 0 ELSE 1 END AS n FROM part
   UNION ALL SELECT CASE WHEN s_nationkey = 3 THEN 'vendor:' ELSE 'supp:' END || s_suppkey, 'live', 1 FROM supplier),
x AS (SELECT 'part:' || l_partkey AS src, CASE WHEN l_tax = 0 AND l_discount = 0 THEN 'likes' ELSE 'made_by' END AS type, CASE WHEN l_quantity = 50 THEN 'part:' ELSE 'supp:' END || l_suppkey AS dst, CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS n FROM lineitem),
f AS (SELECT 'bad_id' AS code, id AS subject FROM e WHERE NOT regexp_full_match(id, '[a-z]+:[A-Za-z0-9#_.\\-]+') UNION ALL SELECT 'unknown_namespace', id FROM e WHERE split_part(id, ':', 1) NOT IN ('part', 'supp')
 UNION ALL SELECT 'bad_status', id FROM e WHERE status <> 'live' UNION ALL SELECT 'duplicate_id', id FROM e GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'missing_provenance', id FROM e WHERE n = 0
 UNION ALL SELECT 'unknown_edge_type', src || '>' || type || '>' || dst FROM x WHERE type <> 'made_by' UNION ALL SELECT 'edge_domain', src || '>' || type || '>' || dst FROM x WHERE type = 'made_by' AND NOT starts_with(dst, 'supp:')
 UNION ALL SELECT 'edge_without_source', src || '>' || type || '>' || dst FROM x WHERE n = 0 UNION ALL SELECT 'dangling_src', src || '>' || type || '>' || dst FROM x WHERE src NOT IN (SELECT id FROM e)
 UNION ALL SELECT 'dangling_dst', src || '>' || type || '>' || dst FROM x WHERE dst NOT IN (SELECT id FROM e) UNION ALL SELECT 'duplicate_edge', src || '>' || type || '>' || dst FROM x GROUP BY src, type, dst HAVING count(*) > 1)
SELECT code, count(*) AS n, min(subject) AS first_subject, max(subject) AS last_subject FROM f GROUP BY 1""")
def _entities(t):
    e = t.part.select(F.concat(F.when(F.col("p_size") == 50, "Part:").otherwise("part:"), "p_partkey").alias("id"), F.when(F.col("p_type") == "PROMO", "gone").otherwise("live").alias("status"),
                      F.when(F.col("p_size") < 3, 0).otherwise(1).alias("n_sources")).unionByName(
        t.supplier.select(F.concat(F.when(F.col("s_nationkey") == 3, "vendor:").otherwise("supp:"), "s_suppkey").alias("id"), F.lit("live").alias("status"), F.lit(1).alias("n_sources")))
    x = t.lineitem.select(
        F.concat(F.lit("part:"), "l_partkey").alias("src"), F.when((F.col("l_tax") == 0) & (F.col("l_discount") == 0), "likes").otherwise("made_by").alias("type"),
        F.concat(F.when(F.col("l_quantity") == 50, "part:").otherwise("supp:"), "l_suppkey").alias("dst"), F.when(F.col("l_linenumber") == 7, 0).otherwise(1).alias("n_sources"))
    f = A.validate_entities(e, x, ["part", "supp"], ["live"], {"made_by": ("part", "supp")})
    return f.groupBy("code").agg(F.count("*").alias("n"), F.min("subject").alias("first_subject"), F.max("subject").alias("last_subject"))
