"""Time-series and geometry queries: users are media, events are samples, order lines are boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import textops as P
from corpusmill.operators import timeline as M
from corpusmill.plans import shapes as S
from corpusmill.plans.registry import query

HOUR = 3_600_000


def samples(t):
    return t.events.select(F.col("user_id").alias("media"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) div 1000").alias("t"), F.col("event_id").alias("sample_id"), "event_type", "value")


S.register_cte("smp", "SELECT user_id AS media, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 AS t, event_id AS sample_id, event_type, value FROM events")
S.register_cte("segs", "SELECT media, t AS start, row_number() OVER (PARTITION BY media ORDER BY t, sample_id) + 4 AS idx FROM smp WHERE event_type = 'signup'", ["smp"])


def segments(t):
    from corpusmill.operators.numbering import number_rows

    s = samples(t).filter("event_type = 'signup'").select("media", F.col("t").alias("start"), "sample_id")
    return number_rows(s, ["media"], ["start", "sample_id"], "n").select("media", "start", (F.col("n") + 5).alias("idx"))


@query("segment_assignment", S.with_ctes("segs", """
SELECT media, t, sample_id, coalesce((SELECT arg_max(idx, (start, idx)) FROM segs g WHERE g.media = s.media AND g.start <= s.t), (SELECT min(idx) - 1 FROM segs g WHERE g.media = s.media)) AS segment FROM smp s"""))
def _assign(t):
    return M.assign_segment(samples(t).select("media", "t", "sample_id"), segments(t))


S.register_cte("ivl", "SELECT media, t AS start, t + 1000 * (60 + floor(value * 600)::BIGINT) AS e, sample_id AS interval_id FROM smp WHERE event_type = 'purchase'", ["smp"])


def intervals(t):
    return samples(t).filter("event_type = 'purchase'").select("media", F.col("t").alias("start"), (F.col("t") + 1000 * (60 + F.floor(F.col("value") * 600))).cast("bigint").alias("end"), F.col("sample_id").alias("interval_id"))


@query("interval_containment", S.with_ctes("ivl", "SELECT s.sample_id, i.interval_id FROM smp s JOIN ivl i ON i.media = s.media AND s.t >= i.start AND s.t < i.e"))
def _contain(t):
    return M.contain(samples(t), intervals(t), 4 * HOUR).select("sample_id", "interval_id")


GAP = 6 * HOUR
S.register_cte("marked", f"""SELECT *, sum(CASE WHEN t - prev > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY media ORDER BY t, sample_id) AS island FROM (SELECT *, lag(t) OVER (PARTITION BY media ORDER BY t, sample_id) AS prev FROM smp)""", ["smp"])


def marked(t):
    return M.mark_islands(samples(t), "media", "t", "sample_id", GAP)


@query("presence_intervals", S.with_ctes("marked", """
SELECT media, 'presence' AS kind, island::BIGINT AS island, min(t) AS start, max(t) AS "end", count(*) AS observations FROM marked GROUP BY 1, 3
UNION ALL SELECT media, 'gap', island::BIGINT, min(prev), min(t), 0 FROM (SELECT *, row_number() OVER (PARTITION BY media, island ORDER BY t, sample_id) AS r FROM marked) WHERE island > 0 AND r = 1 GROUP BY 1, 3"""))
def _presence(t):
    return M.presence_intervals(marked(t), "media", "t")


@query("interval_evidence", S.with_ctes("marked", """
WITH q AS (SELECT *, floor(value * 100)::BIGINT AS q FROM marked)
SELECT media, island::BIGINT AS island, min(q) AS min_q, max(q) AS max_q, ((sum(q) * 2 + count(*)) // (count(*) * 2))::BIGINT AS mean_q, min(q) FILTER (prev IS NOT NULL) AS weakest_link, max(t - prev) AS longest_step, max(CASE WHEN island > 0 THEN 1 ELSE 0 END)::BIGINT AS reacquisitions FROM q GROUP BY 1, 2"""))
def _evidence(t):
    return M.interval_evidence(marked(t).withColumn("q", F.floor(F.col("value") * 100).cast("bigint")), "media", "q", "t")


@query("coverage_report", S.with_ctes("smp", """
SELECT c.c_custkey AS media, count(t) AS samples, min(t) AS first_t, max(t) AS last_t, max(t) - min(t) AS span, CASE WHEN count(t) = 0 THEN 'unknown' ELSE 'sampled' END AS semantics
FROM customer c LEFT JOIN smp ON smp.media = c.c_custkey GROUP BY 1"""))
def _coverage(t):
    return M.coverage_report(samples(t), t.customer.select(F.col("c_custkey").alias("media")))


def event_sources(t):
    s = samples(t)
    speech = s.filter("event_type = 'click'").select("media", F.when(F.col("value") > 0.5, F.col("t")).alias("t"), (F.col("t") + F.floor(F.col("value") * 100) - 500).cast("bigint").alias("t_end"), F.col("sample_id").alias("id"))
    cut = s.filter("event_type = 'signup'").select("media", (F.col("t") - 3600000).alias("t"), F.col("sample_id").alias("id"))
    return {"speech": speech, "cut": cut}


S.register_cte("nsrc", """SELECT media, CASE WHEN value > 0.5 THEN t END AS t, 'speech' AS kind, t + floor(value * 100)::BIGINT - 500 AS t_end, sample_id AS id FROM smp WHERE event_type = 'click'
   UNION ALL SELECT media, t - 3600000, 'cut', NULL, sample_id FROM smp WHERE event_type = 'signup'""", ["smp"])


@query("event_normalisation", S.with_ctes("nsrc", """
SELECT media, t, kind, CASE kind WHEN 'cut' THEN '{"id":' || id || '}' ELSE '{"id":' || id || ',"t_end":' || t_end || '}' END AS payload FROM nsrc WHERE t IS NOT NULL AND t >= 0 AND coalesce(t_end >= t, true)"""))
def _normalise(t):
    return M.normalise_events(event_sources(t))[0]


@query("event_violations", S.with_ctes("nsrc", """
SELECT kind, violation, count(*) AS n FROM (SELECT kind, 'missing_time' AS violation FROM nsrc WHERE t IS NULL UNION ALL SELECT kind, 'negative_time' FROM nsrc WHERE t < 0 UNION ALL SELECT kind, 'end_before_start' FROM nsrc WHERE t_end < t) GROUP BY 1, 2"""))
def _violations(t):
    return M.normalise_events(event_sources(t))[1].groupBy("kind", "violation").agg(F.count("*").alias("n"))


@query("timeline_index", """
SELECT "index", value, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (SELECT 'event_type' AS "index", event_type AS value, event_id FROM events UNION ALL SELECT 'user_id', user_id::VARCHAR, event_id FROM events UNION ALL SELECT 'props', props, event_id FROM events) GROUP BY 1, 2""")
def _index(t):
    return M.timeline_index(t.events, ["event_type", "user_id", "props"])


# Boxes: each order line is a box of its order (frame); the return flag is its class.
S.register_cte("box", """SELECT l_orderkey AS frame, l_returnflag AS class, l_linenumber * 1000000 + l_partkey AS id, (l_partkey % 40)::BIGINT AS x, (l_suppkey % 40)::BIGINT AS y, l_quantity::BIGINT AS w, (10 + l_linenumber * 5)::BIGINT AS h, l_extendedprice AS price, l_shipdate FROM lineitem""")


def boxes(t):
    q = F.col("l_quantity").cast("bigint")
    return t.lineitem.select(
        F.col("l_orderkey").alias("frame"), F.col("l_returnflag").alias("class"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id"),
        (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 40).alias("y"), q.alias("w"), (10 + F.col("l_linenumber") * 5).cast("bigint").alias("h"), F.col("l_extendedprice").alias("price"))


@query("box_overlap", S.with_ctes("box", """
WITH p AS (SELECT a.frame, a.class, a.id AS id_a, b.id AS id_b, greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0) AS i, a.w * a.h + b.w * b.h AS s
   FROM box a JOIN box b ON a.frame = b.frame AND a.class = b.class WHERE a.id < b.id)
SELECT frame, class, id_a, id_b, ((i * 1000000 + (s - i) // 2) // (s - i))::BIGINT AS iou FROM p WHERE s > i AND (i * 1000000 + (s - i) // 2) // (s - i) >= 300000"""))
def _iou(t):
    b = boxes(t)
    return M.iou_pairs(b, b, 300000, each_once=True)


@query("nms")
def _nms(t):
    b = boxes(t).select(F.col("frame").alias("image"), "class", "id", F.col("price").alias("score"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    return M.nms(b, 0.4)


def detections(t):
    """A supplier is a camera, its shipping days are the samples, the lines of a day the detections."""
    q = F.col("l_quantity").cast("bigint")
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1992-01-01 00:00:00', l_shipdate)")
    return t.lineitem.select(
        F.col("l_suppkey").alias("media"), day.alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("det"), F.col("l_returnflag").alias("class"),
        (F.col("l_partkey") % 60).alias("x"), (F.col("l_orderkey") % 60).alias("y"), (q + 20).alias("w"), (F.col("l_linenumber") * 5 + 20).cast("bigint").alias("h")).dropDuplicates(["media", "frame", "det"])


@query("track_greedy")
def _greedy(t):
    return M.track_greedy(detections(t), 0.3, 2)


@query("track_stable")
def _stable(t):
    d = detections(t).withColumn("sample", F.col("frame")).withColumn("ts", F.col("frame") * 400).withColumn("scene", F.expr("frame div 365"))
    return M.track_stable(d)


@query("near_duplicate_hashes", """
WITH h AS (SELECT vec_id AS id, array_to_string(list_transform(range(1, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN '1' ELSE '0' END), '') AS bits FROM embeddings), d AS (SELECT DISTINCT bits FROM h)
SELECT a.bits AS hash_a, b.bits AS hash_b, hamming(a.bits, b.bits)::BIGINT AS distance FROM d a JOIN d b ON a.bits < b.bits WHERE hamming(a.bits, b.bits) <= 11""")
def _neardup(t):
    bits = P.difference_bits(F.col("embedding"))
    return M.near_dup_pairs(t.embeddings.select(F.col("vec_id").alias("id"), bits.alias("bits")), 11, 63, 2)[0]


