"""Streaming queries: the events table read as a stream and drained; the SQL twins see the closed windows only."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.plans import shapes as S
from corpusmill.plans.documents import lex_sql
from corpusmill.plans.registry import query
from corpusmill.plans.traces import writes
from corpusmill.session import ensure_checkpoint_dir
from corpusmill.streaming import streams as X


def _place(t) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/streams/{uuid.uuid4().hex}"


def ledger_stream(t):
    e = X.table_stream(t.spark, t.root, "events")
    k = F.col("event_type")
    kind = (F.when(k == "signup", "boot_packet").when(k == "view", "section").when(k == "click", "card").when(k == "purchase", "query").otherwise("whole_doc_open"))
    return e.select(F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), (F.floor(F.abs("value") * 100) + 1).cast("bigint").alias("bytes"))


def _drain(t, df):
    place = _place(t)
    out = X.run_to_parquet(df, f"{place}/out", f"{place}/ckpt")
    return out.withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end"))


@query("ledger_stream_daily", S.with_ctes("ledger", """
SELECT epoch_us(date_trunc('day', ts)) AS start, epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) AS "end", kind, count(*) AS entries, sum(bytes)::BIGINT AS bytes FROM ledger
GROUP BY 1, 2, 3 HAVING epoch_us(max(date_trunc('day', ts)) + INTERVAL 1 DAY) <= (SELECT epoch_us(max(ts) - INTERVAL 1 HOUR) // 1000 * 1000 FROM ledger)"""))
def _daily(t):
    return _drain(t, X.ledger_windows(ledger_stream(t), "1 day"))


@query("ledger_stream_sliding", S.with_ctes("ledger", """
WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS s, kind, bytes FROM ledger, unnest([0, 1]) u(k))
SELECT epoch_us(s) AS start, epoch_us(s + INTERVAL 1 HOUR) AS "end", kind, count(*) AS entries, sum(bytes)::BIGINT AS bytes FROM w
GROUP BY 1, 2, 3 HAVING epoch_us(max(s) + INTERVAL 1 HOUR) <= (SELECT epoch_us(max(ts) - INTERVAL 1 HOUR) // 1000 * 1000 FROM ledger)"""))
def _sliding(t):
    return _drain(t, X.ledger_windows(ledger_stream(t), "1 hour", "30 minutes"))


@query("session_rollup", """
WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM m)
SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts) + INTERVAL 6 HOUR) AS "end", count(*) AS events, (count(*) FILTER (event_type = 'error'))::BIGINT AS errors FROM s GROUP BY user_id, sid""")
def _sessions(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = X.session_rollup(e, "6 hours", streaming=False)
    return out.withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end"))


@query("dispatch_stream")
def _dispatch(t):
    day = lambda c: F.col(c).cast("timestamp")
    plan = X.table_stream(t.spark, t.root, "orders").select(F.col("o_orderkey").alias("worker_id"), F.concat(F.lit("c"), "o_custkey").alias("plan_id"), day("o_orderdate").alias("planned_at"))
    rep = X.table_stream(t.spark, t.root, "lineitem").select(F.col("l_orderkey").alias("worker_id"), day("l_shipdate").alias("reported_at"), F.col("l_linestatus").alias("state"))
    place = _place(t)
    out = X.run_to_parquet(X.dispatch_reconciliation(plan, rep, "60 DAYS", "1 day"), f"{place}/out", f"{place}/ckpt")
    return out.groupBy("state").agg(F.count("*").alias("n"))


@query("state_stream", S.with_ctes("cas", "SELECT task_id, seq, accepted, CASE WHEN accepted THEN head END::BIGINT AS version, reason FROM cas", recursive=True))
def _state(t):
    """The writes as a stream: the first three of each task, then, after a restart from the checkpoint, the others."""
    place, spark = _place(t), t.spark
    rows = writes(t)
    # without the second setting a state with a time to live has one more batch, without data, for ever
    own = {"spark.sql.streaming.stateStore.providerClass": X.ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        for part, cut in enumerate(("seq <= 3", "seq > 3")):
            rows.filter(cut).write.parquet(f"{place}/in/part={part}")
            src = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{place}/in")
            out = X.run_to_parquet(X.state_writes(src, ttl_ms=7 * 86_400_000), f"{place}/out", f"{place}/ckpt")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return out


@query("index_stream", f"""
WITH d AS (SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1), k AS (SELECT doc_id, unnest({lex_sql('text')}) AS term FROM d)
SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS n_texts FROM k GROUP BY 1""")
def _index(t):
    """All documents in arrival order, in two runs of a stream: every text is offered again in the second one and indexed once."""
    place, spark = _place(t), t.spark
    docs = t.documents.select("doc_id", "text", F.sha2("text", 256).alias("content_hash"), F.timestamp_seconds(F.col("doc_id") * 60 + 1_700_000_000).alias("ts"))
    half = docs.agg(F.expr("percentile_approx(doc_id, 0.5)")).first()[0]
    parts = [docs.filter(F.col("doc_id") <= half), docs.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1000 DAYS"))]
    for n, part in enumerate(parts):
        part.write.option("compression", "zstd").parquet(f"{place}/in/part={n}")
        src = spark.readStream.schema(docs.schema).option("recursiveFileLookup", True).parquet(f"{place}/in")
        X.incremental_index(src, f"{place}/index", f"{place}/ckpt", buckets=8).awaitTermination()
    post = X.index_table(spark, f"{place}/index", "postings")
    texts = post.withColumn("doc_id", F.substring_index("chunk_id", "#", 1).cast("bigint")).groupBy("term").agg(F.count_distinct("doc_id").alias("n_texts"))
    return X.index_table(spark, f"{place}/index", "terms").select("term", "cf").join(texts, "term")
