"""Structured Streaming forms of the batch operators. State stays bounded by watermarks or TTL; sinks are idempotent per
micro-batch, so a restart after a lost executor or driver repeats nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.chunking import chunk_blocks
from corpusmill.operators.inverted import text_terms
from corpusmill.session import cut_lineage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet file of a folder as a file-source stream with the file's own schema."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_to_parquet(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Process everything there is, write append-only parquet, return it as a table."""
    q = df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def ledger_windows(ledger: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", streaming: bool = True) -> DataFrame:
    """(start, end, kind, entries, bytes): tumbling or sliding totals by kind. ledger: ts (TIMESTAMP), kind, bytes."""
    src = ledger.withWatermark("ts", late) if streaming else ledger
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return src.groupBy(w.alias("w"), "kind").agg(F.count("*").alias("entries"), F.sum("bytes").alias("bytes")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "entries", "bytes")


def late_rows(query) -> int:
    """Rows a finished query dropped because they came after the watermark."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def session_rollup(events: DataFrame, gap: str, late: str = "1 hour", streaming: bool = True) -> DataFrame:
    """(user_id, start, end, events, errors): sessions that close after ``gap`` without an event. Same function for a
    static table and a stream. The bounds come from aggregates, not from the window key: a filter on a key would be pushed
    below the merging of windows and cut sessions apart."""
    src = events.withWatermark("ts", late) if streaming else events
    return src.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("events"), F.sum((F.col("event_type") == "error").cast("bigint")).alias("errors"),
        F.min("ts").alias("start"), (F.max("ts") + F.expr(f"INTERVAL {gap}")).alias("end")).select("user_id", "start", "end", "events", "errors")


def state_writes(writes: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Compare-and-set per task on a stream of (task_id, seq, parent, namespace): task_id, seq, accepted, version, reason.

    The head lives in the state store (RocksDB), optionally with a time to live for tasks that went quiet. One micro-batch's
    writes of a task are taken in seq order.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

    key = dict(writes.dtypes)["task_id"]

    class Heads(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.head = handle.getValueState("head", "version bigint, namespace string", ttl_ms)

        def handleInputRows(self, k, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
            head, scope = (int(self.head.get()[0]), self.head.get()[1]) if self.head.exists() else (0, None)
            batch = pd.concat(list(rows)).sort_values("seq")
            out = []
            for seq, parent, ns in batch[["seq", "parent", "namespace"]].itertuples(index=False):
                asked, ns = (0 if pd.isna(parent) else int(parent)), (ns if isinstance(ns, str) and ns else None)
                reason = ("no_namespace_scope" if head == 0 and ns is None else
                          "namespace_immutable" if head and ns is not None and ns != scope else
                          "cas_conflict" if asked != head else None)
                if reason is None:
                    head, scope = head + 1, scope or ns
                out.append((k[0], seq, reason is None, head if reason is None else None, reason))
            if head:
                self.head.update((head, scope))
            yield pd.DataFrame(out, columns=["task_id", "seq", "accepted", "version", "reason"]).astype({"version": "Int64"})

        def close(self) -> None:
            pass

    return writes.groupBy("task_id").transformWithStateInPandas(
        statefulProcessor=Heads(), outputStructType=f"task_id {key}, seq bigint, accepted boolean, version bigint, reason string",
        outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None")


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _stored(spark: SparkSession, path: str, schema: str, hit: list[int] | None, before: int | None) -> DataFrame:
    """Rows of an index table (bucket, batch, ...): of the buckets hit, from batches before one. Buckets and batches are folders, so
    nothing else is read."""
    full = f"{schema}, bucket int, batch bigint"
    try:
        rows = spark.read.schema(full).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    rows = rows if hit is None else rows.filter(F.col("bucket").isin(hit))
    return rows if before is None else rows.filter(F.col("batch") < before)


def _newest(rows: DataFrame) -> DataFrame:
    """Of each bucket the rows of its latest batch."""
    last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["bucket", "batch"], "left_semi")


#: From so many new texts a bucket on, a batch's chunks and postings are written where they lie, some files a bucket; of smaller batches a bucket
#: is one file.
SPREAD = 1000


def _put(df: DataFrame, path: str, batch_id: int, gather: bool = True) -> None:
    """Write one batch's folders; a retried batch replaces its own and no others."""
    df = df.withColumn("batch", F.lit(batch_id).cast("bigint"))
    df = df.repartition("bucket") if gather else df
    df.write.partitionBy("bucket", "batch").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").mode("overwrite").parquet(path)


INDEX_TABLES = {"seen": "content_hash string", "chunks": "doc_id bigint, chunk_id string, text string", "postings": "chunk_id string, term string, tf bigint, dl bigint",
                "terms": "term string, df bigint, cf bigint"}


def index_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the incremental index as it stands: seen, chunks, postings, or terms (term, df, cf)."""
    rows = _stored(spark, f"{out}/{name}", INDEX_TABLES[name], None, None)
    return (_newest(rows) if name == "terms" else rows).drop("bucket", "batch")


def _written(df: DataFrame, out: str, name: str, batch_id: int, gather: bool) -> DataFrame:
    """Put a batch's rows into a table of the index and read them from there, so they are stored once. A retried batch, of whose first
    try other buckets may be left, is read from a copy of its own."""
    stored = _stored(df.sparkSession, f"{out}/{name}", INDEX_TABLES[name], None, None).filter(F.col("batch") == batch_id)
    if not stored.isEmpty():
        df = cut_lineage(df)
        _put(df, f"{out}/{name}", batch_id, gather)
        return df
    _put(df, f"{out}/{name}", batch_id, gather)
    return _stored(df.sparkSession, f"{out}/{name}", INDEX_TABLES[name], None, None).filter(F.col("batch") == batch_id).drop("batch")


def _only(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """Of rows with a ``_row`` those whose number is in the other table. A bit says it for each, so that the rows' texts are not shuffled."""
    at = F.col("_row") + 1
    marks = cut_lineage(numbers.groupBy(F.bitmap_bucket_number(at).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits")))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (F.call_function("div", bit, F.lit(8).cast("bigint")) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("_part", F.bitmap_bucket_number(at)).join(marks, "_part").filter(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("_part", "_bits")


def _postings(chunks: DataFrame) -> DataFrame:
    """(chunk_id, term, tf, dl), counted where the chunks lie. Chunks of one id, which come from texts of one doc_id, count as one."""
    rows = text_terms(chunks.withColumn("source_path", F.lit(""))).select("chunk_id", F.inline("entries"), "dl").select("chunk_id", "term", "tf", "dl")
    many = cut_lineage(chunks.groupBy("chunk_id").agg(F.count("*").alias("_n")).filter("_n > 1").select("chunk_id"))
    if many.isEmpty():
        return rows
    shared = rows.join(many, "chunk_id", "left_semi").groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    return rows.join(many, "chunk_id", "left_anti").unionByName(shared)


def add_to_index(docs: DataFrame, out: str, batch_id: int, max_chars: int = 1200, buckets: int = 64) -> None:
    """Add documents (doc_id, text, content_hash) to the index under ``out``; texts seen in earlier batches are left out,
    and of equal ones the smallest id counts.

    Only the buckets that the batch's hashes and terms fall into are read and written. Seen texts, chunks and postings are appended to their
    buckets; a bucket of term numbers is replaced by the sum of its last state and the batch. The same batch again gives the same folders.
    Texts are written once as they come and once as chunks, and not shuffled here in a large batch; hashes and ids alone say which are new.
    """
    spark = docs.sparkSession
    rows = cut_lineage(_bucketed(docs.select("doc_id", "text", "content_hash"), "content_hash", buckets).withColumn("_row", F.monotonically_increasing_id()))
    hit = [r.bucket for r in rows.select("bucket").distinct().collect()]
    seen = _stored(spark, f"{out}/seen", INDEX_TABLES["seen"], hit, batch_id)
    firsts = rows.groupBy("bucket", "content_hash").agg(F.min(F.struct("doc_id", "_row")).alias("d")).select("bucket", "content_hash", "d._row")
    new = cut_lineage(firsts.join(seen.select("content_hash"), "content_hash", "left_anti"))
    gather = new.count() < SPREAD * buckets
    cut = chunk_blocks(_only(rows, new), max_chars).select("doc_id", F.concat_ws("#", "doc_id", "chunk_index").alias("chunk_id"), "text")
    chunks = _written(_bucketed(cut, "chunk_id", buckets), out, "chunks", batch_id, gather)
    post = _written(_bucketed(_postings(chunks), "term", buckets), out, "postings", batch_id, gather)
    changed = [r.bucket for r in post.select("bucket").distinct().collect()]
    old = _newest(_stored(spark, f"{out}/terms", INDEX_TABLES["terms"], changed, batch_id)).drop("batch")
    more = post.groupBy("bucket", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    terms = old.unionByName(more).groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    _put(cut_lineage(terms), f"{out}/terms", batch_id)
    _put(new.select("content_hash", "bucket"), f"{out}/seen", batch_id)


def incremental_index(docs: DataFrame, out: str, checkpoint: str, max_chars: int = 1200, late: str = "1 day", buckets: int = 64):
    """A stream of documents (doc_id, text, content_hash, ts) into the index under ``out``, each text indexed once: repeats inside the
    watermark are dropped by the stream's state, older ones are found in the seen table. A restart after any failure repeats its last micro-batch."""
    fresh = docs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])
    return fresh.writeStream.foreachBatch(lambda batch, n: add_to_index(batch, out, n, max_chars, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dispatch_reconciliation(plan: DataFrame, reports: DataFrame, within: str, late: str = "1 hour") -> DataFrame:
    """plan: (worker_id, plan_id, planned_at); reports: (worker_id, reported_at, state). Left outer stream-stream join: a
    dispatch without a report inside ``within`` comes out as unreported once the watermark has passed."""
    p = plan.withWatermark("planned_at", late).alias("p")
    r = reports.withWatermark("reported_at", late).select(F.col("worker_id").alias("r_worker"), "reported_at", "state").alias("r")
    cond = (F.col("worker_id") == F.col("r_worker")) & (F.col("reported_at") >= F.col("planned_at")) & (
        F.col("reported_at") <= F.col("planned_at") + F.expr(f"INTERVAL {within}"))
    return p.join(r, cond, "left_outer").select("plan_id", "worker_id", "planned_at", "reported_at", F.coalesce("state", F.lit("unreported")).alias("state"))
