"""Streams against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

from corpusmill.operators import events as T
from corpusmill.operators.chunking import chunk_blocks
from corpusmill.operators.search import postings
from corpusmill.streaming import streams as X


def test_sessions_equal_batch_for_closed_sessions(spark, tables, tmp_path):
    cast = lambda df: df.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = X.session_rollup(cast(X.table_stream(spark, tables.root, "events")), "6 hours")
    got = X.run_to_parquet(stream, str(tmp_path / "o"), str(tmp_path / "c"))
    batch = X.session_rollup(cast(tables.events), "6 hours", streaming=False)
    limit = tables.events.agg(F.max(F.col("ts").cast("timestamp")).alias("m")).first().m - dt.timedelta(hours=1)
    closed = batch.filter(F.col("end") <= F.lit(limit))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect())) and got.count() > 0


def test_late_rows_are_counted(spark, tmp_path):
    src = tmp_path / "in"
    put = lambda i, rows: spark.createDataFrame(rows, "ts string, kind string, bytes bigint").coalesce(1).write.parquet(str(src / f"{i}"))
    put(1, [("2024-01-01 00:10:00", "card", 1), ("2024-01-02 12:00:00", "card", 2)])
    put(2, [("2024-01-02 12:30:00", "card", 4)])
    put(3, [("2024-01-01 00:20:00", "card", 8), ("2024-01-03 00:00:00", "card", 16)])
    s = spark.readStream.schema("ts string, kind string, bytes bigint").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(src))
    w = X.ledger_windows(s.withColumn("ts", F.to_timestamp("ts")), "1 hour")
    q = w.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert X.late_rows(q) == 1
    total = spark.read.schema(w.schema).parquet(str(tmp_path / "o")).agg(F.sum("bytes")).first()[0]
    assert total == 7


def test_state_stream_equals_batch(spark, tmp_path):
    data = [(t, s, p, n) for t in (1, 2, 3) for s, (p, n) in enumerate([(None, "a"), (1, "a"), (1, "a"), (2, "b"), (2, None), (0, "a"), (3, "a")], 1)]
    df = spark.createDataFrame(data, "task_id bigint, seq bigint, parent bigint, namespace string")
    for i, cut in enumerate(("seq <= 3", "seq > 3")):
        df.filter(cut).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    batch = sorted(map(tuple, T.apply_state_writes(df).collect()), key=str)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", X.ROCKSDB)
    try:
        s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        got = X.run_to_parquet(X.state_writes(s), str(tmp_path / "o"), str(tmp_path / "c"))
        assert sorted(map(tuple, got.select("task_id", "seq", "accepted", "version", "reason").collect()), key=str) == batch
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_incremental_index_equals_batch(spark, tables, tmp_path):
    docs = tables.documents.select("doc_id", "text", F.sha2("text", 256).alias("content_hash"), F.timestamp_seconds(F.col("doc_id") * 60 + 1_700_000_000).alias("ts"))
    docs.filter("doc_id < 100").coalesce(1).write.parquet(str(tmp_path / "in" / "0"))
    docs.filter("doc_id >= 100").coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    s = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    X.incremental_index(s, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    firsts = docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    want = postings(chunk_blocks(firsts, 1200).withColumn("chunk_id", F.concat_ws("#", "doc_id", "chunk_index")))
    terms = want.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    got = X.index_table(spark, str(tmp_path / "o"), "terms")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, terms.collect()))
    X.add_to_index(docs.filter("doc_id >= 100"), str(tmp_path / "o"), 1)                       # the last micro-batch once more, and one of known texts
    X.add_to_index(docs, str(tmp_path / "o"), 9)
    assert sorted(map(tuple, X.index_table(spark, str(tmp_path / "o"), "terms").collect())) == sorted(map(tuple, terms.collect()))
    assert X.index_table(spark, str(tmp_path / "o"), "postings").count() == want.count()


def test_large_batches_are_written_where_they_lie(spark, tmp_path, monkeypatch):
    """Repeated texts, ids of several texts, null ids and texts, with and without gathering; a text is copied once before it is cut."""
    body = lambda i: "\n".join(f"word{(i * 7 + j) % 23} line{j} of{i}" for j in range(30))
    data = [(i % 50, body(i % 60), f"h{i % 60}") for i in range(90)] + [(None, body(200), "h200"), (None, body(201), "h201"), (7, None, None), (3, "", "empty")]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, content_hash string")
    firsts = docs.groupBy("content_hash").agg(F.min(F.struct("doc_id", "text")).alias("d")).select("d.*")
    want = postings(chunk_blocks(firsts, 100).withColumn("chunk_id", F.concat_ws("#", "doc_id", "chunk_index"))).select("chunk_id", "term", "tf")
    want = sorted(map(tuple, want.collect()))
    copies, cut = [], X.cut_lineage
    monkeypatch.setattr(X, "cut_lineage", lambda df: copies.append(df.columns) or cut(df))
    for spread in (0, 1000):
        monkeypatch.setattr(X, "SPREAD", spread)
        out = str(tmp_path / str(spread))
        copies.clear()
        X.add_to_index(docs.repartition(3), out, 0, 100, 4)
        assert sum("text" in c for c in copies) == 1 and not any("tf" in c for c in copies)
        X.add_to_index(docs, out, 0, 100, 4)                                                     # once more
        X.add_to_index(docs.filter("content_hash <> 'h1'"), out, 1, 100, 4)                      # nothing new
        assert sorted(map(tuple, X.index_table(spark, out, "postings").select("chunk_id", "term", "tf").collect())) == want
        cf = {t: sum(n for _, u, n in want if u == t) for _, t, _ in want}
        assert {r.term: r.cf for r in X.index_table(spark, out, "terms").collect()} == cf
        assert X.index_table(spark, out, "seen").filter("content_hash IS NOT NULL").count() == 63
