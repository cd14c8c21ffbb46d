"""The registered queries of the operators: each reads its whole table and derives the columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import byte_bpe, chat_trees, decontaminate, disclosure, line_dedup, near_dedup, periodic_runs, quality_mil, quality_rules, suffix_dedup, toxicity_ftrl, turn_repair, warc
from corpusmill.llm.common import let, shared_path, stored

RANKS = "byte_bpe_multi_50k.tiktoken"
QUALITY_KEPT, TOXIC = 0.7, 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bucket(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def _scored(df: DataFrame, held_out, threshold: float) -> DataFrame:
    return df.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_boilerplate(docs, dropped_name="n_dropped").select("doc_id", "text", "n_dropped")


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents").select("doc_id", "text"), _bucket(4) == 2
    model = quality_mil.fit(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    return _scored(quality_mil.score(docs, model), held_out, QUALITY_KEPT)


def op3_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents").select("doc_id", "text"), _bucket(5) == 0
    model = toxicity_ftrl.fit(docs, _table(spark, sf_dir, "labels").filter(~held_out))
    return _scored(toxicity_ftrl.score(docs, model), held_out, TOXIC)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, decoded_name="decoded")
    return coded.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op6_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = rows.unionByName(own.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]))
    done = chat_trees.conversations(stored(chat_trees.linear(rows), "messages"))
    turns = chat_trees.read_back(F.col("formatted"))
    loss = chat_trees.masked(F.col("formatted"), F.col("loss"))
    back = stored(done.select(F.col("tree").alias("conv_id"), turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars")), "read_back")
    said_by = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said_by, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.start", "m.end")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4).withColumnRenamed("id", "doc_id")


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [disclosure.count("base", kind).alias(f"n_{kind}") for kind in disclosure.PATTERNS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(disclosure.listed(F.col("base")), 256).alias("base_sha256"), disclosure.listed(F.col("spans")).alias("spans"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = shared_path(pages, "warc")
    warc.write(pages, path)
    return warc.read(spark, path, payloads=False).select(F.col("id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.drop_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    return kept.select("doc_id", (F.octet_length("kept_bytes") + removed).cast("bigint").alias("n_bytes"), removed.alias("n_removed"),
                       F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def looped(doc_id, text):
    """The text in which, for one doc_id of ten, the words from some place on repeat the first of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def loop(words):
        n = F.size(words).cast("bigint")
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")

    found = let(F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+)"), 1), loop)
    return F.when((h % 10 == 0) & text.isNotNull(), found).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.find_runs(docs)

    def better(x, best):
        more, most = x["length"] * best["period"], best["length"] * x["period"]
        return (more > most) | ((more == most) & (F.struct(x["start"], x["period"]) < F.struct(best["start"], best["period"])))

    best = F.aggregate("runs", F.element_at("runs", 1), lambda s, x: F.when(better(x, s), x).otherwise(s))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))), "")
    rows = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return rows.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults put in: one of twenty each is dropped, emptied, robbed of its full stops, repeated, given to the user."""
    def said(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    n = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(n == 1, "").when(n == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    copies = F.when(n == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(n != 0).select("conv_id", "turn", F.when(n == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = turn_repair.repair(damaged(rows))
    found = report.join(turn_repair.digests(repaired), "c", "left").drop("c")
    every = rows.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, every.conv_id.eqNullSafe(found.conv), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_mil, op3_toxicity_ftrl, op4_byte_bpe, op5_quality_rules,
                                  op6_chat_trees, op7_decontaminate, op8_near_dedup, op9_disclosure, op10_warc, op11_suffix_dedup, op12_periodic_runs, op13_turn_repair)}
SQL: dict[str, str] = {"op1_line_dedup": line_dedup.SQL, "op6_chat_trees": chat_trees.SQL, "op10_warc": warc.SQL}
