"""The corpus pipeline: five stages over ``documents``, each an operator of corpusmill.llm with its production parameters.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written before the next one reads it.
All but the last return the columns of documents. The last adds ``n_tokens`` and ``token_ids``, and fails the run where
decoding does not give the text back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality_mil
from corpusmill.llm.common import fresh, stored
from corpusmill.llm.queries import QUALITY_KEPT, RANKS


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under the threshold go; with labels of one kind only, there is no classifier and
    all stay."""
    model = quality_mil.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model["both"]:
        return docs
    [score] = fresh(docs, "quality_score")
    return quality_mil.score(docs, model, name=score).filter(F.col(score) >= QUALITY_KEPT).select(*_columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, those of five words and more from one per cent of its pages on, and n_chars follows the text."""
    out = line_dedup.drop_boilerplate(docs, long_percent=1)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    gone = stored(near_dedup.near_duplicates(docs).filter("not kept").select("id").distinct(), "gone")
    return docs.join(gone, docs.doc_id == gone.id, "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    [leaks] = fresh(docs, "leaks")
    found = decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=leaks)
    return found.filter(F.size(leaks) == 0).select(*_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids, decoded = fresh(docs, "token_ids", "decoded_bytes")
    out = byte_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids_name=ids, decoded_name=decoded)
    same = F.col(decoded) == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return out.select(*_columns(docs), F.size(ids).cast("bigint").alias(fresh(docs, "n_tokens")[0]),
                      F.when(same, F.col(ids)).otherwise(F.raise_error(F.lit("decoding did not give the text back"))).alias(ids))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("byte-level BPE", tokens)]

#: A trained classifier has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
