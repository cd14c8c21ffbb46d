"""Record catalog as tables: idempotent ingest, vector import, listing and fetch with accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The status vocabulary.
STALE_STATUSES = ("source_stale", "derivation_stale", "embedding_stale", "relationship_stale", "summary_stale",
                  "authority_stale", "temporal_expiry", "superseded", "deleted", "unverified")
STATUSES = ("current", *STALE_STATUSES)


def ingest_records(incoming: DataFrame, existing: DataFrame, edges: DataFrame, kinds: list[str]) -> DataFrame:
    """Adds ``outcome`` (accepted / unchanged / rejected) and ``reason`` to every incoming row.

    incoming: (seq, rvid, record_id, kind, namespace, status, text, content_hash); existing: (rvid, namespace,
    content_hash); edges: (rvid, ref) derivation references of the batch. A batch is taken in (rvid, seq) order: later
    copies of an id are unchanged or a conflict with the first one that was acceptable.
    """
    h = F.coalesce("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = incoming.withColumn("content_hash", h)
    known_ns = existing.select(F.col("rvid").alias("ref"), F.col("namespace").alias("ref_ns"), F.lit(0).alias("p")).unionByName(
        rows.groupBy(F.col("rvid").alias("ref")).agg(F.max_by("namespace", "seq").alias("ref_ns")).withColumn("p", F.lit(1))
    ).groupBy("ref").agg(F.min_by("ref_ns", "p").alias("ref_ns"))
    # one narrow boolean per offending row; nothing is collected per record
    crossing = (
        edges.join(known_ns, "ref").join(rows.select("rvid", "seq", "namespace"), "rvid")
        .filter("namespace <> ref_ns").select("rvid", "seq").distinct().withColumn("_x", F.lit(True)))
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c)) == "")
    out = (
        rows.join(existing.select("rvid", F.col("content_hash").alias("_old")), "rvid", "left")
        .join(crossing, ["rvid", "seq"], "left")
        .withColumn("_bad", F.when(blank("rvid") | blank("record_id") | blank("kind"), "missing_required_field")
                    .when(F.col("kind") == "source_chunk", "reserved_record_kind")
                    .when(~F.col("kind").isin(*kinds), "unknown_record_kind")
                    .when(blank("text") & F.col("content_hash").isNull(), "missing_content"))
        .withColumn("_late", F.when(~F.coalesce("status", F.lit("current")).isin(*STATUSES), "invalid_status")
                    .when(F.col("_x"), "cross_namespace_derivation")))
    # the first copy that would be accepted fixes the hash its later copies are compared with; a grouped minimum with
    # map-side combine and a join, so an id repeated very often is not sorted in one task
    firsts = out.filter("_bad IS NULL AND _late IS NULL").groupBy("rvid").agg(
        F.min("seq").alias("_fseq"), F.min_by("content_hash", "seq").alias("_fhash"))
    out = out.join(firsts, "rvid", "left").withColumn(
        "_old", F.coalesce("_old", F.when(F.col("seq") > F.col("_fseq"), F.col("_fhash"))))
    reason = (F.when(F.col("_bad").isNotNull(), F.col("_bad"))
              .when(F.col("_old").isNotNull() & (F.col("_old") != F.col("content_hash")), "record_version_conflict")
              .when(F.col("_old").isNull(), F.col("_late")))
    outcome = (F.when(reason.isNotNull(), "rejected").when(F.col("_old").isNotNull(), "unchanged").otherwise("accepted"))
    return out.withColumn("reason", reason).withColumn("outcome", outcome).drop("_old", "_bad", "_late", "_x", "_fseq", "_fhash")


def ingest_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome", F.coalesce("reason", F.lit("")).alias("reason"), "kind").agg(
        F.count(F.lit(1)).alias("n"))


def import_vectors(vectors: DataFrame, targets: DataFrame, dim: int, space_id: str) -> DataFrame:
    """(target_id, embedding) -> status imported / bad_dimension / unknown_target, keyed by embedding space."""
    known = targets.select("target_id").distinct().withColumn("_k", F.lit(True))
    return vectors.join(known, "target_id", "left").select(
        "target_id", F.lit(space_id).alias("space_id"), "embedding",
        F.when(F.col("_k").isNull(), "unknown_target")
        .when(F.col("embedding").isNull() | (F.size("embedding") != dim), "bad_dimension")
        .otherwise("imported").alias("outcome"))


def list_records(records: DataFrame, kind=None, namespace=None, status=None, path_prefix=None, task_id=None,
                 limit: int | None = None) -> DataFrame:
    """Filtered listing in (kind, record_id, rvid) order; working records show only inside their own task."""
    for column, value in (("kind", kind), ("namespace", namespace), ("status", status)):
        if value is not None:
            records = records.filter(F.col(column) == value)
    if path_prefix is not None:
        records = records.filter(F.col("source_path").startswith(path_prefix))
    if "task_id" in records.columns:
        own = F.lit(False) if task_id is None else F.coalesce(F.col("task_id") == task_id, F.lit(False))
        records = records.filter((F.col("kind") != "working") | own)
    out = records.orderBy("kind", "record_id", "rvid")
    return out if limit is None else out.limit(limit)


def get_records(ids: DataFrame, records: DataFrame, allowed: DataFrame | None, effective: DataFrame | None = None) -> DataFrame:
    """One row per distinct requested id with its outcome: found, unresolved, out_of_scope or not_current.

    ``effective``: (rvid, effective_current); pass it for a current-only fetch. Only found rows keep their record columns.
    """
    out = ids.select("rvid").distinct().join(records.withColumn("_hit", F.lit(True)), "rvid", "left")
    if allowed is not None:
        out = out.join(allowed.select("namespace").distinct().withColumn("_in", F.lit(True)), "namespace", "left")
    else:
        out = out.withColumn("_in", F.lit(True))
    if effective is not None:
        out = out.join(effective.select("rvid", "effective_current"), "rvid", "left")
    else:
        out = out.withColumn("effective_current", F.lit(True))
    outcome = (F.when(F.col("_hit").isNull(), "unresolved").when(F.col("_in").isNull(), "out_of_scope")
               .when(~F.coalesce("effective_current", F.lit(False)), "not_current").otherwise("found"))
    out = out.withColumn("outcome", outcome)
    keep = [c for c in records.columns if c != "rvid"]
    return out.select("rvid", "outcome", *[F.when(F.col("outcome") == "found", F.col(c)).alias(c) for c in keep])
