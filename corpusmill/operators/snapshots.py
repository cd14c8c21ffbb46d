"""Snapshot comparison, version serving, staleness and text-declared supersession. One join per question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.numbering import number_rows


def diff_snapshots(prev: DataFrame, curr: DataFrame, keys=("namespace", "source_path")) -> DataFrame:
    """added / changed / unchanged / deleted per key. ``prev`` may hold tombstones (serving = deleted or unparsed).

    Unchanged needs the same content AND the same chunker, and a previous version that is not a stale fallback.
    """
    k = list(keys)
    p = prev.select(*k, F.col("content_hash").alias("prev_hash"), F.col("chunker").alias("prev_chunker"), F.col("serving").alias("prev_serving"))
    c = curr.select(*k, F.col("content_hash").alias("curr_hash"), F.col("chunker").alias("curr_chunker"))
    j = p.join(c, k, "full_outer")
    alive = F.col("prev_hash").isNotNull() & ~F.col("prev_serving").isin("deleted", "unparsed")
    same = (F.col("prev_hash") == F.col("curr_hash")) & (F.col("prev_chunker") == F.col("curr_chunker")) & (
        F.col("prev_serving") != "stale_fallback")
    change = (F.when(F.col("curr_hash").isNull(), F.when(F.col("prev_serving") != "deleted", "deleted"))
              .when(~alive, "added").when(same, "unchanged").otherwise("changed"))
    return j.withColumn("change", change).filter("change IS NOT NULL").select(*k, "change", "prev_hash", "curr_hash")


def detect_moves(diff: DataFrame) -> DataFrame:
    """One-to-one pairs of a deleted and an added path with equal content, in path order on both sides.

    Copies of one text can be numerous, so the n-th deleted meets the n-th added by number: an equi-join on
    (hash, n), never a product of all copies.
    """
    key = ["namespace", "content_hash"]
    gone = diff.filter("change = 'deleted'").select("namespace", F.col("prev_hash").alias("content_hash"), "source_path")
    come = diff.filter("change = 'added'").select("namespace", F.col("curr_hash").alias("content_hash"), "source_path")
    # only hashes found on both sides can pair up
    gone_both = gone.join(come.select(*key).distinct(), key, "left_semi")
    come_both = come.join(gone.select(*key).distinct(), key, "left_semi")
    left = number_rows(gone_both, key, ["source_path"], "n").withColumnRenamed("source_path", "from_path")
    right = number_rows(come_both, key, ["source_path"], "n").withColumnRenamed("source_path", "to_path")
    return left.join(right, [*key, "n"]).select(*key, "from_path", "to_path")


def serve_versions(versions: DataFrame) -> DataFrame:
    """(document_id, version_id, observed_at, parse_status) -> what each document serves now.

    A failed newest version falls back to the last good one, flagged; a document without any good version is unparsed.
    """
    at = F.struct("observed_at", "version_id")
    ok = F.col("parse_status") == "ok"
    g = versions.groupBy("document_id").agg(
        F.max_by("version_id", at).alias("latest_version_id"),
        F.max_by("version_id", F.when(ok, at)).alias("current_version_id"))
    return g.withColumn(
        "serving_status",
        F.when(F.col("current_version_id").isNull(), "unparsed")
        .when(F.col("current_version_id") == F.col("latest_version_id"), "active").otherwise("stale_fallback"))


def purge_derived(derived: DataFrame, gone_versions: DataFrame, key: str = "version_id") -> DataFrame:
    """Derived rows that survive: their version is neither deleted nor replaced."""
    return derived.join(gone_versions.select(key).distinct(), key, "left_anti")


def mark_stale(records: DataFrame, versions: DataFrame) -> DataFrame:
    """Current records whose source version is known and no longer current become source_stale."""
    v = versions.groupBy(F.col("version_id").alias("source_version_id")).agg(F.bool_or("is_current").alias("_cur"))
    return records.join(v, "source_version_id", "left").withColumn(
        "status", F.when((F.col("status") == "current") & (~F.col("_cur")), "source_stale").otherwise(F.col("status"))
    ).drop("_cur")


def source_drift(entities: DataFrame, inventory: DataFrame, budget_percent: int = 20) -> tuple[DataFrame, DataFrame]:
    """entities: (entity_id, sources array<struct<ref, sha256>>); inventory: (source_path, content_hash).

    Returns per-entity (n_sources, missing, drifted, state) and one summary row with the stale share and a breach flag.
    """
    refs = entities.select("entity_id", F.explode_outer("sources").alias("s")).select(
        "entity_id", F.regexp_replace("s.ref", "#.*$", "").alias("source_path"), F.col("s.sha256").alias("sha"))
    inv = inventory.select("source_path", F.col("content_hash").alias("now"))
    seen = refs.join(inv, "source_path", "left")
    per = seen.groupBy("entity_id").agg(
        F.count("source_path").alias("n_sources"),
        F.count_if(F.col("source_path").isNotNull() & F.col("now").isNull()).cast("bigint").alias("missing"),
        F.count_if(F.col("now") != F.col("sha")).cast("bigint").alias("drifted"))
    per = per.withColumn("state", F.when(F.col("missing") > 0, "unbacked").when(F.col("drifted") > 0, "stale").otherwise("fresh"))
    bad = F.count_if(F.col("state") != "fresh").cast("bigint")
    total = F.count(F.lit(1))
    summary = per.agg(total.alias("entities"), bad.alias("stale"), (bad * 100 > total * budget_percent).alias("breach"))
    return per, summary


def touched_by(entities: DataFrame, paths: DataFrame) -> DataFrame:
    """Entities any of whose source refs (anchor stripped) is among the changed paths."""
    refs = entities.select("entity_id", F.explode("sources").alias("s")).select(
        "entity_id", F.regexp_replace("s.ref", "#.*$", "").alias("source_path"))
    return refs.join(paths.select("source_path").distinct(), "source_path", "left_semi").select("entity_id").distinct()


def run_summary(diff: DataFrame, moves: DataFrame, by: str = "namespace") -> DataFrame:
    """Per source: seen, added, changed, unchanged, deleted, moved."""
    n = lambda v: F.count_if(F.col("change") == v).cast("bigint").alias(v)
    counts = diff.groupBy(by).agg(
        F.count_if(F.col("change") != "deleted").cast("bigint").alias("seen"), n("added"), n("changed"), n("unchanged"), n("deleted"))
    m = moves.groupBy(by).agg(F.count(F.lit(1)).alias("moved"))
    return counts.join(m, by, "left").fillna(0, ["moved"])


def derive_supersession(notes: DataFrame, refs: DataFrame, index_rows: DataFrame) -> DataFrame:
    """Declared "A supersedes B" inverted to B's successors; the edge, not the index cell, decides the status.

    notes: (note_id); refs: (note_id, ref_id); index_rows: (note_id, state_raw, superseded_by). Unknown targets and
    self-references make no edge.
    """
    known = notes.select("note_id").distinct()
    body = refs.filter("note_id <> ref_id").select(F.col("ref_id").alias("target"), F.col("note_id").alias("successor"))
    index = index_rows.filter("superseded_by IS NOT NULL").select(F.col("note_id").alias("target"), F.col("superseded_by").alias("successor"))
    edges = body.unionByName(index).distinct().join(known.withColumnRenamed("note_id", "target"), "target", "left_semi")
    succ = edges.groupBy(F.col("target").alias("note_id")).agg(
        F.count(F.lit(1)).alias("n_successors"), F.min("successor").alias("first_successor"))
    state = index_rows.groupBy("note_id").agg(F.min(F.lower("state_raw")).alias("cell"))
    j = known.join(succ, "note_id", "left").join(state, "note_id", "left")
    edge, cell = F.col("n_successors").isNotNull(), F.coalesce("cell", F.lit(""))
    said = cell.startswith("superseded") | cell.startswith("folded")
    return j.select(
        "note_id", F.coalesce("n_successors", F.lit(0)).cast("bigint").alias("n_successors"), "first_successor",
        F.when(edge | cell.startswith("superseded"), "superseded").when(cell.startswith("folded"), "folded")
        .when(cell.startswith("closed"), "closed").otherwise("current").alias("status"),
        F.when(F.col("cell").isNull(), "no_index_row").when(edge & ~said, "edge_without_annotation")
        .when(~edge & said, "annotation_without_target").alias("disagreement"))


# How a note says that it replaces others in full (the stretch up to a stop, at most 80 characters), or in part.
FULL_CUES = (r"(?is)\bsupersedes?\b(.{0,80}?)(?:[.,;\n]|$)", r"(?is)\breplaces?\b(.{0,80}?)(?:[.,;\n]|$)")
PART_CUE = r"(?is)\b(?:revises?|refines?|amend(?:s|ed)?|RE-FROZEN|reconciles?|folds? the .*? into)\b.{0,80}?(D-[0-9]{4})"


def supersession_relations(notes: DataFrame, index_rows: DataFrame) -> DataFrame:
    """Typed relation (successor, relation, target, said_in) of what notes and the index declare.

    notes: (note_id, text); index_rows: (note_id, superseded_by, folded_by). ``supersedes``: a full successor, said in the
    successor's text or at the target's index row; ``folds``: the target went into it (index only); ``revises``: replaced in
    part, read only in notes without a full target; ``unresolved``: a full cue names an unknown note or the note itself. Rows
    are distinct; a partial cue that names no other known note says nothing. NULL texts say nothing.
    """
    known = notes.select(F.col("note_id").alias("target")).distinct().withColumn("_known", F.lit(True))
    spans = F.concat(*[F.regexp_extract_all(F.col("text"), F.lit(c), F.lit(1)) for c in FULL_CUES])
    tokens = notes.filter("text IS NOT NULL").select("note_id", F.explode(spans).alias("_s")).select("note_id", F.explode(
        F.regexp_extract_all("_s", F.lit(r"D-[0-9]{4}(?:/[0-9]{2}(?![0-9]))*"), F.lit(0))).alias("_t"))
    first = F.substring("_t", 1, 6)
    short = F.transform(F.regexp_extract_all("_t", F.lit("/([0-9]{2})"), F.lit(1)), lambda s: F.concat(F.substring("_t", 1, 4), s))
    named = tokens.select("note_id", F.explode(F.concat(F.array(first), short)).alias("target")).distinct()
    judged = named.join(known, "target", "left").select(
        F.col("note_id").alias("successor"),
        F.when(F.col("_known") & (F.col("target") != F.col("note_id")), "supersedes").otherwise("unresolved").alias("relation"), "target", F.lit("text").alias("said_in"))
    part = notes.filter("text IS NOT NULL").select(F.col("note_id").alias("successor"), F.explode(F.regexp_extract_all("text", F.lit(PART_CUE), F.lit(1))).alias("target")).distinct()
    part = part.filter("successor <> target").join(known, "target", "left_semi").join(
        judged.filter("relation = 'supersedes'").select("successor"), "successor", "left_anti")
    edge = lambda by, name: index_rows.filter(F.col(by).isNotNull()).select(
        F.col(by).alias("successor"), F.lit(name).alias("relation"), F.col("note_id").alias("target"), F.lit("index").alias("said_in")).distinct()
    return (judged.unionByName(part.select("successor", F.lit("revises").alias("relation"), "target", F.lit("text").alias("said_in")))
            .unionByName(edge("superseded_by", "supersedes")).unionByName(edge("folded_by", "folds")))


def relation_status(notes: DataFrame, relations: DataFrame, index_rows: DataFrame) -> DataFrame:
    """(note_id, superseded_by, folded_into, revised_by, unresolved, status): how many of each, and the status they force. An edge
    decides; where there is none the index row's word (``state_raw``) does."""
    n = lambda name: F.count_if(F.col("relation") == name).cast("bigint").alias(name)
    onto = relations.filter("relation <> 'unresolved'").groupBy(F.col("target").alias("note_id")).agg(n("supersedes"), n("folds"), n("revises"))
    lost = relations.filter("relation = 'unresolved'").groupBy(F.col("successor").alias("note_id")).agg(F.countDistinct("target").alias("unresolved"))
    cell = index_rows.groupBy("note_id").agg(F.min(F.lower("state_raw")).alias("_cell"))
    j = notes.select("note_id").distinct().join(onto, "note_id", "left").join(lost, "note_id", "left").fillna(0).join(cell, "note_id", "left")
    word = F.coalesce("_cell", F.lit(""))
    status = F.when(F.col("supersedes") > 0, "superseded").when(F.col("folds") > 0, "folded")
    for w in ("superseded", "folded", "closed"):
        status = status.when(word.startswith(w), w)
    return j.select("note_id", F.col("supersedes").alias("superseded_by"), F.col("folds").alias("folded_into"), F.col("revises").alias("revised_by"),
                    "unresolved", status.otherwise("current").alias("status"))
