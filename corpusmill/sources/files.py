"""File sources and sinks: corpus scan, strict JSON-lines ledger with quarantine, sink with manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The ledger's closed vocabulary.
LEDGER_KINDS = ("boot_packet", "section", "card", "query", "whole_doc_open")
LEDGER_KEYS = ("kind", "target", "bytes", "note")


def _glob_to_regex(glob: str) -> str:
    import fnmatch

    return fnmatch.translate(glob).replace("\\z", "\\Z")


def scan_corpus(spark: SparkSession, root: str, include=("*",), exclude_dirs=(), exclude_globs=(),
                max_files: int | None = None) -> DataFrame:
    """(source_path, size, content_hash, content) of every file below root. The cap applies after sorting by path."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/") + "/"
    rel = F.element_at(F.split(F.col("path"), F.lit(r"\Q" + base + r"\E"), 2), -1)
    df = raw.select(rel.alias("source_path"), F.col("length").alias("size"), "content")
    name = F.element_at(F.split("source_path", "/"), -1)
    wanted = F.lit(False)
    for g in include:
        wanted = wanted | name.rlike(_glob_to_regex(g))
    df = df.filter(wanted)
    for d in exclude_dirs:
        df = df.filter(~F.array_contains(F.slice(F.split("source_path", "/"), 1, F.size(F.split("source_path", "/")) - 1), d))
    for g in exclude_globs:
        df = df.filter(~F.col("source_path").rlike(_glob_to_regex(g)))
    if max_files is not None:
        df = df.orderBy("source_path").limit(max_files)
    return df.select("source_path", "size", F.sha2("content", 256).alias("content_hash"), "content")


def folder_rollup(files: DataFrame, max_depth: int, path: str = "source_path", size: str = "size") -> DataFrame:
    """(folder, depth, files, subfolders, bytes) for every folder down to max_depth; '' is the root.

    Files are added up per folder before their totals are copied to the ancestors.
    """
    segs = F.split(F.regexp_replace(F.col(path), "[^/]*$", ""), "/")
    own = files.groupBy(F.slice(segs, F.lit(1), F.size(segs) - 1).alias("_s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(size).cast("bigint")).alias("b"))
    depth = F.least(F.size("_s"), F.lit(max_depth))
    up = own.select("n", "b", "_s", F.explode(F.sequence(F.lit(0), depth)).alias("depth"))
    sums = up.groupBy(F.array_join(F.slice("_s", F.lit(1), F.col("depth")), "/").alias("folder"),
                      F.col("depth").cast("bigint").alias("depth")).agg(F.sum("n").alias("files"), F.sum("b").alias("bytes"))
    # every folder that exists, at any depth, counted once below each of its strict ancestors
    every = own.select("_s", F.explode(F.sequence(F.lit(0), F.size("_s"))).alias("d")).select(
        F.slice("_s", F.lit(1), F.col("d")).alias("f")).distinct().filter(F.size("f") > 0)
    below = every.select("f", F.explode(F.sequence(F.lit(0), F.least(F.size("f") - 1, F.lit(max_depth)))).alias("d")).groupBy(
        F.array_join(F.slice("f", F.lit(1), F.col("d")), "/").alias("folder")).agg(F.count(F.lit(1)).alias("subfolders"))
    return sums.join(below, "folder", "left").select(
        "folder", "depth", "files", F.coalesce("subfolders", F.lit(0)).cast("bigint").alias("subfolders"), "bytes")


def validate_ledger(lines: DataFrame) -> DataFrame:
    """``value`` lines -> kind, target, bytes, note and ``reject_reason`` (first failing rule; NULL when good)."""
    v = F.try_parse_json(F.col("value"))

    def typ(key: str):
        return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))

    keys = F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))
    extra = F.array_except(keys, F.array(*[F.lit(k) for k in LEDGER_KEYS]))
    missing = F.array_except(F.array(F.lit("kind"), F.lit("target"), F.lit("bytes")), keys)
    kind, target = F.try_variant_get(v, "$.kind", "string"), F.try_variant_get(v, "$.target", "string")
    size, note = F.try_variant_get(v, "$.bytes", "bigint"), F.try_variant_get(v, "$.note", "string")
    reason = (
        F.when(v.isNull(), "invalid_json")
        .when(~F.schema_of_variant(v).startswith("OBJECT"), "not_an_object")
        .when(F.size(extra) > 0, "unknown_key")
        .when(F.size(missing) > 0, "missing_key")
        .when((typ("kind") != "STRING") | ~kind.isin(*LEDGER_KINDS), "bad_kind")
        .when((typ("target") != "STRING") | (F.trim(target) == ""), "bad_target")
        .when((typ("bytes") != "BIGINT") | size.isNull() | (size <= 0), "bad_bytes")
        .when(F.array_contains(keys, "note") & ~F.coalesce(typ("note"), F.lit("VOID")).isin("STRING", "VOID"), "bad_note")
    )
    return lines.filter(F.trim("value") != "").select(
        "value", kind.alias("kind"), target.alias("target"), size.alias("bytes"), note.alias("note"),
        reason.alias("reject_reason"))


def read_ledger(spark: SparkSession, path: str, fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines with a reason). ``fail_fast`` aborts the job at a bad line instead."""
    checked = validate_ledger(spark.read.text(path))
    good = checked.filter("reject_reason IS NULL").select("kind", "target", "bytes", "note")
    if fail_fast:
        kind = F.when(F.col("reject_reason").isNotNull(), F.raise_error(
            F.concat(F.lit("bad ledger line: "), "reject_reason"))).otherwise(F.col("kind"))
        good = checked.select(kind.alias("kind"), "target", "bytes", "note")
    return good, checked.filter("reject_reason IS NOT NULL").select("value", "reject_reason")


def corpus_digest(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row (rows, digest): a fingerprint of the row multiset, independent of order and partitioning.

    Every row hash is split into four 60-bit lanes that are added up, so the whole table is reduced by plain partial
    sums: constant memory per task, and one tiny final row.
    """
    h = F.sha2(F.concat_ws("\u0000", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0001")) for k in keys]), 256)
    lanes = [F.conv(F.substring(h, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    agg = df.select(*[x.alias(f"l{i}") for i, x in enumerate(lanes)]).agg(
        F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(f"l{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}") for i in range(4)])
    return agg.select("rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *[
        F.col(f"s{i}").cast("string") for i in range(4)]), 256).alias("digest"))


def write_with_manifest(df: DataFrame, path: str, manifest: str, keys: list[str], partition_by=(), kind: str | None = None,
                        fmt: str = "parquet") -> DataFrame:
    """Write ``df`` and append (path, kind, rows, digest) rows per kind to the manifest; returns those rows.

    The manifest is computed from what was written, not from a second run of the plan.
    """
    spark = df.sparkSession
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
    back = spark.read.format(fmt).load(path) if fmt == "parquet" else spark.read.schema(df.schema).format(fmt).load(path)
    counts = back.groupBy((F.col(kind) if kind else F.lit("all")).cast("string").alias("kind")).agg(F.count(F.lit(1)).alias("rows"))
    rows = counts.join(corpus_digest(back, keys).select("digest"), how="inner", on=F.lit(True)).select(
        F.lit(path).alias("path"), "kind", "rows", "digest")
    rows.write.mode("append").parquet(manifest)
    return spark.read.parquet(manifest).filter(F.col("path") == path)
