"""Audit and reporting over ledgers, inventories and entity maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.measures import lcount, lsum, ppm

# Which kinds are bounded retrieval, the start-up bar, the size that calls for re-layering.
BOUNDED_KINDS = ("section", "card", "query")
BOOT_BAR_BYTES, RELAYER_BYTES = 20_000, 40_000


def ledger_summary(ledger: DataFrame, by: list[str], min_fraction_ppm: int) -> DataFrame:
    """Bytes by kind, bounded share of everything and of what is discretionary (start-up bytes left out), oversize whole
    opens, and both gate verdicts."""
    k, b = F.col("kind"), F.col("bytes")
    part = lambda cond: lsum(F.when(cond, b))
    whole, bounded = k == "whole_doc_open", k.isin(*BOUNDED_KINDS)
    g = ledger.groupBy(*by).agg(
        F.count("*").alias("entries"), part(k == "boot_packet").alias("boot_bytes"), part(whole).alias("whole_bytes"), part(bounded).alias("bounded_bytes"),
        lcount(bounded).alias("n_queries"), lcount(whole & (b > RELAYER_BYTES)).alias("oversize_opens"))
    disc = F.col("whole_bytes") + F.col("bounded_bytes")
    total = disc + F.col("boot_bytes")
    share = F.col("bounded_bytes") * 1_000_000
    return g.select(
        *by, "entries", "boot_bytes", "whole_bytes", "bounded_bytes", "n_queries", "oversize_opens", ppm(F.col("bounded_bytes"), total).alias("bounded_fraction"),
        ppm(F.col("bounded_bytes"), disc).alias("discretionary_fraction"), F.when(F.col("boot_bytes") <= BOOT_BAR_BYTES, "pass").otherwise("warn").alias("boot_bar"),
        ((F.col("whole_bytes") > 0) & (F.col("bounded_bytes") == 0)).alias("zero_bounded_gate"),
        ((F.col("bounded_bytes") == 0) | (share < disc * min_fraction_ppm)).alias("fraction_gate"))


def cross_check(ledger: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(finding, key): ledger keys without an artifact (unbacked) and artifacts nobody recorded (unrecorded)."""
    l, a = ledger.select("key").distinct(), artifacts.select("key").distinct()
    return l.join(a, "key", "left_anti").select(F.lit("unbacked").alias("finding"), "key").unionByName(
        a.join(l, "key", "left_anti").select(F.lit("unrecorded").alias("finding"), "key"))


def budget_status(items: DataFrame, budgets: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """items: (item, class, size); budgets: (class, budget; NULL = no cap); overrides: (item, budget). Status ok, warn from 90
    percent, over above 100, nocap, unlisted; ``red`` above 110."""
    j = items.join(budgets.select("class", F.col("budget").alias("_b"), F.lit(True).alias("_known")), "class", "left")
    own = F.lit(None).cast("bigint")
    if overrides is not None:
        j = j.join(overrides.select("item", F.col("budget").alias("_o")), "item", "left")
        own = F.col("_o")
    j = j.withColumn("budget", F.coalesce(own, F.col("_b")).cast("bigint"))
    s = F.col("size") * 100
    status = (F.when(F.col("budget").isNull() & F.col("_known").isNull(), "unlisted").when(F.col("budget").isNull(), "nocap")
              .when(s > F.col("budget") * 100, "over").when(s >= F.col("budget") * 90, "warn").otherwise("ok"))
    return j.select("item", "class", "size", "budget", status.alias("status"), F.coalesce(s > F.col("budget") * 110, F.lit(False)).alias("red"))


def status_pivot(entities: DataFrame, group: str, status: str, known: list[str]) -> DataFrame:
    """Counts per group and known status, everything else under ``other``, so the columns always add up to the total."""
    bucket = F.when(F.col(status).isin(*known), F.col(status)).otherwise("other")
    return entities.groupBy(group).agg(F.count("*").alias("total"), *[lcount(bucket == s).alias(s) for s in [*known, "other"]])


def unit_provenance(planned: DataFrame, tested: DataFrame, changes: DataFrame) -> DataFrame:
    """Union of two rosters with the latest change per unit. planned: (unit, state); tested: (unit, passed); changes:
    (unit, at, change_id). Derived status: planned_only, tested_only, verified, failing."""
    p = planned.groupBy("unit").agg(F.max("state").alias("state"))
    t = tested.groupBy("unit").agg(F.every("passed").alias("passed"))
    c = changes.groupBy("unit").agg(F.max_by("change_id", F.struct("at", "change_id")).alias("last_change"), F.count("*").alias("changes"))
    j = p.join(t, "unit", "full_outer").join(c, "unit", "left")
    return j.select("unit", "state", "passed", "last_change", F.coalesce("changes", F.lit(0)).cast("bigint").alias("changes"),
                    F.when(F.col("passed").isNull(), "planned_only").when(~F.col("passed"), "failing").when(F.col("state").isNull(), "tested_only").otherwise("verified").alias("status"))


def iteration_build(periods: DataFrame, records: DataFrame, members: DataFrame) -> DataFrame:
    """periods: (period, first, last); records: (record_id, at); members: (record_id, member). Per period: records and
    distinct members touched. Periods are consecutive, so records find theirs through a per-day grid, not a theta join."""
    days = periods.select("period", F.explode(F.sequence("first", "last")).alias("at"))
    r = records.join(days, "at")
    m = r.join(members, "record_id", "left")
    return m.groupBy("period").agg(F.count_distinct("record_id").alias("records"), F.count_distinct("member").alias("members"))


def new_since(records: DataFrame, members: DataFrame, day: int) -> DataFrame:
    """Members touched by a record after ``day``, with its first such record."""
    return records.filter(F.col("at") > day).join(members, "record_id").groupBy("member").agg(
        F.min_by("record_id", F.struct("at", "record_id")).alias("first_record"), F.count("*").alias("n"))


def validate_entities(entities: DataFrame, edges: DataFrame, namespaces: list[str], statuses: list[str],
                      edge_domains: dict[str, tuple[str, str]]) -> DataFrame:
    """(code, subject) findings. entities: (id 'ns:key', status, n_sources); edges: (src, type, dst, n_sources).
    ``edge_domains``: type -> (namespace of src, namespace of dst)."""
    ns = lambda c: F.element_at(F.split(c, ":"), 1)
    e, x = entities, edges
    find = lambda df, code, subject: df.select(F.lit(code).alias("code"), subject.alias("subject"))
    label = F.concat_ws(">", "src", "type", "dst")
    ids = e.select("id").distinct()
    known = F.col("type").isin(*edge_domains)
    off = F.lit(False)
    for t, (a, b) in edge_domains.items():
        off = off | ((F.col("type") == t) & ((ns(F.col("src")) != a) | (ns(F.col("dst")) != b)))
    parts = [
        find(e.filter(~F.col("id").rlike(r"^[a-z]+:[A-Za-z0-9#_.\-]+$")), "bad_id", F.col("id")),
        find(e.filter(~ns(F.col("id")).isin(*namespaces)), "unknown_namespace", F.col("id")),
        find(e.filter(~F.col("status").isin(*statuses)), "bad_status", F.col("id")),
        find(e.groupBy("id").count().filter("count > 1"), "duplicate_id", F.col("id")),
        find(e.filter("n_sources = 0"), "missing_provenance", F.col("id")),
        find(x.filter(~known), "unknown_edge_type", label), find(x.filter(off), "edge_domain", label),
        find(x.filter("n_sources = 0"), "edge_without_source", label),
        find(x.join(ids.withColumnRenamed("id", "src"), "src", "left_anti"), "dangling_src", label),
        find(x.join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"), "dangling_dst", label),
        find(x.groupBy("src", "type", "dst").count().filter("count > 1"), "duplicate_edge", label),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
