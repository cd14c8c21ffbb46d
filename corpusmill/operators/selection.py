"""Rank fusion and evidence selection. Every step works on (query_id, rvid, ...) candidate tables for all queries at once.

Candidate pools come out of top-k searches, so a query's group never holds more than its search depth; steps that need
a sequential walk fold over that bounded group, everything else is windows and joins.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.measures import PPM, rrf_term
from corpusmill.session import cut_lineage
from corpusmill.sources.records import STALE_STATUSES

# Feature weights, penalties, authority ranks, kinds that suit a task stage.
WEIGHTS = {"relevance": 1, "authority": 3 * PPM, "freshness": 6 * PPM, "project": 2 * PPM, "component": 2 * PPM,
           "task_stage": 2 * PPM, "failure": 2 * PPM, "procedural": 2 * PPM}
HARD_DEMOTE, STALE_PENALTY, DIVERSITY_PENALTY = 1000 * PPM, 20 * PPM, 8 * PPM
AUTHORITY_RANK = {"authoritative": 4, "governing": 4, "curated": 3, "source_material": 2, "derived": 1}
STAGE_KINDS = {"implement": ("procedure", "source_chunk"), "act": ("procedure",), "debug": ("failure", "source_chunk"),
               "plan": ("decision", "summary"), "research": ("summary", "source_chunk", "claim")}
ITEM_OVERHEAD = 12
STANDING_SCOPES = ("standing_prohibition", "invariant")
TERMINAL_STATUSES = ("superseded", "folded", "closed")


def rrf(occurrences: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, rvid, channel, rank) -> (query_id, rvid, rrf_score, channels). Any set of channels."""
    return occurrences.groupBy("query_id", "rvid").agg(
        F.sum(rrf_term(F.col("rank"), k)).alias("rrf_score"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"))


def fuse(occurrences: DataFrame, k: int = 60, depth: int | None = None) -> DataFrame:
    """Fused ranking: RRF score, ties by record id."""
    w = W.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc("rvid"))
    out = rrf(occurrences, k).withColumn("fused_rank", F.row_number().over(w).cast("bigint"))
    return out if depth is None else out.filter(F.col("fused_rank") <= depth)


def _rank_of(values: dict[str, int], c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c), F.lit(0))


def freshness(status: Column) -> Column:
    return (F.when(status.isNull(), 2).when(status == "current", 3).when(status.isin("deleted", "unverified"), 0)
            .when(status.isin(*STALE_STATUSES), 1).otherwise(2))


def hard_filter(cands: DataFrame, rules: DataFrame | None = None, stale: DataFrame | None = None,
                required: DataFrame | None = None) -> DataFrame:
    """Adds hard_reason (first rule by priority, else deleted), is_stale.

    rules: (query_id, source_path, content_hash?, reason, priority); stale: (query_id, source_path, content_hash?);
    required: (query_id, source_path, content_hash): a hit of that path in another version is stale. A NULL hash matches
    every version. Rules are reduced per candidate before they are joined back, so no candidate is multiplied.
    """
    key = ["query_id", "source_path", "content_hash"]
    cand_keys = cands.select(*key).distinct()

    def matched(m: DataFrame, agg: Column) -> DataFrame:
        m = m.withColumnRenamed("content_hash", "_h")
        return cand_keys.join(m, ["query_id", "source_path"]).filter("_h IS NULL OR _h = content_hash").groupBy(*key).agg(agg)

    out = cands
    reason = F.lit(None).cast("string")
    if rules is not None:
        out = out.join(matched(rules, F.min_by("reason", "priority").alias("_rule")), key, "left")
        reason = F.col("_rule")
    out = out.withColumn("hard_reason", F.coalesce(reason, F.when(F.col("status") == "deleted", "deleted")))
    flag = F.coalesce(F.col("status").isin(*STALE_STATUSES), F.lit(False))
    if stale is not None:
        out = out.join(matched(stale, F.lit(True).alias("_stale")), key, "left")
        flag = flag | F.coalesce("_stale", F.lit(False))
    if required is not None:
        req = required.withColumnRenamed("content_hash", "_h")
        other = cand_keys.join(req, ["query_id", "source_path"]).filter("_h IS NOT NULL AND _h <> content_hash").select(*key).distinct()
        out = out.join(other.withColumn("_other", F.lit(True)), key, "left")
        flag = flag | F.coalesce("_other", F.lit(False))
    return out.withColumn("is_stale", flag).drop("_rule", "_stale", "_other")


def score_candidates(cands: DataFrame, scoped: bool = False) -> DataFrame:
    """Adds base_score, not_current, hard and reason_codes.

    cands: relevance (millionths), authority_level, status, kind, namespace, source_path, hard_reason, is_stale, optional
    effective_current, plus the query's descriptor columns q_namespace, q_components (array), q_stage, q_failures,
    q_mode. With ``scoped`` the soft bonus for the query's namespace is off, because the hard scope already did it.
    """
    c = set(cands.columns)
    col = lambda name, default: F.col(name) if name in c else default
    one = lambda cond: F.coalesce(cond, F.lit(False)).cast("bigint")
    stage, kind = col("q_stage", F.lit(None).cast("string")), F.col("kind")
    suits = F.lit(False)
    for name, kinds in STAGE_KINDS.items():
        suits = suits | ((stage == name) & kind.isin(*kinds))
    features = {
        "relevance": F.col("relevance").cast("bigint"), "authority": _rank_of(AUTHORITY_RANK, F.col("authority_level")),
        "freshness": freshness(F.col("status")),
        "project": F.lit(0) if scoped or "q_namespace" not in c else one(F.col("namespace") == F.col("q_namespace")),
        "component": one(F.exists("q_components", lambda p: F.col("source_path").startswith(p))) if "q_components" in c else F.lit(0),
        "task_stage": one(suits), "failure": one(col("q_failures", F.lit(False)) & (kind == "failure")),
        "procedural": one(stage.isin("act", "implement") & (kind == "procedure")),
    }
    base = F.lit(0).cast("bigint")
    for name, value in features.items():
        base = base + F.lit(WEIGHTS[name]).cast("bigint") * value.cast("bigint")
    mode = col("q_mode", F.lit("any"))
    stale_here = F.coalesce(~F.col("effective_current"), F.col("is_stale")) if "effective_current" in c else F.col("is_stale")
    gone = F.col("hard_reason").isNotNull()
    current_only = (mode == "current_only") & stale_here
    prefer = (mode == "prefer_current") & stale_here
    hard = gone | current_only
    base = base - F.when(hard, F.lit(HARD_DEMOTE)).otherwise(0).cast("bigint") - F.when(prefer, F.lit(STALE_PENALTY)).otherwise(0).cast("bigint")
    codes = F.array_compact(F.array(
        F.when(gone, F.concat(F.lit("hard_filter_"), "hard_reason")), F.when(current_only, F.lit("hard_filter_stale")),
        F.when(prefer, F.lit("stale_demote")), F.when(_rank_of(AUTHORITY_RANK, F.col("authority_level")) > 0, F.lit("authority_boost")),
        F.lit("fusion_rrf")))
    return cands.withColumn("base_score", base).withColumn("not_current", stale_here).withColumn("hard", hard).withColumn("reason_codes", codes)


def diversify(scored: DataFrame, penalty: int = DIVERSITY_PENALTY) -> DataFrame:
    """Adds effective_score and position: the greedy order with ``penalty`` per earlier pick of the same source.

    Closed form of the greedy loop: inside a source the picks come in base order, so the j-th one pays (j-1) penalties.
    """
    src = W.partitionBy("query_id", "source_path").orderBy(F.desc("base_score"), F.asc("rank"))
    eff = F.col("base_score") - F.lit(penalty).cast("bigint") * (F.row_number().over(src) - 1)
    out = scored.withColumn("effective_score", eff)
    w = W.partitionBy("query_id").orderBy(F.desc("effective_score"), F.asc("rank"))
    return out.withColumn("position", F.row_number().over(w).cast("bigint"))


def _successors_first(pdf: pd.DataFrame) -> pd.DataFrame:
    """One query's pool: smallest free position next, a record only after all its successors in the pool."""
    place = dict(zip(pdf["rvid"], pdf["position"]))
    waits: dict[int, set[int]] = {p: set() for p in place.values()}
    for rvid, pos, succ in zip(pdf["rvid"], pdf["position"], pdf["successors"]):
        if succ is not None:
            waits[pos] = {place[s] for s in succ if s in place and s != rvid}
    releases: dict[int, list[int]] = {}
    for pos, before in waits.items():
        for b in before:
            releases.setdefault(b, []).append(pos)
    open_count = {p: len(b) for p, b in waits.items()}
    free = [p for p, n in open_count.items() if n == 0]
    heapq.heapify(free)
    order: list[int] = []
    while free:
        p = heapq.heappop(free)
        order.append(p)
        for q in releases.get(p, ()):
            open_count[q] -= 1
            if open_count[q] == 0:
                heapq.heappush(free, q)
    order += sorted(set(open_count) - set(order))
    new = {p: i for i, p in enumerate(order, 1)}
    return pd.DataFrame({"query_id": pdf["query_id"], "rvid": pdf["rvid"], "new_position": pdf["position"].map(new),
                         "demoted": pdf["position"].map(lambda p: bool(waits[p]))})


def reorder_superseded(ordered: DataFrame, edges: DataFrame) -> DataFrame:
    """Live successors before what they supersede; otherwise the given positions; cycles last, in base order.

    ordered: (query_id, rvid, position, hard, ...); edges: (src, dst), src supersedes dst. Hard-filtered rows neither
    push nor move relative to the rest of the walk. Only queries that contain such a pair go through the grouped walk.
    """
    ordered = cut_lineage(ordered)
    pool = ordered.filter(~F.col("hard")).select("query_id", "rvid")
    inside = (edges.select("src", "dst").distinct().filter("src <> dst")
              .join(pool.withColumnRenamed("rvid", "dst"), "dst")
              .join(pool.select(F.col("query_id").alias("_q"), F.col("rvid").alias("_s")), (F.col("src") == F.col("_s")) & (F.col("query_id") == F.col("_q"))))
    succ = inside.groupBy("query_id", F.col("dst").alias("rvid")).agg(F.array_sort(F.collect_list("src")).alias("successors"))
    key = dict(ordered.dtypes)
    touched = ordered.select("query_id", "rvid", "position").join(succ.select("query_id").distinct(), "query_id", "left_semi").join(
        succ, ["query_id", "rvid"], "left")
    moved = touched.groupBy("query_id").applyInPandas(
        _successors_first, f"query_id {key['query_id']}, rvid {key['rvid']}, new_position bigint, demoted boolean")
    out = ordered.join(moved, ["query_id", "rvid"], "left")
    return out.withColumn("position", F.coalesce("new_position", "position")).withColumn(
        "superseded_demote", F.coalesce("demoted", F.lit(False))).drop("new_position", "demoted")


def display_key(chunk_hash: Column, path: Column, start: Column, end: Column, label: Column) -> Column:
    """What makes two hits the same text: chunk hash, else path and span, else path and label."""
    return (F.when(F.coalesce(chunk_hash, F.lit("")) != "", F.concat(F.lit("cch\u0000"), chunk_hash))
            .when(start.isNotNull() & end.isNotNull(), F.concat_ws("\u0000", F.lit("sp"), path, start.cast("string"), end.cast("string")))
            .otherwise(F.concat_ws("\u0000", F.lit("pl"), path, F.coalesce(label, F.lit("")))))


def collapse_duplicates(ordered: DataFrame, key: Column) -> DataFrame:
    """Adds cluster_id, cluster_head, cluster_size, cluster_rrf and, on heads, the members in order. Nothing is dropped."""
    df = ordered.withColumn("_k", key)
    w = W.partitionBy("query_id", "_k")
    n = F.row_number().over(w.orderBy("position"))
    members = F.transform(F.array_sort(F.collect_list(F.struct("position", "rvid")).over(w)), lambda m: m["rvid"])
    return (df.withColumn("cluster_id", F.concat(F.lit("ec_"), F.substring(F.sha2("_k", 256), 1, 16)))
            .withColumn("cluster_head", n == 1).withColumn("cluster_size", F.count("*").over(w))
            .withColumn("cluster_rrf", F.sum("rrf_score").over(w))
            .withColumn("members", F.when(F.col("cluster_head"), members)).drop("_k"))


def select_within_budget(ordered: DataFrame, token_budget: int = 2000, max_items: int = 40, per_source: int = 3,
                         overhead: int = ITEM_OVERHEAD) -> DataFrame:
    """Walk each query's pool in order and give every row an outcome; a row that does not fit is skipped, not a stop.

    ordered: (query_id, rvid, position, source_path, tokens, blocked) where ``blocked`` is NULL or the reason of an
    earlier stage. Outcome is 'selected', that reason, or source_diversity_cap / max_excerpts / token_budget, tested in
    this order; only selected rows count towards the caps. One native fold over the query's (search-depth bounded) array.
    """
    row = F.struct("position", "rvid", "source_path", F.col("tokens").cast("bigint").alias("tokens"), "blocked")
    packed = ordered.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).cast("bigint").alias("kept"),
                     F.array().cast("array<string>").alias("sources"), F.array().cast("array<string>").alias("outcomes"))

    def step(acc: Column, r: Column) -> Column:
        cost = r["tokens"] + overhead
        mine = F.size(F.filter(acc["sources"], lambda s: s == r["source_path"]))
        outcome = (F.when(r["blocked"].isNotNull(), r["blocked"]).when(mine >= per_source, "source_diversity_cap")
                   .when(acc["kept"] >= max_items, "max_excerpts").when(acc["used"] + cost > token_budget, "token_budget").otherwise("selected"))
        ok = outcome == "selected"
        return F.struct(
            (acc["used"] + F.when(ok, cost).otherwise(F.lit(0).cast("bigint"))).alias("used"),
            (acc["kept"] + F.when(ok, 1).otherwise(0)).cast("bigint").alias("kept"),
            F.when(ok, F.array_append(acc["sources"], r["source_path"])).otherwise(acc["sources"]).alias("sources"),
            F.array_append(acc["outcomes"], outcome).alias("outcomes"))

    folded = packed.withColumn("_f", F.aggregate("_rows", start, step))
    out = folded.select("query_id", F.inline(F.zip_with("_rows", F.col("_f.outcomes"), lambda r, o: F.struct(
        r["position"].alias("position"), r["rvid"].alias("rvid"), o.alias("outcome")))))
    return ordered.join(out, ["query_id", "position", "rvid"])


def budget_accounting(outcomes: DataFrame, token_budget: int = 2000, overhead: int = ITEM_OVERHEAD) -> DataFrame:
    """Per query: used, remaining, excerpts, body and overhead tokens, omitted, whether the budget cut something."""
    sel = F.col("outcome") == "selected"
    body = F.sum(F.when(sel, F.col("tokens")).otherwise(0)).cast("bigint")
    n = F.count_if(sel).cast("bigint")
    return outcomes.groupBy("query_id").agg(
        (body + n * overhead).alias("used"), (F.lit(token_budget) - body - n * overhead).cast("bigint").alias("remaining"),
        n.alias("excerpts"), body.alias("body_tokens"), F.count_if(~sel).cast("bigint").alias("omitted"),
        F.bool_or(F.col("outcome").isin("token_budget", "max_excerpts")).alias("truncated"))


def expand_prefix(cands: DataFrame, max_tokens: int) -> DataFrame:
    """(query_id, rank, rvid, text) in rank order until the first one that does not fit; a first one that is alone too
    big is cut to the budget. Adds text_out, tokens and truncated."""
    w = W.partitionBy("query_id").orderBy("rank", "rvid")
    tok = F.ceil(F.length("text") / F.lit(4)).cast("bigint")
    df = cands.withColumn("tokens", tok).withColumn("_cum", F.sum("tokens").over(w)).withColumn("_n", F.row_number().over(w))
    # token counts are not negative, so the running sum crosses the limit once; what follows a cut head is never taken
    fit = (F.col("_cum") <= max_tokens) | (F.col("_n") == 1)
    cut = (F.col("_n") == 1) & (F.col("tokens") > max_tokens)
    out = df.filter(fit).withColumn("truncated", cut).withColumn(
        "text_out", F.when(cut, F.substring("text", 1, 4 * max_tokens)).otherwise(F.col("text")))
    return out.withColumn("tokens", F.ceil(F.length("text_out") / F.lit(4)).cast("bigint")).drop("_cum", "_n")


def fit_window(selected: DataFrame, frame_chars: int, max_context: int, reserves: int) -> DataFrame:
    """(query_id, position, chars): keep the longest prefix whose rendered size fits; later rows are transport_overflow.

    A frame that alone is too big keeps nothing and is flagged.
    """
    w = W.partitionBy("query_id").orderBy("position")
    room = max_context - reserves
    fits = F.ceil((F.sum("chars").over(w) + frame_chars) / F.lit(4)) <= room
    over = -(-frame_chars // 4) > room
    return selected.withColumn("fit", F.when(fits, "kept").otherwise("transport_overflow")).withColumn("frame_overflow", F.lit(over))


def coverage(requirements: DataFrame, selected: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, req_id, type, satisfied, satisfied_by, expandable).

    requirements: (query_id, req_id, type path|literal|record|any_evidence, value); selected and pool: (query_id, rvid,
    record_id, source_path, text). A requirement meets only the candidates of its own query.
    """
    def matches(side: DataFrame) -> DataFrame:
        v, low = F.col("value"), F.lower(F.col("value"))
        path = F.regexp_replace(v, "/+$", "")
        hay = F.lower(F.concat_ws(" ", "text", "source_path", "record_id"))
        ok = (F.when(F.col("type") == "any_evidence", True)
              .when(F.col("type") == "path", (path != "") & F.col("source_path").startswith(path))
              .when(F.col("type") == "literal", (v != "") & F.contains(hay, low))
              .when(F.col("type") == "record", (F.col("rvid") == v) | (F.col("record_id") == v)).otherwise(False))
        return requirements.join(side, "query_id").filter(ok)

    by = matches(selected).groupBy("query_id", "req_id").agg(F.array_join(F.array_sort(F.collect_set("rvid")), ",").alias("satisfied_by"))
    reach = matches(pool).select("query_id", "req_id").distinct().withColumn("_e", F.lit(True))
    return requirements.join(by, ["query_id", "req_id"], "left").join(reach, ["query_id", "req_id"], "left").select(
        "query_id", "req_id", "type", F.col("satisfied_by").isNotNull().alias("satisfied"), "satisfied_by",
        F.when(F.col("satisfied_by").isNull(), F.coalesce("_e", F.lit(False))).alias("expandable"))


def disposition(queries: DataFrame, covered: DataFrame, flags: DataFrame) -> DataFrame:
    """(query_id, disposition): provenance_failed > conflicted > needs_expansion (all missing expandable) > abstain > answerable.

    flags: (query_id, provenance_failed, conflicted); absent rows mean neither.
    """
    miss = covered.groupBy("query_id").agg(
        F.count_if(~F.col("satisfied")).alias("missing"), F.count_if(~F.col("satisfied") & ~F.col("expandable")).alias("lost"))
    j = queries.select("query_id").join(miss, "query_id", "left").join(flags, "query_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    return j.select("query_id", F.when(f("provenance_failed"), "provenance_failed").when(f("conflicted"), "conflicted")
                    .when((n("missing") > 0) & (n("lost") == 0), "needs_expansion").when(n("missing") > 0, "abstain")
                    .otherwise("answerable").alias("disposition"))


def in_force() -> Column:
    """A terminal status counts only with a full supersession edge behind it."""
    return ~(F.col("status").isin(*TERMINAL_STATUSES) & (F.size(F.coalesce("superseded_by", F.array().cast("array<string>"))) > 0))


def standing_view(decisions: DataFrame, budget_categories: int | None = None) -> DataFrame:
    """(category, members, hot, enforced, pinned, asserted_count): standing records in force, counted over all of them;
    categories past the budget spill (pinned = false) but stay listed.

    The categories (planes or modules) are numbered by a window over the grouped counts, not over the records.
    """
    cat = F.coalesce(F.try_element_at("planes", F.lit(1)), F.try_element_at("affected_modules", F.lit(1)), F.lit("uncategorized"))
    enforced = ~F.lower(F.trim(F.coalesce("enforced_by", F.lit("none")))).isin("", "none")
    g = decisions.filter(F.col("binding_scope").isin(*STANDING_SCOPES) & in_force()).groupBy(cat.alias("category")).agg(
        F.count("*").alias("members"), F.count_if(~enforced).cast("bigint").alias("hot"), F.count_if(enforced).cast("bigint").alias("enforced"))
    total = g.agg(F.sum("members").alias("asserted_count"))
    before = g.select(F.col("category").alias("_c"))
    if budget_categories is None:
        return g.withColumn("pinned", F.lit(True)).join(total, on=F.lit(True))
    first = before.orderBy("_c").limit(budget_categories).withColumn("_p", F.lit(True))
    return g.join(first, F.col("category") == F.col("_c"), "left").withColumn("pinned", F.coalesce("_p", F.lit(False))).drop(
        "_c", "_p").join(total, on=F.lit(True))


def relevant_decisions(decisions: DataFrame, modules: list[str], planes: list[str], top_k: int, ordinary_cap: int = 256,
                       head: str | None = None) -> DataFrame:
    """The ordinary decisions in force that touch the modules or planes, among the newest ``ordinary_cap``; top k by
    authority, then id, each with its currentness against ``head``."""
    ordinary = decisions.filter(~F.col("binding_scope").isin(*STANDING_SCOPES) & (F.col("status") == "current"))
    newest = ordinary.orderBy(F.desc_nulls_last("date"), F.desc_nulls_last("iteration"), F.desc("decision_id")).limit(ordinary_cap)
    touch = F.lit(not modules and not planes)
    if modules:
        touch = touch | F.arrays_overlap("affected_modules", F.array(*[F.lit(m) for m in modules]))
    if planes:
        touch = touch | F.arrays_overlap("planes", F.array(*[F.lit(p) for p in planes]))
    pool = newest.filter(in_force() & touch)
    stale = F.lit(False) if head is None else F.coalesce(F.col("ingested_through") != head, F.lit(False))
    fresh = decisions.agg(F.bool_or(stale).alias("_stale"))
    order = [F.desc(_rank_of(AUTHORITY_RANK, F.col("authority"))), F.asc("decision_id")]
    return pool.orderBy(*order).limit(top_k).join(fresh, on=F.lit(True)).withColumn(
        "currentness", F.when(F.col("_stale"), "stale").otherwise("current")).drop("_stale")


def stage_funnel(rows: DataFrame) -> DataFrame:
    """(query_id, stage, stage_no, reason) with NULL reason = passed -> per stage: in, out, and removed by reason.

    One row per (stage, reason); ``candidates_in`` and ``candidates_out`` repeat on each of the stage's rows.
    """
    per = rows.groupBy("stage_no", "stage", F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))
    w = W.partitionBy("stage_no", "stage")
    return per.select("stage_no", "stage", "reason", "n", F.sum("n").over(w).alias("candidates_in"),
                      F.coalesce(F.sum(F.when(F.col("reason") == "passed", F.col("n"))).over(w), F.lit(0)).cast("bigint").alias("candidates_out"))
