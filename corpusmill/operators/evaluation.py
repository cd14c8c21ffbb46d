"""Retrieval quality over labelled query sets. All ratios are integer ppm.

hits: (query_id, rank, source_path, content_hash, chunk_id, span_start, span_end, status, tokens, ...) cut to the
evaluation depth; labels: (query_id, label_id, role, group_id, mode, source_path, content_hash, chunk_id, spans) with role
in required / evidence / stale / forbidden / privacy / distractor. ``keys`` carries extra grouping columns (a stage or a
run), so several orderings are measured in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.measures import PPM, gain, lcount, lsum, mean_ppm, ppm
from corpusmill.functions.text import collapse_ws
from corpusmill.sources.records import STALE_STATUSES, STATUSES

KEYS = ["query_id"]


def match_labels(hits: DataFrame, labels: DataFrame, source_only: bool = False) -> DataFrame:
    """Hit columns plus label_id, role, group_id, mode for every satisfied label.

    Path must be equal; a version, a chunk or acceptable spans are required where the label names them (``source_only``
    looks at path and version alone). An equi-join on (query, path) with the rest as a residual test.
    """
    l = labels.select("query_id", "source_path", "label_id", "role", "group_id", "mode", *[
        F.col(c).alias(f"l_{c}") for c in ("content_hash", "chunk_id", "spans") if c in labels.columns])
    ok = F.col("l_content_hash").isNull() | (F.col("l_content_hash") == F.col("content_hash"))
    if not source_only and "l_chunk_id" in l.columns:
        ok = ok & (F.col("l_chunk_id").isNull() | (F.col("l_chunk_id") == F.col("chunk_id")))
    if not source_only and "l_spans" in l.columns:
        ok = ok & (F.col("l_spans").isNull() | F.exists(
            "l_spans", lambda s: (s["start"] == F.col("span_start")) & (s["end"] == F.col("span_end"))))
    return hits.join(l, ["query_id", "source_path"]).filter(ok).drop("l_content_hash", "l_chunk_id", "l_spans")


def _per_query(queries: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Every query of every run, also those without rows. ``queries`` has the keys."""
    return queries.select(*keys).distinct().join(df, keys, "left")


def recall_mrr(queries: DataFrame, hits: DataFrame, labels: DataFrame, ks: list[int], keys=KEYS) -> DataFrame:
    """num_required, matched_at_k, recall_at_k (ppm), first_relevant_rank, rr (ppm). No required label counts as full recall."""
    req = labels.filter("role = 'required'")
    first = match_labels(hits, req).groupBy(*keys, "label_id").agg(F.min("rank").alias("first"))
    total = req.groupBy("query_id").agg(F.count("*").alias("num_required"))
    agg = first.groupBy(*keys).agg(F.min("first").alias("first_relevant_rank"), *[lcount(F.col("first") <= k).alias(f"matched_at_{k}") for k in ks])
    out = _per_query(queries, agg, keys).join(total, "query_id", "left").fillna(0, ["num_required", "first_relevant_rank", *[f"matched_at_{k}" for k in ks]])
    return out.select(*keys, "num_required", *[f"matched_at_{k}" for k in ks],
                      *[ppm(F.col(f"matched_at_{k}"), F.col("num_required"), PPM).alias(f"recall_at_{k}") for k in ks],
                      "first_relevant_rank", F.when(F.col("first_relevant_rank") > 0, ppm(F.lit(1), F.col("first_relevant_rank"))).otherwise(0).cast("bigint").alias("rr"))


def _label_key(labels: DataFrame) -> list[str]:
    """What tells labels apart: path, version, chunk and spans. Two chunks of one path are two labels."""
    return [c for c in ("query_id", "source_path", "content_hash", "chunk_id", "spans") if c in labels.columns]


def relevance_flags(hits: DataFrame, labels: DataFrame, keys=KEYS) -> DataFrame:
    """Adds ``relevant`` to hits: in rank order each label pays for one hit and each hit takes one label, the first free
    one in label order. Labels may overlap, so this is a fold over the query's depth-bounded list of labelled hits."""
    key = _label_key(labels)
    pos = labels.filter("role IN ('required', 'evidence')").groupBy(*key).agg(
        *[F.min_by(c, "label_id").alias(c) for c in labels.columns if c not in key])
    m = match_labels(hits, pos).groupBy(*keys, "rank").agg(F.array_sort(F.collect_set("label_id")).alias("ids"))
    lists = m.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "ids"))).alias("rows"))
    ltype = dict(labels.dtypes)["label_id"]
    zero = F.struct(F.array().cast(f"array<{ltype}>").alias("used"), F.array().cast("array<bigint>").alias("ranks"))

    def step(acc: Column, r: Column) -> Column:
        free = F.try_element_at(F.array_except(r["ids"], acc["used"]), F.lit(1))
        return F.when(free.isNull(), acc).otherwise(F.struct(
            F.array_append(acc["used"], free).alias("used"), F.array_append(acc["ranks"], r["rank"].cast("bigint")).alias("ranks")))

    paid = lists.select(*keys, F.explode(F.aggregate("rows", zero, step, lambda a: a["ranks"])).alias("rank"))
    return hits.join(paid.withColumn("relevant", F.lit(True)), [*keys, "rank"], "left").fillna(False, ["relevant"])


def precision_ndcg(queries: DataFrame, flagged: DataFrame, labels: DataFrame, ks: list[int], keys=KEYS) -> DataFrame:
    """precision_at_k over min(k, hits) and nDCG_at_k with integer gains; an empty result scores full precision."""
    pos = labels.filter("role IN ('required', 'evidence')").select(*_label_key(labels)).distinct().groupBy("query_id").agg(
        F.count("*").alias("n_labels"))
    rel = F.col("relevant")
    agg = flagged.groupBy(*keys).agg(
        F.count("*").alias("n_hits"), *[lcount(rel & (F.col("rank") <= k)).alias(f"rel_{k}") for k in ks],
        *[lsum(F.when(rel & (F.col("rank") <= k), gain(F.col("rank")))).alias(f"dcg_{k}") for k in ks])
    out = _per_query(queries, agg, keys).join(pos, "query_id", "left").fillna(0)
    zero = F.lit(0).cast("bigint")
    cols = []
    for k in ks:
        ideal = F.least(F.col("n_labels"), F.lit(k)).cast("int")
        idcg = F.when(ideal < 1, zero).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(ideal, F.lit(1))), zero, lambda a, i: a + gain(i)))
        cols.append(ppm(F.col(f"rel_{k}"), F.least(F.col("n_hits"), F.lit(k)), PPM).alias(f"precision_at_{k}"))
        cols.append(ppm(F.col(f"dcg_{k}"), idcg, PPM).alias(f"ndcg_at_{k}"))
    return out.select(*keys, "n_hits", *cols)


def group_coverage(queries: DataFrame, hits: DataFrame, labels: DataFrame, keys=KEYS) -> DataFrame:
    """groups_total, groups_satisfied, coverage (ppm); an 'all' group needs each member, an 'any' group one."""
    ev = labels.filter("group_id IS NOT NULL")
    got = match_labels(hits, ev).select(*keys, "label_id").distinct().withColumn("_hit", F.lit(True))
    runs = queries.select(*keys).distinct()
    members = runs.join(ev.select("query_id", "group_id", "mode", "label_id"), "query_id").join(got, [*keys, "label_id"], "left")
    hit = F.coalesce("_hit", F.lit(False))
    groups = members.groupBy(*keys, "group_id", "mode").agg(F.when(F.col("mode") == "all", F.every(hit)).otherwise(F.bool_or(hit)).alias("ok"))
    agg = groups.groupBy(*keys).agg(F.count("*").alias("groups_total"), lcount(F.col("ok")).alias("groups_satisfied"))
    return _per_query(queries, agg, keys).fillna(0).select(
        *keys, "groups_total", "groups_satisfied", ppm(F.col("groups_satisfied"), F.col("groups_total"), PPM).alias("coverage"))


def bad_hits(queries: DataFrame, hits: DataFrame, labels: DataFrame, keys=KEYS) -> DataFrame:
    """Per query: explicit stale, wrong version, stale status, forbidden, privacy and distractor hits, their rates, and
    whether the top hit is one of the bad ones."""
    # a stale label names one version: without a hash it means the hits without one
    version = F.coalesce("content_hash", F.lit(""))
    judging = labels.filter("role IN ('stale', 'forbidden', 'privacy', 'distractor')").withColumn(
        "content_hash", F.when(F.col("role") == "stale", version).otherwise(F.col("content_hash")))
    flags = match_labels(hits.withColumn("content_hash", version), judging, source_only=True).groupBy(*keys, "rank").agg(
        *[F.bool_or(F.col("role") == r).alias(r) for r in ("stale", "forbidden", "privacy", "distractor")])
    want = labels.filter("role = 'required' AND content_hash IS NOT NULL").groupBy("query_id", "source_path").agg(
        F.min_by("content_hash", "label_id").alias("_want"))
    no = F.lit(False)
    h = hits.join(flags, [*keys, "rank"], "left").join(want, ["query_id", "source_path"], "left")
    for r in ("stale", "forbidden", "privacy", "distractor"):
        h = h.withColumn(r, F.coalesce(F.col(r), no))
    wrong = ~F.col("stale") & F.coalesce((F.col("content_hash") != F.col("_want")) & (F.col("content_hash") != ""), no)
    h = h.withColumn("wrong", wrong).withColumn("st", F.coalesce(F.col("status").isin(*STALE_STATUSES), no))
    judged = F.col("forbidden") | F.col("privacy") | F.col("distractor") | F.col("stale") | F.col("wrong")
    top = F.bool_or((F.col("rank") == 1) & (F.col("forbidden") | F.col("stale") | F.col("wrong") | F.col("privacy")))
    agg = h.groupBy(*keys).agg(
        F.count("*").alias("n_hits"), lcount(F.col("stale")).alias("explicit_stale"), lcount(F.col("wrong")).alias("wrong_version"),
        lcount(F.col("st")).alias("stale_status"), lcount(F.col("forbidden")).alias("forbidden"), lcount(F.col("privacy")).alias("privacy"),
        lcount(F.col("distractor")).alias("distractor"), lcount(judged).alias("judged_irrelevant"), top.alias("top1_bad"))
    out = _per_query(queries, agg, keys).fillna(0).fillna(False)
    stale_any = F.col("explicit_stale") + F.col("wrong_version") + F.col("stale_status")
    return out.withColumn("stale_affected", stale_any > 0).withColumn("stale_rate", ppm(stale_any, F.col("n_hits"))).withColumn(
        "irrelevant_rate", ppm(F.col("judged_irrelevant"), F.col("n_hits")))


def dup_and_diversity(queries: DataFrame, hits: DataFrame, dup_key: Column, ks: list[int], keys=KEYS) -> DataFrame:
    """duplicate_burden (ppm of hits that repeat an earlier text) and diversity_at_k (distinct sources among the top k)."""
    h = hits.withColumn("_d", dup_key)
    n, d = F.count("*"), F.count_distinct("_d")
    agg = h.groupBy(*keys).agg(n.alias("n_hits"), (n - d).alias("dups"), *[
        F.count_distinct(F.when(F.col("rank") <= k, F.col("source_path"))).alias(f"src_{k}") for k in ks])
    out = _per_query(queries, agg, keys).fillna(0)
    return out.select(*keys, ppm(F.col("dups"), F.col("n_hits")).alias("duplicate_burden"), *[
        ppm(F.col(f"src_{k}"), F.least(F.col("n_hits"), F.lit(k)), PPM).alias(f"diversity_at_{k}") for k in ks])


def validate_provenance(hits: DataFrame, corpus: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Adds ``failed_checks`` (sorted names, empty = valid) to hits: presence, status, source, hash, span, snippet.

    corpus: (source_path, corpus_hash, corpus_text). Spans are byte offsets. The corpus side is cut to the paths that
    were hit before its texts travel.
    """
    c = corpus.join(hits.select("source_path").distinct(), "source_path", "left_semi")
    h = hits.join(c, "source_path", "left")
    gone = F.lit(False)
    if tombstones is not None:
        h = h.join(tombstones.select("source_path").distinct().withColumn("_t", F.lit(True)), "source_path", "left")
        gone = F.coalesce("_t", F.lit(False))
    st, exists, deleted = F.col("status"), F.col("corpus_hash").isNotNull(), F.coalesce(F.col("status") == "deleted", F.lit(False))
    same = F.coalesce(F.col("content_hash") == F.col("corpus_hash"), F.lit(False))
    s, e = F.col("span_start"), F.col("span_end")
    raw = F.col("corpus_text").cast("binary")
    in_bounds = exists & (s >= 0) & (e >= s) & (e <= F.octet_length("corpus_text"))
    piece = collapse_ws(F.substring(raw, (s + 1).cast("int"), (e - s).cast("int")).cast("string"))
    derives = in_bounds & ((F.coalesce("snippet", F.lit("")) == "") | piece.startswith(F.col("snippet")))
    stale = st.isin(*STALE_STATUSES)
    status_ok = F.when(exists & same, st.isNull() | (st == "current")).when(exists, st.isNull() | stale).otherwise(st.isNull() | stale | gone)
    checks = {
        "content_hash_matches_source": F.when(exists, same).otherwise(gone | deleted),
        "provenance_present": (F.coalesce("source_path", F.lit("")) != "") & (F.coalesce("content_hash", F.lit("")) != "") & F.col("chunk_id").isNotNull() & s.isNotNull() & e.isNotNull(),
        "snippet_derives_from_span": derives, "source_exists_or_tombstoned": exists | gone | deleted,
        "span_in_bounds": in_bounds, "status_correct": status_ok, "status_in_enum": st.isNull() | st.isin(*STATUSES),
    }
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in checks.items()]))
    return h.withColumn("failed_checks", failed).drop("corpus_hash", "corpus_text", "_t")


def token_and_abstain(queries: DataFrame, flagged: DataFrame, labels: DataFrame, keys=KEYS) -> DataFrame:
    """relevant_token_ratio (ppm), abstained, and no_answer_false_positive for queries that expect no answer (a
    distractor hit where distractors are labelled, else any hit). queries: keys plus no_answer_expected."""
    d = labels.filter("role = 'distractor'")
    has = d.select("query_id").distinct().withColumn("_has", F.lit(True))
    dh = match_labels(flagged.drop("relevant"), d, source_only=True).groupBy(*keys).agg(F.count("*").alias("_dh"))
    agg = flagged.groupBy(*keys).agg(F.count("*").alias("n_hits"), lsum(F.col("tokens")).alias("tok"), lsum(F.when(F.col("relevant"), F.col("tokens"))).alias("rel_tok"))
    out = queries.select(*keys, "no_answer_expected").join(agg, keys, "left").join(dh, keys, "left").join(has, "query_id", "left").fillna(0)
    fp = F.when(F.coalesce("_has", F.lit(False)), F.col("_dh") > 0).otherwise(F.col("n_hits") > 0)
    return out.select(*keys, ppm(F.col("rel_tok"), F.col("tok")).alias("relevant_token_ratio"), (F.col("n_hits") == 0).alias("abstained"),
                      (F.col("no_answer_expected") & fp).alias("no_answer_false_positive"), "no_answer_expected")


def evaluate(queries: DataFrame, hits: DataFrame, labels: DataFrame, ks: list[int], dup_key: Column, keys=KEYS) -> DataFrame:
    """One wide row per query (and run): every metric above. ``queries`` holds the keys and no_answer_expected."""
    flagged = relevance_flags(hits, labels, keys)
    parts = [recall_mrr(queries, hits, labels, ks, keys), precision_ndcg(queries, flagged, labels, ks, keys).drop("n_hits"),
             group_coverage(queries, hits, labels, keys), bad_hits(queries, hits, labels, keys),
             dup_and_diversity(queries, hits, dup_key, ks, keys), token_and_abstain(queries, flagged, labels, keys)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys)
    return out


def aggregate_eval(per_query: DataFrame, ks: list[int], by: list[str] = ()) -> DataFrame:
    """Macro means (half-up integer mean of ppm), micro recall, presence rates."""
    n = F.count("*")
    macro = lambda c: mean_ppm(lsum(F.col(c)), n).alias(f"{c}_macro")
    rate = lambda cond, name: ppm(lcount(cond), n).alias(name)
    cols = [n.alias("num_queries")]
    for k in ks:
        cols += [macro(f"recall_at_{k}"), macro(f"precision_at_{k}"), macro(f"ndcg_at_{k}"), macro(f"diversity_at_{k}"),
                 ppm(lsum(F.col(f"matched_at_{k}")), lsum(F.col("num_required")), PPM).alias(f"recall_at_{k}_micro")]
    g = F.col("groups_total") > 0
    na = F.col("no_answer_expected")
    cols += [macro("rr"), F.when(F.count_if(g) == 0, F.lit(PPM)).otherwise(mean_ppm(lsum(F.when(g, F.col("coverage"))), F.count_if(g))).cast("bigint").alias("group_coverage_macro"),
             rate(F.col("stale_affected"), "stale_source_rate"), macro("stale_rate"), rate(F.col("forbidden") > 0, "forbidden_rate"),
             rate(F.col("privacy") > 0, "privacy_rate"), macro("irrelevant_rate"), macro("duplicate_burden"), macro("relevant_token_ratio"),
             ppm(lcount(F.col("no_answer_false_positive")), lcount(na)).alias("no_answer_fp_rate")]
    return per_query.groupBy(*by).agg(*cols) if by else per_query.agg(*cols)


def compare_runs(a: DataFrame, b: DataFrame, ks: list[int]) -> DataFrame:
    """Per query b against a: recall at the smallest k, rescued, bad top hit removed, and metric deltas."""
    k = min(ks)
    cols = ["rr", "coverage", *[f"{m}_at_{x}" for x in ks for m in ("recall", "precision", "ndcg")]]
    j = a.select("query_id", F.col("top1_bad").alias("_a"), *[F.col(c).alias(f"a_{c}") for c in cols]).join(
        b.select("query_id", F.col("top1_bad").alias("_b"), *[F.col(c).alias(f"b_{c}") for c in cols]), "query_id")
    return j.select("query_id", (F.col(f"b_recall_at_{k}") > F.col(f"a_recall_at_{k}")).alias("rescued"), (F.col("_a") & ~F.col("_b")).alias("top1_cleaned"),
                    *[(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"delta_{c}") for c in cols])


def channel_attribution(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """Per query: hits by channel, unique to one, required records found by the vector channel alone, exact matches demoted
    by fusion, and whether fusion changed the lexical order. hits: lexical_rank, vector_rank, fused_rank per fused hit."""
    lex, vec = F.col("lexical_rank").isNotNull(), F.col("vector_rank").isNotNull()
    req = labels.filter("role = 'required'")
    first = match_labels(hits, req).groupBy("query_id", "label_id").agg(F.min_by(F.struct(lex.alias("l"), vec.alias("v"), F.col("source_path").alias("p")), "rank").alias("x"))
    rescued = first.filter("x.v AND NOT x.l").groupBy("query_id").agg(F.count_distinct("x.p").alias("rescued_by_vector"))
    w = W.partitionBy("query_id")
    lex_order = F.row_number().over(w.orderBy(F.asc_nulls_last("lexical_rank"), "fused_rank"))
    ranked = hits.withColumn("_lo", lex_order).withColumn("_fo", F.row_number().over(w.orderBy("fused_rank")))
    agg = ranked.groupBy("query_id").agg(
        lcount(lex).alias("lexical_hits"), lcount(vec).alias("vector_hits"), lcount(lex & ~vec).alias("unique_to_lexical"), lcount(vec & ~lex).alias("unique_to_vector"),
        lcount(lex & (F.col("fused_rank") > F.col("lexical_rank"))).alias("demoted_by_fusion"),
        (F.count_if(~lex) + F.count_if(lex & (F.col("_lo") != F.col("_fo"))) > 0).alias("fusion_reordered"))
    return agg.join(rescued, "query_id", "left").fillna(0, ["rescued_by_vector"])


def selection_conformance(ranked: DataFrame, grants: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Per query: out-of-scope candidates and selections, stale and non-current selections under current_only, and the
    order of superseded pairs. ranked: (query_id, rvid, selection_rank, selected, namespace, status, effective_current, mode)."""
    r = ranked
    if grants is not None:
        r = r.join(grants.select("query_id", "namespace").distinct().withColumn("_in", F.lit(True)), ["query_id", "namespace"], "left")
    else:
        r = r.withColumn("_in", F.lit(True))
    out, sel = F.col("_in").isNull(), F.col("selected")
    stale = F.coalesce(F.col("status").isin(*STALE_STATUSES), F.lit(False))
    gone = F.coalesce(~F.col("effective_current"), stale)
    co = F.col("mode") == "current_only"
    agg = r.groupBy("query_id").agg(
        F.count("*").alias("candidates"), lcount(sel).alias("selected"), lcount(out).alias("cross_candidates"), lcount(out & sel).alias("cross_selected"),
        lcount(stale).alias("stale_candidates"), lcount(co & sel & stale).alias("stale_leaks"), lcount(co & sel & gone).alias("noncurrent_leaks"))
    s = ranked.filter("selected").select("query_id", "rvid", "selection_rank")
    pairs = (s.withColumnRenamed("rvid", "dst").join(edges.select("src", "dst").distinct(), "dst")
             .join(s.select(F.col("query_id").alias("_q"), F.col("rvid").alias("_s"), F.col("selection_rank").alias("_r")), (F.col("query_id") == F.col("_q")) & (F.col("src") == F.col("_s"))))
    # the reference successor of a superseded hit is the smallest id among those selected with it
    pick = pairs.groupBy("query_id", "dst", "selection_rank").agg(F.min_by("_r", "_s").alias("_r"))
    order = pick.groupBy("query_id").agg(F.count("*").alias("pairs"), lcount(F.col("_r") < F.col("selection_rank")).alias("pairs_in_order"))
    return agg.join(order, "query_id", "left").fillna(0, ["pairs", "pairs_in_order"])


def reason_code_coverage(ranked: DataFrame) -> DataFrame:
    """(reason_code, n): every code seen in the ranked rows."""
    return ranked.select(F.explode("reason_codes").alias("reason_code")).groupBy("reason_code").agg(F.count("*").alias("n"))


def disposition_accuracy(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Confusion table (expected, actual, n) with the overall accuracy (ppm) repeated; unlabelled queries do not count."""
    j = actual.join(expected.filter("expected IS NOT NULL"), "query_id").groupBy("expected", F.col("disposition").alias("actual")).agg(F.count("*").alias("n"))
    total = j.agg(ppm(lsum(F.when(F.col("expected") == F.col("actual"), F.col("n"))), lsum(F.col("n")), PPM).alias("accuracy"))
    return j.join(total, on=F.lit(True))


def calibration(results: DataFrame, gold: DataFrame, tier_cost: dict[str, int], top_tier: str) -> DataFrame:
    """One row: accuracy, acceptances below the top tier, false approvals among them, wrong at the top, flagged, weighted
    cost per item (thousandths) and the saving against always using the top tier. ``tier_cost`` in thousandths per call.

    results: (item_id, answer, accepted_tier, needs_frontier, calls map-free columns calls_<tier>); gold: (item_id, gold).
    """
    j = results.join(gold, "item_id")
    right = F.coalesce(F.lower(F.trim("answer")) == F.lower(F.trim("gold")), F.lit(False))
    below = F.col("accepted_tier") != top_tier
    cost = F.lit(0).cast("bigint")
    for tier, c in tier_cost.items():
        if f"calls_{tier}" in results.columns:
            cost = cost + F.col(f"calls_{tier}").cast("bigint") * c
    agg = j.agg(F.count("*").alias("n"), lcount(right).alias("correct"), lcount(below).alias("accepted_below_top"),
                lcount(below & ~right & ~F.col("needs_frontier")).alias("false_approvals"), lcount(~below & ~right).alias("wrong_at_top"),
                lcount(F.col("needs_frontier")).alias("flagged"), lsum(cost).alias("cost"),
                *[lcount(F.col("accepted_tier") == t).alias(f"resolved_{t}") for t in tier_cost])
    n = F.col("n")
    return agg.withColumn("accuracy", ppm(F.col("correct"), n)).withColumn("false_approval_rate", ppm(F.col("false_approvals"), F.col("accepted_below_top"))).withColumn(
        "saving", F.lit(PPM) - ppm(F.col("cost"), n * tier_cost[top_tier]))


def nav_curve(costs: DataFrame) -> DataFrame:
    """(scale, leaves, nodes_examined) rows -> per scale p50, p95, max (nearest rank on integers), the p50 share of the
    leaves (floor ppm), and whether that share did not rise from the scale before.

    Equal costs are counted first, so the exact percentile reads a histogram instead of sorting every query.
    """
    hist = costs.groupBy("scale", "leaves", "nodes_examined").agg(F.count("*").alias("c"))
    w = W.partitionBy("scale").orderBy("nodes_examined")
    cum = hist.withColumn("_upto", F.sum("c").over(w)).withColumn("_n", F.sum("c").over(W.partitionBy("scale")))

    def pick(p: int) -> Column:
        rank = F.floor((F.lit(p) * (F.col("_n") - 1) + 50) / 100)
        return F.min(F.when(F.col("_upto") > rank, F.col("nodes_examined"))).cast("bigint")

    out = cum.groupBy("scale", "leaves").agg(F.max("_n").alias("queries"), pick(50).alias("p50"), pick(95).alias("p95"), F.max("nodes_examined").cast("bigint").alias("max"))
    out = out.withColumn("share", F.floor(F.col("p50") * PPM / F.col("leaves")).cast("bigint"))
    # one row per scale: a handful
    prev = F.lag("share").over(W.orderBy("leaves"))
    return out.withColumn("not_rising", F.coalesce(F.col("share") <= prev, F.lit(True)))
