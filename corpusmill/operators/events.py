"""Event traces, reports, working state and review queues."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.measures import lcount, lsum
from corpusmill.operators.numbering import scan_in_order


def segment_stages(events: DataFrame) -> DataFrame:
    """(run_id, seq, type, ...) -> adds raw stage number ``stage_no``: a start opens a stage (closing an open one), an end
    closes it, and what follows an end before the next start is a stage of its own. Runs without markers are one stage.

    Numbers grow along the run but may skip; ``stages`` renumbers them.
    """
    start, end = (F.col("type") == "stage_start").cast("bigint"), (F.col("type") == "stage_end").cast("bigint")
    out = scan_in_order(events, ["run_id"], ["seq"], sums={"_starts": start, "_ends": end})
    return out.withColumn("stage_no", F.col("_starts") + F.col("_ends") - (F.col("type") == "stage_end").cast("bigint")).drop("_starts", "_ends")


def stages(segmented: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per stage with explicit end status, error flag, duration, resolved status and 1-based index.

    segmented: run_id, seq, type, stage_no, status, duration_ms; runs: (run_id, failed). Status: explicit > failed when an
    error occurred > incomplete when the run failed > ok.
    """
    from pyspark.sql import Window as W

    end = F.col("type") == "stage_end"
    g = segmented.groupBy("run_id", "stage_no").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("events"),
        F.max_by("status", F.when(end, F.col("seq"))).alias("explicit"), F.bool_or(F.col("type") == "error").alias("had_error"),
        F.max_by("duration_ms", F.when(end & F.col("duration_ms").isNotNull(), F.col("seq"))).alias("end_ms"))
    j = g.join(runs.select("run_id", "failed"), "run_id")
    status = F.when(F.col("explicit").isNotNull(), F.col("explicit")).when(F.col("had_error"), "failed").when(F.col("failed"), "incomplete").otherwise("ok")
    # a run's stages are numbered after grouping: far fewer rows than its events
    idx = F.row_number().over(W.partitionBy("run_id").orderBy("stage_no")).cast("bigint")
    return j.select("run_id", idx.alias("stage_index"), "first_seq", "last_seq", "events", "had_error", status.alias("status"), F.col("end_ms").alias("duration_ms"))


def episodes(events: DataFrame, types: list[str]) -> DataFrame:
    """One row per run, complete also for truncated runs: first and last time, counts by type, errors, final status
    (last explicit status, else failed on error, else incomplete without an end, else ok), distinct models."""
    end = F.col("type") == "stage_end"
    return events.groupBy("run_id").agg(
        F.count("*").alias("events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
        *[lcount(F.col("type") == x).alias(f"n_{x}") for x in types], F.count_distinct("model").alias("models"),
        F.max_by("status", F.when(end & F.col("status").isNotNull(), F.col("seq"))).alias("_s"), F.bool_or(F.col("type") == "error").alias("_e"), F.bool_or(end).alias("_c"),
    ).withColumn("final_status", F.coalesce("_s", F.when(F.col("_e"), F.lit("failed")).when(~F.col("_c"), "incomplete").otherwise("ok"))).drop("_s", "_e", "_c")


def failure_signature(component: Column, operation: Column, symptom: Column, condition: Column) -> Column:
    """Equal component, operation, symptom and condition facet sets give the same signature; order and repeats do not matter."""
    part = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(x)))), ",")
    return F.sha2(F.concat_ws("|", part(component), part(operation), part(symptom), part(condition)), 256)


def failure_records(failures: DataFrame) -> DataFrame:
    """(signature, ...) rows deduplicated to one record per signature with its first id and number of occurrences."""
    return failures.groupBy("signature").agg(F.min("failure_id").alias("record_id"), F.count("*").alias("occurrences"))


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row per key. A grouped maximum with map-side combine, not a window."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def wave_state(plan: DataFrame, latest: DataFrame) -> DataFrame:
    """plan: (plan_id, worker_id, report_back on_all|on_each); latest: (plan_id, worker_id, state). Per plan: members by
    state (no report = unreported), terminal = done + failed, and whether the plan is ready to report back."""
    j = plan.join(latest.select("plan_id", "worker_id", "state"), ["plan_id", "worker_id"], "left")
    s = F.coalesce("state", F.lit("unreported"))
    g = j.groupBy("plan_id", "report_back").agg(F.count("*").alias("members"), *[lcount(s == x).alias(x) for x in ("running", "done", "failed", "unreported")])
    term = F.col("done") + F.col("failed")
    return g.withColumn("terminal", term).withColumn("ready", F.when(F.col("report_back") == "on_each", term > 0).otherwise(term == F.col("members")))


def reconcile(plan: DataFrame, reports: DataFrame) -> DataFrame:
    """(finding, plan_id, worker_id): missing (expected, unreported), orphan (reported, unknown worker), plan_mismatch
    (known worker, other plan). plan: (worker_id, plan_id); reports: (worker_id, plan_id)."""
    p, r = plan.select("worker_id", "plan_id").distinct(), reports.select("worker_id", "plan_id").distinct()
    missing = p.join(r.select("worker_id"), "worker_id", "left_anti").select(F.lit("missing").alias("finding"), "plan_id", "worker_id")
    orphan = r.join(p.select("worker_id"), "worker_id", "left_anti").select(F.lit("orphan").alias("finding"), "plan_id", "worker_id")
    known = r.join(p.select("worker_id"), "worker_id", "left_semi").join(p, ["worker_id", "plan_id"], "left_anti").select(
        F.lit("plan_mismatch").alias("finding"), "plan_id", "worker_id")
    return missing.unionByName(orphan).unionByName(known)


def stage_times(stage_rows: DataFrame) -> DataFrame:
    """(context, start_us, stage_index, duration_ms) -> adds ts_us: start plus the durations of earlier stages (missing
    durations count as nothing); unknown when the start is unknown."""
    d = F.coalesce("duration_ms", F.lit(0)).cast("bigint")
    out = scan_in_order(stage_rows, ["context"], ["stage_index"], sums={"_cum": d})
    return out.withColumn("ts_us", F.col("start_us") + (F.col("_cum") - d) * 1000).drop("_cum")


def stitch_timeline(*sources: DataFrame) -> DataFrame:
    """Union of (ts_us, context, source, kind, detail, seq) sources to one schema with ``undated`` as a sort key, so that
    events without a time come last; sort by (undated, ts_us, source, context, seq)."""
    cols = ["ts_us", "context", "source", "kind", "detail", "seq"]
    out = sources[0].select(*cols)
    for s in sources[1:]:
        out = out.unionByName(s.select(*cols))
    return out.withColumn("undated", F.col("ts_us").isNull())


def apply_state_writes(writes: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Compare-and-set over (task_id, seq, parent, namespace): adds accepted, version and reason.

    Version N+1 needs parent N and the namespace fixed by version 1; a first write needs parent NULL or 0 and a namespace.
    ``heads``: (task_id, version, namespace) already stored. The tasks' writes stream through sorted partitions with only
    the current head in memory, so a long chain is never held as a group.
    """
    cols = writes.select("task_id", "seq", F.col("parent").cast("bigint").alias("parent"), "namespace")
    if heads is not None:
        cols = cols.join(heads.select("task_id", F.col("version").cast("bigint").alias("head"), F.col("namespace").alias("head_ns")), "task_id", "left")
    else:
        cols = cols.withColumn("head", F.lit(None).cast("bigint")).withColumn("head_ns", F.lit(None).cast("string"))
    key = dict(writes.dtypes)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, head, scope = object(), 0, None
        for b in batches:
            rows = []
            for t, seq, parent, ns, h, hns in b[["task_id", "seq", "parent", "namespace", "head", "head_ns"]].itertuples(index=False):
                if t != task:
                    task, head, scope = t, (0 if pd.isna(h) else int(h)), (hns if isinstance(hns, str) else None)
                asked = 0 if pd.isna(parent) else int(parent)
                ns = ns if isinstance(ns, str) and ns else None
                if head == 0 and ns is None:
                    reason = "no_namespace_scope"
                elif head and ns is not None and ns != scope:
                    reason = "namespace_immutable"
                elif asked != head:
                    reason = "cas_conflict"
                else:
                    reason = None
                    head, scope = head + 1, scope or ns
                rows.append((t, seq, reason is None, head if reason is None else None, reason))
            yield pd.DataFrame(rows, columns=["task_id", "seq", "accepted", "version", "reason"]).astype({"version": "Int64"})

    schema = f"task_id {key['task_id']}, seq {key['seq']}, accepted boolean, version bigint, reason string"
    return cols.repartition("task_id").sortWithinPartitions("task_id", "seq").mapInPandas(walk, schema)


def active_heads(states: DataFrame) -> DataFrame:
    """(task_id, version, ...) -> the newest version per task with the length of its chain."""
    return latest_by(states, ["task_id"], ["version"]).join(states.groupBy("task_id").agg(F.count("*").alias("versions")), "task_id")


def close_tasks(heads: DataFrame, closing: DataFrame, to: str = "archived") -> DataFrame:
    """Lifecycle step: heads of the closing tasks get the new state, closed ones cannot be closed twice."""
    c = closing.select("task_id").distinct().withColumn("_c", F.lit(True))
    open_ = F.col("lifecycle") == "active"
    j = heads.join(c, "task_id", "left")
    return j.withColumn("outcome", F.when(F.col("_c").isNull(), "untouched").when(open_, "closed").otherwise("already_closed")).withColumn(
        "lifecycle", F.when(F.col("_c") & open_, F.lit(to)).otherwise(F.col("lifecycle"))).drop("_c")


def fork(heads: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: (task_id, new_task_id) -> version 1 of the new task with the parent's namespace and a forked_from link."""
    return requests.join(heads, "task_id").select(
        F.col("new_task_id").alias("task_id"), F.lit(1).cast("bigint").alias("version"), "namespace",
        F.concat_ws("@", F.col("task_id").cast("string"), F.col("version").cast("string")).alias("forked_from"))


def promote(heads: DataFrame, kind: str = "summary") -> tuple[DataFrame, DataFrame]:
    """Heads as derived records, and one derived_from edge each."""
    from corpusmill.functions.ids import stable_id

    r = heads.select(stable_id("rv", F.col("task_id").cast("string"), F.col("version").cast("string")).alias("rvid"), "namespace", F.lit(kind).alias("kind"),
                     F.concat_ws("@", F.col("task_id").cast("string"), F.col("version").cast("string")).alias("_state"))
    return r.drop("_state"), r.select(F.col("rvid").alias("src"), F.col("_state").alias("dst"), F.lit("derived_from").alias("kind"))


def flag_items(items: DataFrame, threshold_pct: int) -> DataFrame:
    """Items below the confidence threshold as open review items with their reason."""
    return items.filter(F.col("confidence_pct") < threshold_pct).select(
        F.concat(F.lit("rq-"), F.col("item_id").cast("string")).alias("review_id"), "item_id", "confidence_pct",
        F.coalesce("flag_reason", F.lit("low_confidence")).alias("reason"), F.lit("open").alias("status"))


def select_open(queue: DataFrame, n: int, reasons: list[str] | None = None) -> DataFrame:
    """The first n open items in id order, optionally of some reasons."""
    q = queue.filter("status = 'open'")
    if reasons:
        q = q.filter(F.col("reason").isin(*reasons))
    return q.orderBy("review_id").limit(n)


def apply_resolutions(queue: DataFrame, resolutions: DataFrame, threshold_pct: int) -> tuple[DataFrame, DataFrame]:
    """resolutions: (review_id, answer, confidence_pct, wants_escalation). Resolved, or escalated when the answer is missing,
    escalation was asked for or confidence stays low. Returns the updated queue and the history rows to append."""
    r = resolutions.select("review_id", F.col("answer").alias("_a"), F.col("confidence_pct").alias("_c"), F.col("wants_escalation").alias("_w"), F.lit(True).alias("_r"))
    j = queue.join(r, "review_id", "left")
    hit = F.col("_r") & (F.col("status") == "open")
    esc = F.col("_a").isNull() | F.coalesce("_w", F.lit(False)) | (F.coalesce("_c", F.lit(0)) < threshold_pct)
    new = F.when(hit & esc, "escalated").when(hit, "resolved").otherwise(F.col("status"))
    out = j.withColumn("new_status", new)
    history = out.filter("new_status <> status").select("review_id", F.col("status").alias("from_status"), F.col("new_status").alias("to_status"), F.col("_a").alias("answer"))
    return out.withColumn("status", F.col("new_status")).withColumn("answer", F.when(F.col("status") == "resolved", F.col("_a"))).drop("new_status", "_a", "_c", "_w", "_r"), history


def group_labels(items: DataFrame, empty: str = "(none)") -> DataFrame:
    """(item_id, labels array, confidence_pct) -> per label: items, confidence sum and half-up mean; items without any
    label form their own bucket."""
    labels = F.when(F.size(F.coalesce("labels", F.array().cast("array<string>"))) == 0, F.array(F.lit(empty))).otherwise(F.col("labels"))
    n = F.count("*")
    return items.select("item_id", "confidence_pct", F.explode(labels).alias("label")).groupBy("label").agg(
        n.alias("items"), lsum(F.col("confidence_pct")).alias("confidence_sum")).withColumn(
        "mean_pct", F.floor((F.col("confidence_sum") * 2 + F.col("items")) / (F.col("items") * 2)).cast("bigint"))


def ordered_groups(batches: Iterator[pd.DataFrame], key: str):
    """Rows of sorted batches grouped by ``key`` across batch borders: (key, iterator of row tuples)."""
    rows = (r for b in batches for r in b.itertuples(index=False))
    return groupby(rows, key=lambda r: getattr(r, key))
