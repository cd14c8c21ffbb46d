"""Row-local predicates and derivations over documents. All are Column expressions: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import collapse_ws, derive_literals, derive_terms

# Task type -> query class, query class -> temporal intent.
TASK_CLASS = {
    "reference": "exact_reference", "lookup": "exact_reference", "id": "exact_reference",
    "coding": "procedure_selection", "implementation": "procedure_selection", "act": "procedure_selection",
    "verification": "current_state", "planning": "current_state", "status": "current_state",
    "debug": "causal_diagnosis", "debugging": "causal_diagnosis", "diagnosis": "causal_diagnosis",
    "research": "global_synthesis", "documentation": "global_synthesis", "synthesis": "global_synthesis",
    "history": "historical_reconstruction", "audit": "historical_reconstruction",
    "reconstruction": "historical_reconstruction",
    "timeline": "temporal_change", "changelog": "temporal_change", "change": "temporal_change",
    "precedent": "precedent_search", "prior_art": "precedent_search",
    "life": "local_factual", "default": "local_factual", "factual": "local_factual",
}
CLASS_INTENT = {
    "current_state": "current_only", "procedure_selection": "current_only", "exact_reference": "version_specific",
    "historical_reconstruction": "historical_as_of", "temporal_change": "any_valid_version",
    "local_factual": "any_valid_version", "global_synthesis": "any_valid_version",
    "causal_diagnosis": "any_valid_version", "precedent_search": "any_valid_version",
    "composite": "any_valid_version", "unclassified": "any_valid_version",
}
INTENTS = ("current_only", "historical_as_of", "version_specific", "any_valid_version")


def intake_gate(docs: DataFrame, max_bytes: int, body: str = "text") -> DataFrame:
    """Adds parse_status and reason; every row survives. ``body`` may be a string or a binary column."""
    raw = F.col(body).cast("binary")
    bad = F.contains(raw, F.lit(bytearray(1))) | ~F.is_valid_utf8(F.col(body).cast("string"))
    reason = F.when(F.octet_length(raw) > max_bytes, "oversize").when(bad, "binary_or_undecodable")
    return docs.withColumn("reason", reason).withColumn(
        "parse_status", F.when(F.col("reason").isNull(), "ok").otherwise("failed"))


def filter_hits(df: DataFrame, path_prefix=(), exclude_path_prefix=(), suffix=(), kinds=(), content_hash=None,
                path: str = "source_path") -> DataFrame:
    """Metadata predicates; each list is an OR, the lists are ANDed. Prefix tests push to the parquet scan."""
    def any_of(make, values) -> Column:
        cond = F.lit(False)
        for v in values:
            cond = cond | make(v)
        return cond

    p = F.col(path)
    if path_prefix:
        df = df.filter(any_of(p.startswith, path_prefix))
    if exclude_path_prefix:
        df = df.filter(~any_of(p.startswith, exclude_path_prefix))
    if suffix:
        df = df.filter(any_of(p.endswith, suffix))
    if kinds:
        df = df.filter(F.col("record_kind").isin(*kinds))
    if content_hash is not None:
        df = df.filter(F.col("content_hash") == content_hash)
    return df


def apply_scope(df: DataFrame, request: DataFrame, grant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose namespace is in request AND grant, plus a count of refused rows per query without their ids.

    ``request`` / ``grant``: (query_id, namespace). A query that asks for nothing gets nothing, and so does one that is
    granted nothing; a NULL namespace never passes.
    """
    keys = ["query_id", "namespace"]
    allowed = grant.select(*keys).distinct().join(request.select(*keys).distinct(), keys, "left_semi")
    flagged = df.join(allowed.withColumn("_ok", F.lit(True)), ["query_id", "namespace"], "left")
    in_scope = flagged.filter(F.col("_ok")).drop("_ok")
    violations = flagged.groupBy("query_id").agg(F.count_if(F.col("_ok").isNull()).cast("bigint").alias("violations"))
    return in_scope, violations


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def classify_queries(tasks: DataFrame) -> DataFrame:
    """(task_type, query_class?, temporal_intent?, version?, text) -> query class and temporal intent with their basis.

    A temporal intent that is named but unknown allows every version.
    """
    explicit = F.lower(F.trim(F.col("query_class")))
    mapped = _lookup(TASK_CLASS, F.lower(F.trim(F.coalesce(F.col("task_type"), F.lit("default")))))
    has_literals = F.size(derive_literals(F.col("text"))) > 0
    known = explicit.isin(*CLASS_INTENT)
    out = (
        tasks.withColumn("class_out", F.when(known, explicit).when(mapped.isNotNull(), mapped)
                         .when(has_literals, "exact_reference").otherwise("unclassified"))
        .withColumn("class_basis", F.when(known, "explicit").when(mapped.isNotNull(), "task_type")
                    .when(has_literals, "literal_signal").otherwise("unclassified_fallback"))
    )
    asked = F.lower(F.trim(F.col("temporal_intent")))
    named = F.coalesce(F.col("temporal_intent"), F.lit("")) != ""
    return (
        out.withColumn("intent_out", F.when(named & (asked == "current"), "current_only").when(named & asked.isin(*INTENTS), asked)
                       .when(named, "any_valid_version")
                       .when(F.col("version").isNotNull(), "version_specific")
                       .otherwise(_lookup(CLASS_INTENT, F.col("class_out"))))
        .withColumn("intent_basis", F.when(named, "explicit_temporal_intent")
                    .when(F.col("version").isNotNull(), "explicit_version")
                    .otherwise(F.concat(F.lit("class_default:"), F.col("class_out"))))
    )


def classify_by_rules(title: Column, body: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """First rule that matches the title, else the first that matches the body, else the default."""
    picks = [F.when(title.rlike(p), name) for name, p in rules] + [F.when(body.rlike(p), name) for name, p in rules]
    return F.coalesce(*picks, F.lit(default))


def extract_fields(specs: list[tuple[str, Column, str, int]]) -> tuple[Column, Column]:
    """Ordered (tag, column, pattern, group) rules -> the first extracted value, and the tag of the rule that hit."""
    value, tag = [], []
    for name, col, pattern, group in specs:
        hit = col.rlike(pattern)
        value.append(F.when(hit, F.regexp_extract(col, pattern, group)))
        tag.append(F.when(hit, F.lit(name)))
    return F.coalesce(*value), F.coalesce(*tag)


def extract_refs(docs: DataFrame, key: str, body: Column, cue: str, ref: str, expand_digits: int,
                 suffix_pattern: str, prefix: str) -> DataFrame:
    """Every id named inside a cue window; shorthand such as D-0140/42/45 becomes three ids.

    ``cue`` has one group (the window); ``ref`` has two: the full digits and the run of shorthand suffixes.
    """
    windows = docs.select(key, F.explode(F.regexp_extract_all(body, F.lit(cue), F.lit(1))).alias("_w"))
    mentions = windows.select(key, F.explode(F.regexp_extract_all("_w", F.lit(ref), F.lit(0))).alias("_m"))
    full = F.regexp_extract("_m", ref, 1)
    tails = F.regexp_extract_all(F.regexp_extract("_m", ref, 2), F.lit(suffix_pattern), F.lit(1))
    stem = F.substring(full, 1, expand_digits)
    ids = F.concat(F.array(full), F.transform(tails, lambda t: F.concat(stem, t)))
    return mentions.select(key, F.explode(ids).alias("_id")).select(
        key, F.concat(F.lit(prefix), "_id").alias("ref_id")).distinct()


# What surrounds a label in an answer.
LABEL_FENCE = r"^```[a-zA-Z]*|```$"
LABEL_PREFIX = r"^(?i:label|category|answer|class|result)\s*[:\-]\s*"
LABEL_EDGES = r"""^[ \t"'“”‘’.,;:!?()\[\]{}*_\-]+|[ \t"'“”‘’.,;:!?()\[\]{}*_\-]+$"""


def bare_label(c: Column) -> Column:
    """An answer without fence, prefix, quotes and punctuation around it, in lower case."""
    inner = F.trim(F.regexp_replace(collapse_ws(c), LABEL_FENCE, ""))
    return F.trim(F.lower(F.regexp_replace(F.trim(F.regexp_replace(inner, LABEL_PREFIX, "")), LABEL_EDGES, "")))


def first_object(c: Column) -> Column:
    """The first stretch of a text from an opening brace to the brace that closes it, or NULL. Pieces between closing braces
    are counted through, so the fold has as many steps as there are closing braces."""
    pieces = F.split(F.regexp_extract(c, r"(?s)\{.*", 0), "\\}")
    opened = lambda piece: F.length(piece) - F.length(F.translate(piece, "{", ""))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("closed_at"))
    state = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, lambda s, piece: F.when(s["closed_at"] > 0, s).otherwise(F.struct(
        (s["at"] + 1).alias("at"), (s["depth"] + opened(piece) - 1).alias("depth"),
        F.when(s["depth"] + opened(piece) == 1, s["at"] + 1).otherwise(0).alias("closed_at"))))
    return F.when(state["closed_at"] > 0, F.concat(F.array_join(F.slice(pieces, F.lit(1), state["closed_at"]), "}"), F.lit("}")))


def normalise_labels(answers: DataFrame, label_set: list[str], mode: str, truncated: str = "truncated") -> DataFrame:
    """Adds label/labels, parsed, in_set, confidence_pct (integer hundredths) and flag_reason for one answer column.

    ``classify`` picks one label (exact, then longest label inside the first line); ``multilabel`` splits on , ; newline.
    """
    norm = bare_label
    labels = sorted(label_set, key=lambda s: (-len(s), s))
    arr = F.array(*[F.lit(s) for s in labels])
    blank = F.col("answer").isNull() | (collapse_ws(F.col("answer")) == "")
    cap = lambda c: F.when(F.col(truncated), F.least(c, F.lit(40))).otherwise(c)
    if mode == "classify":
        whole = norm(F.col("answer"))
        first_line = norm(F.element_at(F.split(F.col("answer"), "\n"), 1))
        exact = F.when(F.array_contains(arr, whole), whole)
        line = F.when(F.array_contains(arr, first_line), first_line)
        inside = F.try_element_at(
            F.filter(arr, lambda a: F.call_function(
                "rlike", first_line, F.concat(F.lit(r"(?<!\w)\Q"), a, F.lit(r"\E(?!\w)")))), F.lit(1))
        fuzzy = F.coalesce(line, inside)
        return (
            answers.withColumn("label", F.when(~blank, F.coalesce(exact, fuzzy)))
            .withColumn("parsed", ~blank)
            .withColumn("in_set", ~blank & F.col("label").isNotNull())
            .withColumn("confidence_pct", cap(
                F.when(blank, 10).when(exact.isNotNull(), 80).when(fuzzy.isNotNull(), 60).otherwise(20)).cast("bigint"))
            .withColumn("flag_reason", F.when(blank, "malformed").when(F.col("label").isNull(), "uncategorized"))
        )
    if mode == "multilabel":
        toks = F.filter(F.transform(F.split(F.col("answer"), "[,\n;]"), norm), lambda t: F.length(t) > 0)
        kept = F.array_distinct(F.filter(toks, lambda t: F.array_contains(arr, t)))
        none = (F.size(toks) == 1) & (F.try_element_at(toks, F.lit(1)) == "none")
        dropped = F.size(F.filter(toks, lambda t: ~F.array_contains(arr, t)))
        clean = (dropped == 0) & (F.size(kept) >= 1)
        return (
            answers.withColumn("labels", F.when(blank | none, F.array().cast("array<string>")).otherwise(kept))
            .withColumn("parsed", ~blank)
            .withColumn("in_set", ~blank & (none | clean))
            .withColumn("confidence_pct", F.when(blank, 15).otherwise(cap(
                F.when(none, 70).when(clean, 75).when(F.size(kept) >= 1, 50).otherwise(20))).cast("bigint"))
            .withColumn("flag_reason", F.when(blank, "malformed")
                        .when(~none & (F.size(kept) == 0), "uncategorized"))
        )
    raise ValueError(mode)


def normalise_extraction(answers: DataFrame, fields: list[str], truncated: str = "truncated") -> DataFrame:
    """JSON answer -> wanted fields, confidence_pct by how many are present (75 / 50 / 30, 10 for an empty answer)."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    obj = F.coalesce(first_object(F.col("answer")), F.lit(""))
    blank = F.col("answer").isNull() | (collapse_ws(F.col("answer")) == "")
    df = answers.withColumn("_o", F.when(F.call_function("json_array_length", F.concat(F.lit("["), obj, F.lit("]"))) == 1,
                                         F.from_json(obj, schema)))
    present = F.size(F.array_compact(F.array(*[
        F.when(F.length(F.trim(F.col(f"_o.{f}"))) > 0, F.lit(1)) for f in fields])))
    conf = F.when(blank, 10).when(F.col("_o").isNull(), 30).when(present == len(fields), 75).when(present >= 1, 50).otherwise(30)
    for f in fields:
        df = df.withColumn(f, F.col(f"_o.{f}"))
    return (
        df.withColumn("parsed", F.col("_o").isNotNull())
        .withColumn("confidence_pct", F.when(F.col(truncated), F.least(conf, F.lit(40))).otherwise(conf).cast("bigint"))
        .withColumn("flag_reason", F.when(F.col("_o").isNull(), "malformed").when(present == 0, "failed_transform"))
        .drop("_o")
    )


def difference_bits(values: Column) -> Column:
    """Bit i is 1 where element i+1 is larger than element i; returned as a string of 0 and 1."""
    left, right = F.slice(values, F.lit(1), F.size(values) - 1), F.slice(values, F.lit(2), F.size(values) - 1)
    return F.array_join(F.zip_with(left, right, lambda a, b: F.when(b > a, "1").otherwise("0")), "")


def bits_to_words(bits: Column, n_words: int) -> Column:
    """Bit string -> array of unsigned 32-bit words held in BIGINT, zero padded on the right."""
    padded = F.rpad(bits, 32 * n_words, "0")
    return F.array(*[F.conv(F.substring(padded, 32 * i + 1, 32), 2, 10).cast("bigint") for i in range(n_words)])


def hamming(a: Column, b: Column) -> Column:
    """Hamming distance of two word arrays: one XOR and popcount per word, inside codegen-friendly expressions."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")),
                       F.lit(0).cast("bigint"), lambda acc, v: acc + v)


def query_terms(df: DataFrame, cap: int = 12) -> DataFrame:
    return df.withColumn("terms", derive_terms(F.col("text"), cap)).withColumn("literals", derive_literals(F.col("text")))

