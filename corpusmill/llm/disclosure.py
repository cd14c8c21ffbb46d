"""Personal data: rules find it, and information theory finds the terms that give it away.

Four kinds are found by pattern: e-mail addresses, IPv4 addresses, card numbers and phone numbers. Each distinct value is a
protected entity, also one that stands in a single text, and so is each kind as a whole. A term co-occurs with what stands
in the same text. How much a term t discloses of an entity e is pointwise mutual information over the information of the
entity, log(p(e|t) N / n_e) / log(N / n_e), counted over all rows, with p(e|t) = (n_te + n_e / N) / (n_t + 1): the share of
the term's rows that hold the entity, drawn towards the entity's own share by one row. A term that reaches ``threshold``
is masked wherever it stands: replaced by its kind in the sanitised text. So a term of a single row gives a value away from
some thousand rows on (at 0.9), fewer rows prove it by their kind or by repeating it.

Patterns are possessive or bounded, so long texts cost linear time; the conditions before them make them find what the plain
forms find. Null text is an empty one. Repeated rows get equal spans and count each. Null ids stay null. Everything is column
expressions, joins and aggregates; terms and entities are counted by partial aggregates under 64-bit hashes, values in the
same rows are one entity, and a term meets only entities that it is rare enough to disclose. Rows without an entity are
thinned by bitmaps before terms or texts of theirs move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import let, stored
from corpusmill.llm.near_dedup import _marked

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SPAN = "array<struct<start:int,k:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _valid(kind: str):
    return lambda s: _holds(kind, s.value)


def count(spans: str, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter(spans, lambda s: s.k == k)).cast("bigint")


def occurrences(text: Column, pattern: Column, k: int) -> Column:
    """Spans of the matches, in code points: what stands between the matches gives their places."""
    def placed(found: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(_SPAN).alias("out"))

            def add(a, m):
                begin = a.at + F.length(F.get(gaps, a.i))
                span = F.struct(begin.alias("start"), F.lit(k).alias("k"), (begin + F.length(m)).alias("end"), m.alias("value"))
                return F.struct((begin + F.length(m)).alias("at"), (a.i + 1).alias("i"), F.concat(a.out, F.array(span)).alias("out"))
            return F.aggregate(found, zero, add).out
        return F.when(F.size(found) == 0, F.array().cast(_SPAN)).otherwise(let(F.split(text, pattern, -1), with_gaps))
    return let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def base_spans(text: Column) -> Column:
    """Spans of the four kinds, by start and kind."""
    hint = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    found = [F.when(hint[kind], F.filter(occurrences(text, F.lit(p), k), _valid(kind))).otherwise(F.array().cast(_SPAN)) for k, (kind, p) in enumerate(PATTERNS.items())]
    return F.sort_array(F.concat(*found))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))


def _hashed(text: Column) -> Column:
    return F.transform(_terms(text), lambda w: F.xxhash64(w))


def _most(n_e: Column, n: int, threshold: float) -> Column:
    """n_t + 1 of the most frequent term that can disclose an entity of n_e rows."""
    return (n_e + n_e / n) * F.pow(F.lit(float(n)) / n_e, F.lit(1 - threshold))


def _reveals(n_te: Column, n_e: Column, n: int, threshold: float) -> Column:
    return (n_e < n) & (F.col("n_t") + 1 <= (n_te + n_e / n) * F.pow(F.lit(float(n)) / n_e, F.lit(1 - threshold)))


def revealing_terms(scanned: DataFrame, docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(term, outside) of the terms that disclose some entity, by hash, ``outside``: they stand in rows without any entity
    too; and (row, term) of the terms that may, in rows with entities. ``scanned``: (row, base, terms); ``docs``: (text)."""
    held = scanned.filter(F.size("base") > 0)
    kinds = [count("base", kind) > 0 for kind in PATTERNS]
    totals = held.agg(*[F.count_if(has).alias(f"n_{k}") for k, has in enumerate(kinds)]).first()
    n, most = docs.count(), max(totals)
    if not most:
        nothing = held.select("row", F.lit(0).cast("bigint").alias("term")).limit(0)
        return nothing.select("term", F.lit(False).alias("outside")), nothing
    counted = docs.select(F.explode(_hashed(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).filter(F.col("n_t") + 1 <= _most(F.lit(float(most)), n, threshold))
    near = stored(held.select("row", *[has.alias(f"k_{k}") for k, has in enumerate(kinds)], F.explode("terms").alias("term")).join(counted, "term"), "near")
    by_kind = [F.count_if(f"k_{k}").alias(f"n_{k}") for k in range(len(kinds))]
    summed = near.groupBy("term", "n_t").agg(F.count(F.lit(1)).alias("n_held"), *by_kind)
    kind = F.lit(False)
    for k, total in enumerate(totals):
        kind = kind | _reveals(F.col(f"n_{k}"), F.lit(float(total)), n, threshold) if total else kind
    occ = stored(held.select("row", F.explode(F.array_distinct(F.transform("base", lambda s: F.xxhash64(s.k, F.lower(s.value))))).alias("e")), "entities")
    marks = [F.sum(F.pmod(F.xxhash64("row", F.lit(i)), F.lit(1 << 31))).alias(f"m_{i}") for i in (0, 1)]
    entity = occ.groupBy("e").agg(F.count(F.lit(1)).cast("double").alias("n_e"), *marks)
    alike = stored(occ.join(entity, "e").select("row", "n_e", "m_0", "m_1").distinct(), "alike")
    met = near.select("row", "term", "n_t").join(alike, "row").filter(F.col("n_t") + 1 <= _most(F.col("n_e"), n, threshold))
    value = met.groupBy("n_e", "m_0", "m_1", "term", "n_t").agg(F.count(F.lit(1)).alias("n_te")).filter(_reveals(F.col("n_te"), F.col("n_e"), n, threshold))
    found = value.select("term", F.lit(True).alias("by_value")).distinct()
    terms = summed.join(found, "term", "left").filter(kind | F.col("by_value").isNotNull()).select("term", (F.col("n_t") > F.col("n_held")).alias("outside"))
    return stored(terms, "revealing"), near.select("row", "term")


def find(docs: DataFrame, threshold: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for each row: base spans, and all spans, as (start, k, end, value); KINDS[k] is the kind."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.xxhash64("id", "text"))
    found = rows.select("id", "row", "text", base_spans(F.col("text")).alias("base"))
    holds = F.size("base") > 0
    scanned = stored(found.select("id", "row", "base", F.when(holds, F.col("text")).alias("text"), F.when(holds, _hashed(F.col("text"))).alias("terms")), "scanned")
    terms, near = revealing_terms(scanned, rows, threshold)
    base = scanned.select("id", "row", "base")
    if terms.limit(1).count() == 0:
        return base.select("id", "base", F.col("base").alias("spans"))
    hits = near.join(terms.select("term"), "term").groupBy("row").agg(F.collect_set("term").alias("hits"))
    added = scanned.filter(holds).select("row", "text").join(stored(hits, "hits"), "row").select("row", _standing(F.col("text"), F.col("hits")).alias("added"))
    outside = terms.filter("outside").select("term")
    if outside.limit(1).count():
        bare, wanted = scanned.filter(~holds).select("row"), outside.select(F.col("term").alias("id"))
        words = _marked(rows.select("row", F.explode(_hashed(F.col("text"))).alias("id")), wanted).join(wanted, "id")
        far = stored(words.groupBy("row").agg(F.collect_set("id").alias("hits")).join(bare, "row", "left_semi"), "far").withColumnRenamed("row", "id")
        texts = _marked(rows.select(F.col("row").alias("id"), "text"), far.select("id")).join(far, "id")
        added = added.unionByName(texts.select(F.col("id").alias("row"), _standing(F.col("text"), F.col("hits")).alias("added")))
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (a.start < b.end) & (b.start < a.end)))
    return base.join(stored(added.dropDuplicates(["row"]), "added"), "row", "left").select("id", "base", F.sort_array(F.concat("base", F.coalesce(apart, F.array().cast(_SPAN)))).alias("spans"))


def _standing(text: Column, hits: Column) -> Column:
    """Spans of the terms whose hashes are given."""
    own = F.filter(_terms(text), lambda w: F.array_contains(hits, F.xxhash64(w)))
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.sort_array(own), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return let(pattern, lambda p: occurrences(text, p, len(KINDS) - 1))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(F.array(*map(F.lit, KINDS)), s.k + 1), F.lit(":"), s.start, F.lit(":"), s.end)), ",")


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(a, s):
        tag = F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), s.k + 1), F.lit("]"))
        return F.when(s.start < a.at, a).otherwise(F.struct(s.end.alias("at"), F.concat(a.out, F.substring(text, a.at + 1, s.start - a.at), tag).alias("out")))
    return F.aggregate(spans, zero, add, lambda a: F.concat(a.out, F.substring(text, a.at + 1, F.length(text) - a.at)))
