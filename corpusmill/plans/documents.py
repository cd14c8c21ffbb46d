"""Queries over single documents: predicates, derivations, chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as X
from corpusmill.functions.ids import stable_id
from corpusmill.operators import chunking as C
from corpusmill.operators import textops as P
from corpusmill.plans import shapes as S
from corpusmill.plans.registry import query

WS = r"[\s\x0B\x1C-\x1F\x85\pZ]"
LEX_SQL = "['" + "','".join(X.LEX_STOPWORDS) + "']"
DESC_SQL = "['" + "','".join(X.DESC_STOPWORDS) + "']"
TERM_SQL = "['" + "','".join(w.replace("'", "''") for w in X.TERM_STOPWORDS) + "']"


def lex_sql(col: str) -> str:
    return f"list_filter(regexp_extract_all(lower({col}), '[a-z0-9]+'), lambda t: NOT list_contains({LEX_SQL}, t))"


def desc_sql(col: str) -> str:
    return (f"list_filter(list_transform(regexp_extract_all({col}, '[A-Za-z0-9_]+'), lambda t: lower(t)), "
            f"lambda t: length(t) >= 2 AND NOT list_contains({DESC_SQL}, t))")


def terms_sql(col: str) -> str:
    """Salient terms in order, duplicates kept."""
    return (f"list_filter(regexp_extract_all(lower({col}), '[a-z0-9][a-z0-9_+#-]*'), "
            f"lambda t: length(t) >= 2 AND NOT list_contains({TERM_SQL}, t) AND NOT regexp_full_match(t, '[0-9]+'))")


def collapse_sql(e: str) -> str:
    return f"trim(regexp_replace({e}, '{WS}+', ' ', 'g'))"


@query("intake_gate", """
SELECT CASE WHEN octet_length(encode(text)) > 4000 THEN 'failed' WHEN contains(text, chr(0)) THEN 'failed' ELSE 'ok' END AS parse_status,
       CASE WHEN octet_length(encode(text)) > 4000 THEN 'oversize' WHEN contains(text, chr(0)) THEN 'binary_or_undecodable'
            ELSE 'none' END AS reason, count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS bytes
FROM documents GROUP BY ALL""")
def _intake(t):
    return (P.intake_gate(t.documents, 4000)
            .groupBy("parse_status", F.coalesce("reason", F.lit("none")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes")))


@query("metadata_predicates", S.with_ctes("records", """
SELECT rvid, source_path, kind AS record_kind FROM records
WHERE (starts_with(source_path, 'src1/') OR starts_with(source_path, 'src2'))
  AND NOT starts_with(source_path, 'src2/fr') AND (ends_with(source_path, '1') OR ends_with(source_path, '7'))
  AND kind IN ('summary', 'decision')"""))
def _predicates(t):
    r = S.records(t).withColumnRenamed("kind", "record_kind")
    return P.filter_hits(r, ["src1/", "src2"], ["src2/fr"], ["1", "7"], ["summary", "decision"]).select(
        "rvid", "source_path", "record_kind")


# Each language asks as one reader, granted some namespaces and asking for some; English asks for nothing and gets nothing.
@query("scope_filter", S.with_ctes("records", """
WITH hits AS (SELECT lang AS query_id, CASE WHEN n_chars % 11 = 0 THEN NULL ELSE namespace END AS namespace, rvid FROM records),
grants AS (SELECT DISTINCT lang AS query_id, namespace FROM records WHERE authority_level = 'authoritative'),
asked AS (SELECT DISTINCT lang AS query_id, namespace FROM records WHERE authority_level = 'derived' AND lang <> 'en'),
allowed AS (SELECT g.* FROM grants g WHERE EXISTS (SELECT 1 FROM asked a WHERE a.query_id = g.query_id AND a.namespace = g.namespace))
SELECT h.query_id, count(a.namespace) AS in_scope, count(*) - count(a.namespace) AS violations
FROM hits h LEFT JOIN allowed a ON h.query_id = a.query_id AND h.namespace = a.namespace GROUP BY 1"""))
def _scope(t):
    r = S.records(t)
    hits = r.select(F.col("lang").alias("query_id"),
                    F.when(F.col("n_chars") % 11 == 0, None).otherwise(F.col("namespace")).alias("namespace"), "rvid")
    grant = r.filter("authority_level = 'authoritative'").select(F.col("lang").alias("query_id"), "namespace")
    asked = r.filter("authority_level = 'derived' AND lang <> 'en'").select(F.col("lang").alias("query_id"), "namespace")
    ok, bad = P.apply_scope(hits, asked, grant)
    n_ok = ok.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return bad.join(n_ok, "query_id", "left").select(
        "query_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("in_scope"), "violations")


@query("normalisers", f"""
SELECT page_id, regexp_replace(replace('././' || replace(url, '/', chr(92)), chr(92), '/'), '^(\\./)+', '') AS path,
  sha256({collapse_sql("html")}) AS collapsed_hash,
  sha256(regexp_replace(replace(html, '<p>', chr(13) || chr(10)), '\\r\\n?', chr(10), 'g')) AS content_hash,
  regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
FROM pages""")
def _normalisers(t):
    return t.pages.select(
        "page_id", X.norm_path(F.concat(F.lit("././"), F.translate("url", "/", "\\"))).alias("path"),
        F.sha2(X.collapse_ws(F.col("html")), 256).alias("collapsed_hash"),
        X.content_hash(F.replace("html", F.lit("<p>"), F.lit("\r\n"))).alias("content_hash"),
        X.slug(F.col("url")).alias("slug"))


@query("tokenisers", f"""
SELECT doc_id, len({lex_sql("text")})::BIGINT AS n_lex, len({desc_sql("text")})::BIGINT AS n_desc,
  len(regexp_extract_all(text, '[\\pL\\pN_]+'))::BIGINT AS n_word,
  sha256(array_to_string({lex_sql("text")}, ' ')) AS lex_hash, sha256(array_to_string({desc_sql("text")}, ' ')) AS desc_hash
FROM documents""")
def _tokenisers(t):
    c = F.col("text")
    lex, desc, word = X.tokens_lex(c), X.tokens_desc(c), X.tokens_word(c)
    return t.documents.select("doc_id", lex.alias("a"), desc.alias("b"), F.size(word).cast("bigint").alias("n_word")).select(
        "doc_id", F.size("a").cast("bigint").alias("n_lex"), F.size("b").cast("bigint").alias("n_desc"), "n_word",
        F.sha2(F.array_join("a", " "), 256).alias("lex_hash"), F.sha2(F.array_join("b", " "), 256).alias("desc_hash"))


@query("token_estimates", f"""
SELECT lang, source, sum(ceil(length(text) / 4.0))::BIGINT AS ceil4, sum(greatest(1, length(text) // 4))::BIGINT AS floor4,
  sum(len(regexp_extract_all(text, '{WS.replace("[", "[^", 1)}+')))::BIGINT AS words FROM documents GROUP BY ALL""")
def _estimates(t):
    c = F.col("text")
    return t.documents.groupBy("lang", "source").agg(
        *[F.sum(X.est_tokens(c, m)).alias(m) for m in ("ceil4", "floor4", "words")])


_SNIP_TERMS = ("'that', 'with'", "'dans', 'avec'", "'und', 'der'")


@query("snippets", f"""
WITH d AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN ['that','with'] WHEN 'fr' THEN ['dans','avec'] ELSE ['und','der'] END AS terms FROM documents),
p AS (SELECT *, CASE WHEN instr(lower(text), terms[1]) > 0 THEN instr(lower(text), terms[1]) ELSE instr(lower(text), terms[2]) END AS pos FROM d),
w AS (SELECT *, greatest(0, pos - 1 - 120) AS s, least(length(text), pos - 1 + 120) AS e FROM p)
SELECT doc_id, CASE WHEN text = '' THEN '' WHEN pos > 0 THEN CASE WHEN s > 0 THEN '...' ELSE '' END || {collapse_sql("substring(text, s + 1, e - s)")}
   || CASE WHEN e < length(text) THEN '...' ELSE '' END
  ELSE {collapse_sql("substring(text, 1, 240)")} || CASE WHEN length(text) > 240 THEN '...' ELSE '' END END AS snippet FROM w""")
def _snippets(t):
    a = lambda *v: F.array(*[F.lit(x) for x in v])
    terms = F.when(F.col("lang") == "en", a("that", "with")).when(F.col("lang") == "fr", a("dans", "avec")).otherwise(a("und", "der"))
    return t.documents.select("doc_id", X.snippet(F.col("text"), terms).alias("snippet"))


_LITERALS = f"""list_concat(list_concat(list_transform(regexp_extract_all(text, '"([^"]{{2,80}})"', 1), lambda q: {collapse_sql("q")}),
   list_transform(regexp_extract_all(padded, '(?i)(?:^|[^\\pL\\pN_])(D-[0-9]{{3,5}})(?:$|[^\\pL\\pN_])', 1), lambda q: upper(q))),
  list_concat(regexp_extract_all(padded, '(#[0-9]{{1,4}})(?:$|[^\\pL\\pN_])', 1),
   list_transform(regexp_extract_all(padded, '(?i)(?:^|[^\\pL\\pN_])([a-z][a-z0-9]*\\.[a-z][a-z0-9.]*[a-z0-9])(?:$|[^\\pL\\pN_])', 1), lambda q: lower(q))))"""


@query("terms_and_literals", f"""
WITH d AS (SELECT doc_id, text, regexp_replace(text, '([^\\pL\\pN_.])', '\\1\\1', 'g') AS padded FROM documents),
r AS (SELECT doc_id, {terms_sql("text")} AS terms, {_LITERALS} AS lits FROM d),
tt AS (SELECT doc_id, w, min(i) AS i FROM r, unnest(terms) WITH ORDINALITY u(w, i) GROUP BY 1, 2),
ll AS (SELECT doc_id, w, min(i) AS i FROM r, unnest(lits) WITH ORDINALITY u(w, i) WHERE w <> '' GROUP BY 1, 2),
ta AS (SELECT doc_id, array_to_string(list(w ORDER BY i)[1:12], ' ') AS terms FROM tt GROUP BY 1),
la AS (SELECT doc_id, array_to_string(list(w ORDER BY i)[1:6], '|') AS literals FROM ll GROUP BY 1)
SELECT doc_id, coalesce(ta.terms, '') AS terms, coalesce(la.literals, '') AS literals
FROM r LEFT JOIN ta USING (doc_id) LEFT JOIN la USING (doc_id)""")
def _terms(t):
    return P.query_terms(t.documents).select(
        "doc_id", F.array_join("terms", " ").alias("terms"), F.array_join("literals", "|").alias("literals"))


_TASKS = """SELECT event_id, event_type, CASE event_type WHEN 'view' THEN 'lookup' WHEN 'click' THEN 'debug' WHEN 'purchase' THEN 'audit'
   WHEN 'signup' THEN NULL ELSE 'other' END AS task_type,
  CASE WHEN value > 60 THEN ' Composite' END AS query_class, CASE WHEN value < 3 THEN 'historical_as_of' WHEN value < 5 THEN ' Current' WHEN value < 7 THEN 'next year' WHEN value < 9 THEN '' END AS temporal_intent,
  CASE WHEN user_id % 5 = 0 THEN 'v1' END AS version, CASE WHEN value > 20 THEN 'see D-0042' ELSE 'see it' END AS text FROM events"""


@query("query_classes", f"""
WITH tasks AS ({_TASKS}), c AS (SELECT *, CASE WHEN query_class IS NOT NULL THEN 'composite' WHEN task_type = 'lookup' THEN 'exact_reference'
   WHEN task_type = 'debug' THEN 'causal_diagnosis' WHEN task_type = 'audit' THEN 'historical_reconstruction'
   WHEN task_type IS NULL THEN 'local_factual' WHEN text = 'see D-0042' THEN 'exact_reference' ELSE 'unclassified' END AS class_out,
  CASE WHEN query_class IS NOT NULL THEN 'explicit' WHEN coalesce(task_type, 'default') <> 'other' THEN 'task_type'
   WHEN text = 'see D-0042' THEN 'literal_signal' ELSE 'unclassified_fallback' END AS class_basis FROM tasks)
SELECT class_out, class_basis, CASE WHEN temporal_intent = ' Current' THEN 'current_only' WHEN temporal_intent = 'next year' THEN 'any_valid_version'
   WHEN temporal_intent <> '' THEN temporal_intent WHEN version IS NOT NULL THEN 'version_specific'
   WHEN class_out = 'exact_reference' THEN 'version_specific' WHEN class_out = 'historical_reconstruction' THEN 'historical_as_of'
   ELSE 'any_valid_version' END AS intent_out,
  CASE WHEN temporal_intent <> '' THEN 'explicit_temporal_intent' WHEN version IS NOT NULL THEN 'explicit_version'
   ELSE 'class_default:' || class_out END AS intent_basis, count(*) AS n FROM c GROUP BY ALL""")
def _classes(t):
    e, v = F.col("event_type"), F.col("value")
    tasks = t.events.select(
        F.when(e == "view", "lookup").when(e == "click", "debug").when(e == "purchase", "audit").when(e == "signup", None)
        .otherwise("other").alias("task_type"),
        F.when(v > 60, " Composite").alias("query_class"), F.when(v < 3, "historical_as_of").when(v < 5, " Current").when(v < 7, "next year").when(v < 9, "").alias("temporal_intent"),
        F.when(F.col("user_id") % 5 == 0, "v1").alias("version"),
        F.when(v > 20, "see D-0042").otherwise("see it").alias("text"))
    return P.classify_queries(tasks).groupBy("class_out", "class_basis", "intent_out", "intent_basis").agg(
        F.count(F.lit(1)).alias("n"))


_RULES = [("secret", r"token = |password"), ("contact", r"[0-9]@|\+1 \("), ("network", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
          ("license", r"(?i)licen[cs]e|copyright")]


@query("rule_classes", """
WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS body FROM documents)
SELECT doc_id, CASE
 WHEN regexp_matches(title, 'token = |password') THEN 'secret' WHEN regexp_matches(title, '[0-9]@|\\+1 \\(') THEN 'contact'
 WHEN regexp_matches(title, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'network' WHEN regexp_matches(title, '(?i)licen[cs]e|copyright') THEN 'license'
 WHEN regexp_matches(body, 'token = |password') THEN 'secret' WHEN regexp_matches(body, '[0-9]@|\\+1 \\(') THEN 'contact'
 WHEN regexp_matches(body, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'network' WHEN regexp_matches(body, '(?i)licen[cs]e|copyright') THEN 'license'
 ELSE 'ordinary' END AS rule_class FROM d""")
def _rules(t):
    title = F.element_at(F.split("text", "\n"), 1)
    return t.documents.select("doc_id", P.classify_by_rules(title, F.col("text"), _RULES, "ordinary").alias("rule_class"))


@query("field_extraction", """
WITH f AS (SELECT page_id, CASE WHEN regexp_matches(url, 'page=[0-9]+') THEN 1 WHEN regexp_matches(url, '/[0-9]+\\.html') THEN 2
   WHEN regexp_matches(url, '/[a-z]{2}/[0-9]+') THEN 3 WHEN regexp_matches(html, 'track\\([0-9]+\\)') THEN 4 END AS r, url, html FROM pages)
SELECT page_id, CASE r WHEN 1 THEN regexp_extract(url, 'page=([0-9]+)', 1) WHEN 2 THEN regexp_extract(url, '/([0-9]+)\\.html', 1)
   WHEN 3 THEN regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) WHEN 4 THEN regexp_extract(html, 'track\\(([0-9]+)\\)', 1) END AS number,
  CASE r WHEN 1 THEN 'url_page' WHEN 2 THEN 'url_html' WHEN 3 THEN 'url_path' WHEN 4 THEN 'body_track' END AS number_source FROM f""")
def _fields(t):
    v, tag = P.extract_fields([
        ("url_page", F.col("url"), "page=([0-9]+)", 1), ("url_html", F.col("url"), r"/([0-9]+)\.html", 1),
        ("url_path", F.col("url"), "/[a-z]{2}/([0-9]+)", 1), ("body_track", F.col("html"), r"track\(([0-9]+)\)", 1)])
    return t.pages.select("page_id", v.alias("number"), tag.alias("number_source"))


# Decision notes: every order is a note that may name earlier ones; part of them in shorthand.
S.register_cte("notes", """SELECT o_orderkey, 'D-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS note_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'this supersedes D-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || '/42/45, done'
   WHEN '2-HIGH' THEN 'it replaces D-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || ' and D-' || lpad((o_custkey // 3 % 10000)::VARCHAR, 4, '0') || '. See D-0001'
   ELSE 'mentions D-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') END AS text FROM orders""")
CUE = r"(?is)\b(?:supersedes?|replaces?)\b(.{0,80}?)(?:[.,;\n]|$)"


def notes(t):
    num = lambda e: F.lpad((e % 10000).cast("string"), 4, "0")
    cust, third = F.col("o_custkey"), F.expr("o_custkey div 3")
    return t.orders.select(
        "o_orderkey", F.concat(F.lit("D-"), num(F.col("o_orderkey"))).alias("note_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("this supersedes D-"), num(cust), F.lit("/42/45, done")))
        .when(F.col("o_orderpriority") == "2-HIGH",
              F.concat(F.lit("it replaces D-"), num(cust), F.lit(" and D-"), num(third), F.lit(". See D-0001")))
        .otherwise(F.concat(F.lit("mentions D-"), num(cust))).alias("text"))


def note_refs(t):
    return P.extract_refs(notes(t), "o_orderkey", F.col("text"), CUE, r"D-([0-9]{4})((?:/[0-9]{2}(?![0-9]))*)", 2,
                          r"/([0-9]{2})", "D-")


@query("reference_extraction", S.with_ctes("notes", """
WITH w AS (SELECT o_orderkey, unnest(regexp_extract_all(text, '(?is)\\b(?:supersedes?|replaces?)\\b(.{0,80}?)(?:[.,;\\n]|$)', 1)) AS win FROM notes),
m AS (SELECT o_orderkey, unnest(regexp_extract_all(win, 'D-[0-9]{4}(?:/[0-9]{2})*')) AS tok FROM w),
x AS (SELECT o_orderkey, substring(tok, 1, 6) AS ref_id FROM m UNION
      SELECT o_orderkey, substring(tok, 1, 4) || unnest(regexp_extract_all(tok, '/([0-9]{2})', 1)) FROM m)
SELECT DISTINCT o_orderkey, ref_id FROM x"""))
def _refs(t):
    return note_refs(t)


def _bare(c: str) -> str:
    """SQL twin of the bare label: fence, prefix, then what surrounds it."""
    flat = f"regexp_replace(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '^```[a-zA-Z]*|```$', '', 'g')"
    named = f"trim(regexp_replace(trim({flat}), '^(?i:label|category|answer|class|result)\\s*[:\\-]\\s*', ''))"
    edges = "[ \\t\"''“”‘’.,;:!?()\\[\\]{}*_\\-]+"
    return f"trim(lower(regexp_replace({named}, '^{edges}|{edges}$', '', 'g')))"


@query("label_normalisation", """
WITH a AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '  ' WHEN turn % 4 = 0 THEN ' "' || upper(role) || '". '
    WHEN turn % 4 = 1 THEN 'The ' || role || ' power user said' || chr(10) || text WHEN turn % 4 = 2 THEN text
    WHEN length(text) % 2 = 0 THEN 'Label: (' || role || ')!' ELSE '```txt ' || role || chr(10) || '```' END AS answer,
    length(text) > 300 AS truncated FROM conversations),
n AS (SELECT *, trim(regexp_replace(answer, '\\s+', ' ', 'g')) = '' AS blank,
  """ + _bare("answer") + """ AS whole, """ + _bare("string_split(answer, chr(10))[1]") + """ AS line1 FROM a),
l AS (SELECT *, CASE WHEN blank THEN NULL WHEN whole IN ('power user', 'assistant', 'user') THEN whole WHEN line1 IN ('power user', 'assistant', 'user') THEN line1
   WHEN regexp_matches(line1, '\\bpower user\\b') THEN 'power user' WHEN regexp_matches(line1, '\\bassistant\\b') THEN 'assistant'
   WHEN regexp_matches(line1, '\\buser\\b') THEN 'user' END AS label FROM n)
SELECT conv_id, turn, label, NOT blank AS parsed, NOT blank AND label IS NOT NULL AS in_set,
  (CASE WHEN truncated THEN least(40, c) ELSE c END)::BIGINT AS confidence_pct,
  CASE WHEN blank THEN 'malformed' WHEN label IS NULL THEN 'uncategorized' END AS flag_reason
FROM (SELECT *, CASE WHEN blank THEN 10 WHEN whole IN ('power user', 'assistant', 'user') THEN 80 WHEN label IS NOT NULL THEN 60 ELSE 20 END AS c FROM l)""")
def _labels(t):
    role, turn = F.col("role"), F.col("turn")
    answers = t.conversations.select(
        "conv_id", "turn", F.when(role == "system", "  ").when(turn % 4 == 0, F.concat(F.lit(' "'), F.upper(role), F.lit('". ')))
        .when(turn % 4 == 1, F.concat(F.lit("The "), role, F.lit(" power user said\n"), F.col("text")))
        .when(turn % 4 == 2, F.col("text")).when(F.length("text") % 2 == 0, F.concat(F.lit("Label: ("), role, F.lit(")!")))
        .otherwise(F.concat(F.lit("```txt "), role, F.lit("\n```"))).alias("answer"), (F.length("text") > 300).alias("truncated"))
    return P.normalise_labels(answers, ["assistant", "user", "power user"], "classify").select(
        "conv_id", "turn", "label", "parsed", "in_set", "confidence_pct", "flag_reason")


@query("multilabel_normalisation", """
WITH a AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'none' WHEN 'error' THEN ' ' WHEN 'click' THEN 'Click, view;click'
   WHEN 'signup' THEN event_type || ', other' ELSE 'other' END AS answer, value > 30 AS truncated FROM events),
k AS (SELECT *, list_filter(list_transform(regexp_split_to_array(answer, '[,\\n;]'), lambda x: lower(trim(x))), lambda x: x <> '') AS toks FROM a),
r AS (SELECT *, trim(answer) = '' AS blank, toks = ['none'] AS is_none, list_filter(toks, lambda x: list_contains(['view','click','signup'], x)) AS good FROM k),
s AS (SELECT *, list_filter(good, lambda t, i: list_position(good, t) = i) AS kept, len(good) = len(toks) AND len(good) > 0 AS clean FROM r),
o AS (SELECT CASE WHEN blank OR is_none THEN '' ELSE array_to_string(kept, ',') END AS labels, NOT blank AND (is_none OR clean) AS in_set,
  (CASE WHEN blank THEN 15 ELSE (CASE WHEN truncated THEN least(40, c) ELSE c END) END)::BIGINT AS confidence_pct,
  CASE WHEN blank THEN 'malformed' WHEN NOT is_none AND len(kept) = 0 THEN 'uncategorized' ELSE 'none' END AS flag_reason
 FROM (SELECT *, CASE WHEN is_none THEN 70 WHEN clean THEN 75 WHEN len(kept) > 0 THEN 50 ELSE 20 END AS c FROM s))
SELECT *, count(*) AS n FROM o GROUP BY ALL""")
def _multilabels(t):
    e = F.col("event_type")
    answers = t.events.select(
        F.when(e == "view", "none").when(e == "error", " ").when(e == "click", "Click, view;click")
        .when(e == "signup", F.concat(e, F.lit(", other"))).otherwise("other").alias("answer"),
        (F.col("value") > 30).alias("truncated"))
    return P.normalise_labels(answers, ["view", "click", "signup"], "multilabel").groupBy(
        F.array_join("labels", ",").alias("labels"), "in_set", "confidence_pct",
        F.coalesce("flag_reason", F.lit("none")).alias("flag_reason")).agg(F.count(F.lit(1)).alias("n"))


@query("extraction_normalisation", """
WITH a AS (SELECT event_id, event_type, CASE event_type WHEN 'error' THEN 'no json' WHEN 'click' THEN '{"k": ' WHEN 'view' THEN '' ELSE 'ok ' || props || ' or {"k": "z"}' END AS answer,
   value > 40 AS truncated, json_extract_string(props, '$.k') AS k, props FROM events)
SELECT event_type, CASE WHEN event_type IN ('purchase', 'signup') THEN k END AS k, event_type IN ('purchase', 'signup') AS parsed,
  (CASE WHEN truncated THEN least(40, c) ELSE c END)::BIGINT AS confidence_pct,
  CASE WHEN event_type NOT IN ('purchase', 'signup') THEN 'malformed' END AS flag_reason, count(*) AS n
FROM (SELECT *, CASE WHEN answer = '' THEN 10 WHEN event_type IN ('error', 'click') THEN 30 ELSE 50 END AS c FROM a) GROUP BY ALL""")
def _extraction(t):
    e = F.col("event_type")
    answers = t.events.select(
        "event_type", F.when(e == "error", "no json").when(e == "click", '{"k": ').when(e == "view", "")
        .otherwise(F.concat(F.lit("ok "), "props", F.lit(' or {"k": "z"}'))).alias("answer"), (F.col("value") > 40).alias("truncated"))
    return P.normalise_extraction(answers, ["k", "missing"]).groupBy(
        "event_type", "k", "parsed", "confidence_pct", "flag_reason").agg(F.count(F.lit(1)).alias("n"))


@query("difference_hash", """
SELECT vec_id, array_to_string(list_transform(range(1, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN '1' ELSE '0' END), '') AS bits,
  hamming(array_to_string(list_transform(range(1, len(embedding)), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN '1' ELSE '0' END), ''),
          repeat('10', 32)[1:len(embedding) - 1])::BIGINT AS from_zigzag FROM embeddings""")
def _dhash(t):
    bits = P.difference_bits(F.col("embedding"))
    n = F.size("embedding") - 1
    zigzag = P.bits_to_words(F.substring(F.lit("10" * 32), F.lit(1), n), 2)
    return t.embeddings.select("vec_id", bits.alias("bits"), P.hamming(P.bits_to_words(bits, 2), zigzag).alias("from_zigzag"))


@query("stable_ids", S.with_ctes("corpus", """
SELECT doc_id, 'rec_' || substring(sha256(namespace || chr(0) || source_path), 1, 24) AS record_id,
  'occ_' || substring(sha256(content_hash || chr(0) || 'ck1' || chr(0) || '0' || chr(0) || n_chars), 1, 24) AS version_id FROM corpus"""))
def _ids(t):
    return S.corpus(t).select("doc_id", stable_id("rec", "namespace", "source_path").alias("record_id"),
                              stable_id("occ", "content_hash", F.lit("ck1"), F.lit("0"), "n_chars").alias("version_id"))


@query("chunk_blocks", S.with_ctes("lines", """
WITH l AS (SELECT doc_id, line_no, n_lines, line || CASE WHEN line_no < n_lines - 1 THEN chr(10) ELSE '' END AS s FROM lines),
z AS (SELECT doc_id, line_no, length(s) AS chars, octet_length(encode(s)) AS bytes, trim(s, chr(10) || ' ' || chr(13) || chr(9)) = '' AS blank FROM l WHERE s <> ''),
walk AS (
  SELECT doc_id, line_no, chars AS used, 0 AS chunk, (chars >= 400 AND (blank OR chars >= 800)) AS shut FROM z WHERE line_no = 0
  UNION ALL
  SELECT z.doc_id, z.line_no, CASE WHEN w.shut THEN z.chars ELSE w.used + z.chars END, w.chunk + CASE WHEN w.shut THEN 1 ELSE 0 END,
    (CASE WHEN w.shut THEN z.chars ELSE w.used + z.chars END >= 400) AND (z.blank OR (CASE WHEN w.shut THEN z.chars ELSE w.used + z.chars END) >= 800)
  FROM walk w JOIN z ON z.doc_id = w.doc_id AND z.line_no = w.line_no + 1),
g AS (SELECT w.doc_id, w.chunk, sum(z.bytes)::BIGINT AS nb, string_agg(l.s, '' ORDER BY l.line_no) AS text, bool_and(z.blank) AS empty
  FROM walk w JOIN z USING (doc_id, line_no) JOIN l USING (doc_id, line_no) GROUP BY ALL),
p AS (SELECT *, (sum(nb) OVER (PARTITION BY doc_id ORDER BY chunk))::BIGINT AS e FROM g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) - 1 AS chunk_index, e - nb AS "start", e AS "end", sha256(text) AS text_hash
FROM p WHERE NOT empty""", recursive=True))
def _blocks(t):
    return C.chunk_blocks(t.documents, 400).select("doc_id", "chunk_index", "start", "end", F.sha2("text", 256).alias("text_hash"))


@query("chunk_sections")
def _sections(t):
    return C.chunk_sections(S.markdown(t), 400).select(
        "doc_id", "chunk_index", "start", "end", "section_path", "heading", F.sha2("text", 256).alias("text_hash"))


@query("chunk_paragraphs", """
WITH docs AS (SELECT conv_id * 1000 + turn AS doc_id, regexp_replace(text, '[.]', '.' || chr(10) || chr(10), 'g') AS text FROM conversations
   UNION ALL SELECT -1 - doc_id, text FROM documents),
l AS (SELECT doc_id, i AS n, ls[i] AS line, len(ls) AS total, regexp_full_match(ls[i], '\\s*') AS blank,
    octet_length(encode(array_to_string(ls[1:i-1], chr(10)))) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS off
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs) t, unnest(range(1, len(ls) + 1)) u(i)),
m AS (SELECT *, CASE WHEN NOT blank AND coalesce(lag(blank) OVER w, true) THEN 1 ELSE 0 END AS opens FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY n) AS para FROM m),
c AS (SELECT doc_id, (para - 1)::BIGINT AS chunk_index, '(lines ' || min(n) || '-' || max(n) || ')' AS span_label, min(off)::BIGINT AS "start",
   max(off + octet_length(encode(line)) + CASE WHEN n < total THEN 1 ELSE 0 END)::BIGINT AS "end", trim(string_agg(line, chr(10) ORDER BY n)) AS text
   FROM g WHERE NOT blank GROUP BY doc_id, para)
SELECT doc_id, chunk_index, span_label, "start", "end", sha256(text) AS text_hash FROM c
UNION ALL SELECT doc_id, 0, '(document)', 0, octet_length(encode(text))::BIGINT, sha256(trim(text)) FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM c)""")
def _paragraphs(t):
    docs = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
                                  F.regexp_replace("text", "[.]", ".\n\n").alias("text"))
    docs = docs.unionByName(t.documents.select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    return C.chunk_paragraphs(docs).select("doc_id", "chunk_index", "span_label", "start", "end", F.sha2("text", 256).alias("text_hash"))


S.register_cte("heads", """SELECT doc_id, line_no, length(regexp_extract(line, '^(#{1,6})\\s+(.*)$', 1)) AS level,
   trim(regexp_extract(line, '^(#{1,6})\\s+(.*)$', 2)) AS title, off, n_bytes FROM (
   SELECT doc_id, line_no, line, coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
    (sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id) - 1)::BIGINT AS n_bytes FROM md_lines)
   WHERE regexp_matches(line, '^#{1,6}\\s+')""", ["md_lines"])
S.register_cte("outl", """SELECT h.doc_id, row_number() OVER (PARTITION BY h.doc_id ORDER BY h.line_no) - 1 AS ordinal, h.line_no, h.level::BIGINT AS level, h.title,
  (SELECT string_agg(a.title, ' > ' ORDER BY a.line_no) FROM heads a WHERE a.doc_id = h.doc_id AND a.line_no <= h.line_no
     AND (a.line_no = h.line_no OR a.level < h.level)
     AND NOT EXISTS (SELECT 1 FROM heads b WHERE b.doc_id = h.doc_id AND b.line_no > a.line_no AND b.line_no <= h.line_no AND b.level <= a.level)) AS section_path,
  h.off AS "start", coalesce((SELECT min(n.off) FROM heads n WHERE n.doc_id = h.doc_id AND n.line_no > h.line_no AND n.level <= h.level), h.n_bytes) AS "end" FROM heads h""",
               ["heads"])


@query("outline", S.with_ctes("outl", 'SELECT * FROM outl'))
def _outline(t):
    return C.outline(S.markdown(t))


@query("pattern_facts", S.with_ctes("lines", """
WITH o AS (SELECT *, (sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY line_no))::BIGINT AS stop FROM lines),
f AS (SELECT *, 'capital' AS kind, '^([A-Z][A-Z]+)' AS p FROM o UNION ALL SELECT *, 'quoted', '"([0-9a-f]{8})[0-9a-f]*"' FROM o
      UNION ALL SELECT *, 'mail', '([0-9]+)@' FROM o)
SELECT doc_id, kind, regexp_extract(line, p, 1) AS name, line_no + 1 AS line, stop - octet_length(encode(line)) - 1 AS "start",
  CASE WHEN line_no = n_lines - 1 THEN stop - 1 ELSE stop END AS "end" FROM f WHERE regexp_matches(line, p)"""))
def _facts(t):
    return C.extract_facts(t.documents, [("capital", "^([A-Z][A-Z]+)"), ("quoted", '"([0-9a-f]{8})[0-9a-f]*"'), ("mail", "([0-9]+)@")])


@query("doc_summary", S.with_ctes("outl", """
SELECT m.doc_id, len(string_split(m.text, chr(10)))::BIGINT AS n_lines, octet_length(encode(m.text))::BIGINT AS n_bytes,
  coalesce(s.n, 0) AS sections, coalesce(s.titles, '') AS titles
FROM md m LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(title, ' | ' ORDER BY ordinal) AS titles FROM outl GROUP BY 1) s USING (doc_id)"""))
def _doc_summary(t):
    md = S.markdown(t)
    return C.doc_summary(md, C.outline(md))


@query("table_rows", """
WITH r AS (SELECT o_orderkey AS line_no, '| D-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' | '
   || o_orderstatus || ' | ' || o_orderpriority || CASE WHEN o_orderstatus = 'F' THEN ' [superseded by D-' || lpad((o_custkey % 10000)::VARCHAR, 4, '0') || ']' ELSE '' END || ' |' AS line FROM orders)
SELECT line_no, trim(string_split(line, '|')[2]) AS decision_id, trim(string_split(line, '|')[3]) AS day, trim(string_split(line, '|')[4]) AS state,
  trim(string_split(line, '|')[5]) AS cell, nullif(regexp_extract(line, '\\[superseded by (D-[0-9]{4})\\]', 1), '') AS superseded_by FROM r""")
def _table_rows(t):
    num = lambda c: F.lpad((F.col(c) % 10000).cast("string"), 4, "0")
    line = F.concat(
        F.lit("| D-"), num("o_orderkey"), F.lit(" | "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" | "), "o_orderstatus",
        F.lit(" | "), "o_orderpriority",
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit(" [superseded by D-"), num("o_custkey"), F.lit("]"))).otherwise(""), F.lit(" |"))
    lines = t.orders.select(F.col("o_orderkey").alias("line_no"), line.alias("line"))
    return C.parse_table_rows(lines, ["decision_id", "day", "state", "cell"], {"superseded_by": r"\[superseded by (D-[0-9]{4})\]"}).drop("line")
