"""Shared derivations of the catalog shapes from the driver's tables, in Spark and, word for word, in SQL.

Nothing here drops rows: every document is part of the corpus, the records and at least one snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.plans.registry import Tables

_CTES = {
    "corpus": """SELECT doc_id, source AS namespace, lang, source || '/' || lang || '/' || doc_id AS source_path,
        text, sha256(text) AS content_hash, n_chars FROM documents""",
    # Snapshots: toxic documents disappear, low-quality ones arrive late, German ones move, French ones are edited.
    "prev": """SELECT c.source_path, c.namespace, c.content_hash, 'ck1' AS chunker, 'active' AS serving
        FROM corpus c LEFT JOIN labels l ON c.doc_id = l.doc_id WHERE coalesce(l.quality, 1) <> 0""",
    "curr": """SELECT CASE WHEN c.lang = 'de' THEN 'moved/' ELSE '' END || c.source_path AS source_path, c.namespace,
        CASE WHEN c.lang = 'fr' THEN sha256(c.text || ' rev2') ELSE c.content_hash END AS content_hash,
        'ck1' AS chunker, 'active' AS serving
        FROM corpus c LEFT JOIN labels l ON c.doc_id = l.doc_id WHERE coalesce(l.toxic, 0) <> 1""",
    # Records: one immutable version per document; 100 neighbouring ids of a source form one logical record.
    "records": """SELECT 'rv' || doc_id AS rvid, 'rec_' || namespace || '_' || (doc_id // 100) AS record_id, doc_id,
        CASE lang WHEN 'en' THEN 'summary' WHEN 'fr' THEN 'decision' WHEN 'de' THEN 'failure' ELSE 'procedure' END AS kind,
        namespace, lang, source_path, content_hash, n_chars,
        CASE WHEN n_chars % 3 = 0 THEN 'superseded' WHEN n_chars % 7 = 0 THEN 'source_stale' ELSE 'current' END AS status,
        CASE WHEN n_chars >= 6000 THEN 'authoritative' WHEN n_chars >= 2000 THEN 'curated'
             WHEN n_chars >= 500 THEN 'source_material' ELSE 'derived' END AS authority_level,
        text FROM corpus""",
    # A later version supersedes the previous one of its record; French ones are also superseded by the one after next.
    "supersessions": """SELECT src, dst FROM (
        SELECT lead(rvid) OVER w AS src, rvid AS dst FROM records WINDOW w AS (PARTITION BY record_id ORDER BY doc_id)
        UNION ALL
        SELECT src, dst FROM (SELECT lead(rvid, 2) OVER w AS src, rvid AS dst, lang FROM records
                              WINDOW w AS (PARTITION BY record_id ORDER BY doc_id)) WHERE lang = 'fr')
        WHERE src IS NOT NULL""",
    "lines": """SELECT doc_id, i - 1 AS line_no, ls[i] AS line, len(ls) AS n_lines FROM (
        SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) t, unnest(range(1, len(ls) + 1)) u(i)""",
    # Markdown shape: short lines become headings, the shorter the higher.
    "md": """SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
          '(?m)^([^\\n]{31,60})$', '### \\1', 'g'), '(?m)^([^\\n]{13,30})$', '## \\1', 'g'),
          '(?m)^([^\\n]{1,12})$', '# \\1', 'g') AS text FROM documents""",
    "md_lines": """SELECT doc_id, i - 1 AS line_no, ls[i] AS line, len(ls) AS n_lines FROM (
        SELECT doc_id, string_split(text, chr(10)) AS ls FROM md) t, unnest(range(1, len(ls) + 1)) u(i)""",
}
_NEEDS = {"prev": ["corpus"], "curr": ["corpus"], "records": ["corpus"], "supersessions": ["records"],
          "md_lines": ["md"]}


def register_cte(name: str, sql: str, needs: list[str] | None = None) -> None:
    _CTES[name] = sql
    if needs:
        _NEEDS[name] = needs


def with_ctes(names: str, body: str, recursive: bool = False) -> str:
    """Prefix ``body`` with the named shapes and what they are built on."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in _NEEDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    body = body.strip()
    ctes = ",\n".join(f"{n} AS ({_CTES[n]})" for n in order)
    kw = "WITH RECURSIVE " if recursive else "WITH "
    if body.upper().startswith("WITH "):
        return f"{kw}{ctes},\n{body[5:].strip()}"
    return f"{kw}{ctes}\n{body}"


def found(t: Tables, hits: DataFrame, key: str = "chunk_id", prefix: str = "") -> DataFrame:
    """The documents that a written table of hits names in ``key``: the texts of all others go no further than the scan."""
    ids = hits.select(F.col(key).alias("_id")).distinct()
    doc = F.concat(F.lit(prefix), "doc_id") if prefix else F.col("doc_id")
    return t.documents.join(ids, doc == F.col("_id"), "left_semi")


def corpus(t: Tables, documents: DataFrame | None = None) -> DataFrame:
    return (t.documents if documents is None else documents).select(
        "doc_id", F.col("source").alias("namespace"), "lang",
        F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("source_path"),
        "text", F.sha2("text", 256).alias("content_hash"), "n_chars")


def _with_labels(t: Tables) -> DataFrame:
    return corpus(t).join(t.labels, "doc_id", "left")


def prev_snapshot(t: Tables) -> DataFrame:
    return _with_labels(t).filter(F.coalesce("quality", F.lit(1)) != 0).select(
        "source_path", "namespace", "content_hash", F.lit("ck1").alias("chunker"), F.lit("active").alias("serving"))


def curr_snapshot(t: Tables) -> DataFrame:
    return _with_labels(t).filter(F.coalesce("toxic", F.lit(0)) != 1).select(
        F.concat(F.when(F.col("lang") == "de", "moved/").otherwise(""), "source_path").alias("source_path"), "namespace",
        F.when(F.col("lang") == "fr", F.sha2(F.concat("text", F.lit(" rev2")), 256))
        .otherwise(F.col("content_hash")).alias("content_hash"),
        F.lit("ck1").alias("chunker"), F.lit("active").alias("serving"))


def records(t: Tables, documents: DataFrame | None = None) -> DataFrame:
    n = F.col("n_chars")
    return corpus(t, documents).select(
        F.concat(F.lit("rv"), "doc_id").alias("rvid"),
        F.concat_ws("_", F.lit("rec"), "namespace", F.expr("doc_id div 100").cast("string")).alias("record_id"),
        "doc_id",
        F.when(F.col("lang") == "en", "summary").when(F.col("lang") == "fr", "decision")
        .when(F.col("lang") == "de", "failure").otherwise("procedure").alias("kind"),
        "namespace", "lang", "source_path", "content_hash", "n_chars",
        F.when(n % 3 == 0, "superseded").when(n % 7 == 0, "source_stale").otherwise("current").alias("status"),
        F.when(n >= 6000, "authoritative").when(n >= 2000, "curated").when(n >= 500, "source_material")
        .otherwise("derived").alias("authority_level"),
        "text")


def supersessions(t: Tables) -> DataFrame:
    """(src, dst): src supersedes dst. A record holds at most 100 versions, so the window groups are bounded."""
    w = W.partitionBy("record_id").orderBy("doc_id")
    r = records(t).select("rvid", "record_id", "doc_id", "lang")
    pairs = r.select(
        F.array(F.lead("rvid").over(w), F.when(F.col("lang") == "fr", F.lead("rvid", 2).over(w))).alias("srcs"),
        F.col("rvid").alias("dst"))
    return pairs.select(F.explode("srcs").alias("src"), "dst").filter("src IS NOT NULL")


def markdown(t: Tables) -> DataFrame:
    c = F.col("text")
    for pattern, mark in ((r"(?m)^([^\n]{31,60})$", "### $1"), (r"(?m)^([^\n]{13,30})$", "## $1"),
                          (r"(?m)^([^\n]{1,12})$", "# $1")):
        c = F.regexp_replace(c, pattern, mark)
    return t.documents.select("doc_id", c.alias("text"))
