"""Line dedup by site-relative frequency: lines that more than a given share of a host's pages contain are boilerplate.

A line is compared without the blanks, tabs and carriage returns around it; lines with nothing else are neither counted nor
dropped. A line counts once per page. It is dropped from the pages of a host that has it on at least ``min_pages`` pages
and on more than ``max_percent`` per cent of its pages. With ``long_percent`` that lower ratio holds for lines of ``long_words``
words and more, which do not repeat by chance as short ones do. What stays is joined by newlines as it was.

Null text stays null; a null host counts as the host ''. Every row is a page, also one that repeats another. An empty
table gives an empty table; columns besides the host's and the text's don't matter.

A host's pages are never gathered: pages and lines are counted with partial sums, and the boilerplate of a host is short,
as each of its lines is on more than the lower ratio's per cent of the pages (at most 100 / ratio times the mean
number of lines). It is written first, so that Spark knows its size when it chooses how to bring it to the pages; where it
must shuffle, adaptive execution splits hot hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh, stored

_EDGES = " \t\r"


def _hash(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(pages: DataFrame, max_percent: int = 10, min_pages: int = 4, text_col: str = "text", host_col: str = "source",
                long_percent: int | None = None, long_words: int = 5) -> DataFrame:
    """(host, line hash a and b, pages with the line, pages of the host) of the lines to drop."""
    base = pages.select(F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    total = base.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = base.select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_EDGES))))).alias("line")).filter("line <> ''")
    is_long = F.lit(False) if long_percent is None else F.size(F.split("line", "[ \\t]+")) >= long_words
    count = lines.select("host", _hash(F.col("line")).alias("h"), is_long.alias("long")).groupBy("host", "h.a", "h.b", "long").agg(F.count(F.lit(1)).alias("line_pages"))
    ratio = F.lit(max_percent) if long_percent is None else F.when(F.col("long"), F.lit(long_percent)).otherwise(F.lit(max_percent))
    return count.filter(F.col("line_pages") >= min_pages).join(total, "host").filter(F.col("line_pages") * 100 > F.col("host_pages") * ratio).drop("long")


def drop_boilerplate(pages: DataFrame, max_percent: int = 10, min_pages: int = 4, text_col: str = "text", host_col: str = "source",
                     dropped_name: str | None = None, long_percent: int | None = None, long_words: int = 5) -> DataFrame:
    """The pages without their hosts' boilerplate; with ``dropped_name`` also how many lines each page lost."""
    host, drop, keep = fresh(pages, "host_of_page", "lines_to_drop", "lines_kept")
    found = boilerplate(pages, max_percent, min_pages, text_col, host_col, long_percent, long_words)
    per_host = stored(found.groupBy("host").agg(F.collect_list(F.struct("a", "b")).alias("lines")), "boilerplate") \
        .select(F.col("host").alias(host), F.col("lines").alias(drop))
    keyed = pages.withColumn(host, F.coalesce(F.col(host_col).cast("string"), F.lit("")))
    lines = F.split(text_col, "\n")
    kept = F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(drop), _hash(F.btrim(x, F.lit(_EDGES))))))
    out = keyed.join(per_host, host, "left").withColumn(keep, kept)
    cols = [F.array_join(keep, "\n").alias(text_col) if c == text_col else F.col(f"`{c}`") for c in pages.columns]
    if dropped_name:
        cols.append((F.coalesce(F.size(lines), F.lit(0)) - F.coalesce(F.size(F.col(keep)), F.lit(0))).cast("bigint").alias(dropped_name))
    return out.select(*cols)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS ls FROM documents),
pages AS (SELECT host, count(*) AS host_pages FROM d GROUP BY host),
l AS (SELECT host, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS line FROM d),
n AS (SELECT host, line, count(*) AS line_pages FROM l WHERE line <> '' GROUP BY host, line),
b AS (SELECT host, list(line) AS bad FROM n JOIN pages USING (host)
      WHERE line_pages >= 4 AND line_pages * 100 > host_pages * 10 GROUP BY host),
k AS (SELECT d.*, CASE WHEN b.bad IS NULL THEN ls
      ELSE list_filter(ls, lambda x: NOT list_contains(b.bad, trim(x, ' ' || chr(9) || chr(13)))) END AS kept
      FROM d LEFT JOIN b USING (host))
SELECT doc_id, array_to_string(kept, chr(10)) AS text, CAST(coalesce(len(ls), 0) - coalesce(len(kept), 0) AS BIGINT) AS n_dropped FROM k
"""
