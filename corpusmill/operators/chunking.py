"""1:N restructuring of documents. Each document is cut on its own, so nothing here shuffles except the outline."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What opens or closes a code fence, and what is a heading.
FENCE = r"^\s*(`{3,}|~{3,})"
HEADING = r"^(#{1,6})\s+(.*)$"
FENCE_RE, HEADING_RE = re.compile(FENCE), re.compile(HEADING)

CHUNK_SCHEMA = ("doc_id bigint, chunk_index bigint, start bigint, end bigint, section_path string, heading string, "
                "chunk_type string, text string")


def _cut_points(total: list[int], hard: list[int], soft: list[int], max_chars: int) -> list[tuple[int, int]]:
    """Half-open line ranges: each closes on its first allowed line that is full and blank, or twice full.

    ``total`` is the running size; ``hard`` lists the lines where a cut is allowed at all, ``soft`` the blank ones of them.
    """
    out, begin, used = [], 0, 0
    while begin < len(total):
        stops = []
        for allowed, need in ((soft, max_chars), (hard, 2 * max_chars)):
            k = bisect_left(allowed, max(begin, bisect_left(total, used + need)))
            stops += allowed[k:k + 1]
        stop = min(stops, default=len(total) - 1)
        out.append((begin, stop + 1))
        begin, used = stop + 1, total[stop]
    return out


def _section_bounds(bare: list[str], sep: str) -> list[tuple[int, str | None, str | None]]:
    """(first line, breadcrumb, heading) per section; headings inside fences do not count."""
    bounds: list[tuple[int, str | None, str | None]] = [(0, None, None)]
    fenced, trail = False, {}
    for i, line in enumerate(bare):
        if FENCE_RE.match(line):
            fenced = not fenced
        elif not fenced and (m := HEADING_RE.match(line)):
            level, title = len(m[1]), m[2].strip().rstrip("#").strip()
            trail = {k: v for k, v in trail.items() if k < level} | {level: title}
            bounds.append((i, sep.join(trail[k] for k in sorted(trail)), title))
    return bounds[1:] if len(bounds) > 1 and bounds[1][0] == 0 else bounds


def _emit(doc_id: int, text: str, sections: bool, max_chars: int, sep: str) -> list[tuple]:
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    bare = [s.rstrip("\r\n") for s in lines]
    offset = [0, *accumulate(len(s.encode("utf-8")) for s in lines)]
    bounds = _section_bounds(bare, sep) if sections else [(0, None, None)]
    out: list[tuple] = []
    for (lo, path, heading), hi in zip(bounds, [b[0] for b in bounds[1:]] + [len(lines)]):
        total = list(accumulate(map(len, lines[lo:hi])))
        fences = accumulate(bool(FENCE_RE.match(s)) for s in bare[lo:hi])
        hard = [i for i, n in enumerate(fences) if n % 2 == 0]
        soft = [i for i in hard if not bare[lo + i].strip()]
        for begin, end in _cut_points(total, hard, soft, max_chars):
            body = "".join(lines[lo + begin: lo + end])
            if body.strip():
                out.append((doc_id, len(out), offset[lo + begin], offset[lo + end], path, heading,
                            "markdown_section" if sections else "text_block", body))
    return out


def _chunks(docs: DataFrame, sections: bool, max_chars: int, sep: str) -> DataFrame:
    names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for d, text in zip(batch["doc_id"], batch["text"]) if text
                    for r in _emit(d, text, sections, max_chars, sep)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return docs.select("doc_id", "text").mapInPandas(cut, CHUNK_SCHEMA)


def chunk_blocks(docs: DataFrame, max_chars: int = 1200) -> DataFrame:
    """Whole-line blocks with exact byte spans; never cut inside a fence; blank blocks dropped."""
    return _chunks(docs, False, max_chars, "")


def chunk_sections(docs: DataFrame, max_chars: int = 1200, sep: str = " / ") -> DataFrame:
    """Heading sections (outside fences) with breadcrumb, then blocks inside each section."""
    return _chunks(docs, True, max_chars, sep)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no from 0, line, n_lines), newline excluded. Row-local explode."""
    parts = F.split("text", "\n")
    return docs.select("doc_id", F.size(parts).cast("bigint").alias("n_lines"), F.posexplode(parts).alias("_p", "line")).select(
        "doc_id", F.col("_p").cast("bigint").alias("line_no"), "line", "n_lines")


def chunk_paragraphs(docs: DataFrame) -> DataFrame:
    """Blank-line separated paragraphs with a 1-based line label and byte span.

    Stays inside the row: an array of line structs is numbered by a fold over blank flags, so a huge document costs
    one task its own size and no shuffle. A document without any paragraph yields one '(document)' chunk.
    """
    parts = F.split("text", "\n")
    blank = F.transform("_l", lambda s: F.trim(F.regexp_replace(s, r"\s+", "")) == "")
    # start positions (1-based) of paragraphs: non-blank lines whose predecessor is blank or absent
    base = docs.withColumn("_l", parts).withColumn("_b", blank)
    n = F.size("_l")
    pos = F.sequence(F.lit(1), n)
    is_text = lambda i: ~F.element_at("_b", i)
    prev_blank = lambda i: F.when(i == 1, F.lit(True)).otherwise(F.element_at("_b", F.greatest(i - 1, F.lit(1))))
    next_blank = lambda i: F.when(i == n, F.lit(True)).otherwise(F.element_at("_b", F.least(i + 1, n)))
    base = (
        base.withColumn("_s", F.filter(pos, lambda i: is_text(i) & prev_blank(i)))
        .withColumn("_e", F.filter(pos, lambda i: is_text(i) & next_blank(i)))
    )
    spans = base.withColumn("_n_bytes", F.octet_length("text").cast("bigint")).select(
        "doc_id", "text", "_l", "_n_bytes",
        F.posexplode_outer(F.arrays_zip("_s", "_e")).alias("_i", "_se"))
    first, last = F.col("_se._s"), F.col("_se._e")
    before = F.octet_length(F.array_join(F.slice("_l", F.lit(1), first - 1), "\n")) + F.when(first > 1, 1).otherwise(0)
    seg = F.array_join(F.slice("_l", first, last - first + 1), "\n")
    inner_end = before + F.octet_length(seg) + F.when(last < F.size("_l"), 1).otherwise(0)
    return spans.select(
        "doc_id", F.coalesce("_i", F.lit(0)).cast("bigint").alias("chunk_index"),
        F.coalesce(F.concat(F.lit("(lines "), first, F.lit("-"), last, F.lit(")")), F.lit("(document)")).alias("span_label"),
        F.coalesce(before, F.lit(0)).cast("bigint").alias("start"),
        F.coalesce(inner_end, F.col("_n_bytes")).cast("bigint").alias("end"),
        F.trim(F.coalesce(seg, F.col("text"))).alias("text"))


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, title, start byte, n_bytes) of the headings outside fences; a fence is closed by its own kind of
    mark only. One pass over each text, and no line leaves its row."""
    names = ["doc_id", "line_no", "level", "title", "start", "n_bytes"]

    def scan(doc_id: int, text: str) -> Iterator[tuple]:
        at, opened, size = 0, None, len(text.encode())
        for i, line in enumerate(text.split("\n")):
            if fence := FENCE_RE.match(line):
                kind = fence[1][0]
                opened = {None: kind, kind: None}.get(opened, opened)
            elif opened is None and (m := HEADING_RE.match(line)):
                yield doc_id, i, len(m[1]), m[2].strip(), at, size
            at += len(line.encode()) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for d, text in zip(batch["doc_id"], batch["text"]) for r in scan(d, text)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    some = docs.filter(F.col("text").rlike("(?m)^#"))
    return some.select("doc_id", "text").mapInPandas(run, "doc_id bigint, line_no bigint, level bigint, title string, start bigint, n_bytes bigint")


def outline(docs: DataFrame, sep: str = " > ") -> DataFrame:
    """Nested sections: a span runs to the next heading of the same or a higher level, or to the end.

    Two running windows per document, both with a growing frame (linear), instead of a self-join of headings.
    """
    h = headings(docs)
    later = W.partitionBy("doc_id").orderBy(F.col("line_no").desc()).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy("doc_id").orderBy("line_no")
    upto = earlier.rowsBetween(W.unboundedPreceding, 0)
    cols, level = [], F.col("level")
    for k in range(1, 7):
        h = h.withColumn(f"_n{k}", F.min(F.when(level <= k, F.col("start"))).over(later))
    end = F.coalesce(*[F.when(level == k, F.col(f"_n{k}")) for k in range(1, 7)], F.col("n_bytes"))
    # last heading per level so far; it is an ancestor when no heading of an equal or higher level came after it
    for k in range(1, 7):
        h = h.withColumn(f"_a{k}", F.max(F.when(level == k, F.struct("line_no", "title"))).over(upto))
        cols.append(F.when((level >= k) & F.col(f"_a{k}").isNotNull(), F.struct(
            F.lit(k).alias("k"), F.col(f"_a{k}.line_no").alias("line_no"), F.col(f"_a{k}.title").alias("title"))))
    cand = F.array_compact(F.array(*cols))
    chain = F.filter(cand, lambda a: ~F.exists(cand, lambda b: (b["k"] < a["k"]) & (b["line_no"] > a["line_no"])))
    return h.select(
        "doc_id", (F.row_number().over(earlier) - 1).cast("bigint").alias("ordinal"), "line_no", "level", "title",
        F.array_join(F.transform(chain, lambda a: a["title"]), sep).alias("section_path"),
        F.col("start").cast("bigint").alias("start"), end.cast("bigint").alias("end"))


def extract_facts(docs: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, kind, name, line from 1, start, end): every line-anchored pattern match, patterns compiled to columns."""
    any_hit = F.lit(False)
    for _, p in patterns:
        any_hit = any_hit | F.col("line").rlike(p)
    found = lines_with_offsets(docs).filter(any_hit)
    kinds = F.array(*[F.when(F.col("line").rlike(p), F.struct(
        F.lit(k).alias("kind"), F.regexp_extract("line", p, 1).alias("name"))) for k, p in patterns])
    return found.select("doc_id", "line_no", "start", "end", F.inline(F.array_compact(kinds))).select(
        "doc_id", "kind", "name", (F.col("line_no") + 1).alias("line"), "start", "end")


def lines_with_offsets(docs: DataFrame) -> DataFrame:
    """Lines with their byte span [start, end), end including the newline when there is one."""
    w = W.partitionBy("doc_id").orderBy("line_no")
    rows = lines_of(docs)
    stop = F.sum(F.octet_length("line").cast("bigint") + 1).over(w)
    return rows.withColumn("_stop", stop).select(
        "doc_id", "line_no", "line", (F.col("_stop") - F.octet_length("line") - 1).alias("start"),
        F.when(F.col("line_no") == F.col("n_lines") - 1, F.col("_stop") - 1).otherwise(F.col("_stop")).alias("end"))


def doc_summary(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """Section count, joined titles in order, line and byte counts; documents without sections are kept."""
    agg = sections.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sections"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "title"))), lambda s: s["title"]), " | ")
        .alias("titles"))
    return docs.select(
        "doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
        F.octet_length("text").cast("bigint").alias("n_bytes")
    ).join(agg, "doc_id", "left").select(
        "doc_id", "n_lines", "n_bytes", F.coalesce("sections", F.lit(0)).cast("bigint").alias("sections"),
        F.coalesce("titles", F.lit("")).alias("titles"))


def parse_table_rows(lines: DataFrame, columns: list[str], markers: dict[str, str]) -> DataFrame:
    """Markdown table rows -> one column per cell, plus a field per bracket marker found in the last cell."""
    row = r"^\|" + r"([^|]*)\|" * (len(columns) - 1) + r"(.*?)\|\s*$"
    out = lines.filter(F.col("line").rlike(row))
    for i, name in enumerate(columns, 1):
        out = out.withColumn(name, F.trim(F.regexp_extract("line", row, i)))
    for name, pattern in markers.items():
        got = F.regexp_extract(columns[-1], pattern, 1)
        out = out.withColumn(name, F.when(got != "", got))
    return out
