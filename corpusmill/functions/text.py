"""Text expressions: normalisers, tokenisers, token estimates, snippets, term and literal derivation (all Columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the three tokenisers.
LEX_STOPWORDS = (
    "a an and are as at be been before but by can do does each for from had has have how i if in into is it its "
    "may must not of on once one or so some than that the their then there these this to up was we what when which "
    "who will with you your"
).split()
DESC_STOPWORDS = (
    "the a an and or of to in on for is are was were be this that it as at by with from we you i"
).split()
TERM_STOPWORDS = (
    "a an the and or of to in on for with without into onto from by at as is are be been being this that these those "
    "it its it's do does did done can could should would may might will shall must not no yes if then else when while "
    "what which who whom whose how why where i we you he they she them us our your their my me build make made get got "
    "please want need help using use used about over under out up down more most some any all each via per your you're"
).split()


# Whitespace as Unicode sees it, spelled so that Java and RE2 agree.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
NON_WS = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"


def norm_path(c: Column) -> Column:
    """Backslashes to slashes, then every leading './' removed."""
    return F.regexp_replace(F.regexp_replace(c, r"\\", "/"), r"^(\./)+", "")


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def fold_eol(c: Column) -> Column:
    """Drop a byte-order mark and fold CRLF / CR to LF, so the same text hashes equally on every platform."""
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), r"\r\n?", "\n")


def content_hash(c: Column) -> Column:
    return F.sha2(fold_eol(c), 256)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def tokens_lex(c: Column) -> Column:
    """Lower-case [a-z0-9]+ runs minus the lexical stopwords; duplicates kept."""
    return F.filter(_all(F.lower(c), "[a-z0-9]+"), lambda t: ~t.isin(*LEX_STOPWORDS))


def tokens_desc(c: Column) -> Column:
    """[A-Za-z0-9_]+ runs of length two or more, lower-cased, minus the descriptor stopwords."""
    return F.filter(
        F.transform(_all(c, "[A-Za-z0-9_]+"), lambda t: F.lower(t)),
        lambda t: (F.length(t) >= 2) & ~t.isin(*DESC_STOPWORDS),
    )


def tokens_word(c: Column) -> Column:
    r"""Unicode \w+ runs in original case; every one of them is required by the all-terms search."""
    return _all(c, r"[\p{L}\p{N}_]+")


def est_tokens(c: Column, method: str) -> Column:
    """ceil4 = ceil(chars/4); floor4 = max(1, chars div 4); words = whitespace separated words."""
    if method == "ceil4":
        return F.ceil(F.length(c) / F.lit(4)).cast("bigint")
    if method == "floor4":
        return F.greatest(F.lit(1), F.floor(F.length(c) / F.lit(4))).cast("bigint")
    if method == "words":
        return F.size(_all(c, NON_WS + "+")).cast("bigint")
    raise ValueError(method)


def snippet(text: Column, terms: Column, width: int = 120) -> Column:
    """Window around the first listed term that occurs; head of the text when none does."""
    low = F.lower(text)
    hits = F.filter(F.transform(terms, lambda t: F.instr(low, F.lower(t))), lambda p: p > 0)
    pos = F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(0))
    start = F.greatest(F.lit(0), pos - 1 - width)
    end = F.least(F.length(text), pos - 1 + width)
    around = F.concat(
        F.when(start > 0, "...").otherwise(""),
        collapse_ws(F.substring(text, start + 1, end - start)),
        F.when(end < F.length(text), "...").otherwise(""),
    )
    head = F.concat(
        collapse_ws(F.substring(text, 1, 2 * width)),
        F.when(F.length(text) > 2 * width, "...").otherwise(""),
    )
    return F.when(text.isNull() | (F.length(text) == 0), "").when(pos > 0, around).otherwise(head)


def derive_terms(c: Column, cap: int = 12) -> Column:
    """Distinct salient terms in order of first occurrence: no stopwords, single letters or bare numbers."""
    kept = F.filter(
        _all(F.lower(c), "[a-z0-9][a-z0-9_+#-]*"),
        lambda t: (F.length(t) >= 2) & ~t.isin(*TERM_STOPWORDS) & ~t.rlike("^[0-9]+$"),
    )
    return F.slice(F.array_distinct(kept), 1, cap)


def derive_literals(c: Column, cap: int = 6) -> Column:
    """Quoted phrases, decision ids, #numbers and dotted ids, in that order, first occurrence kept."""
    quoted = F.transform(_all(c, '"([^"]{2,80})"', 1), lambda t: collapse_ws(t))
    decisions = F.transform(_all(c, r"(?iU)\bD-[0-9]{3,5}\b"), lambda t: F.upper(t))
    refs = _all(c, r"(?U)#[0-9]{1,4}\b")
    dotted = F.transform(_all(c, r"(?iU)\b[a-z][a-z0-9]*\.[a-z][a-z0-9.]*[a-z0-9]\b"), lambda t: F.lower(t))
    found = F.filter(F.concat(quoted, decisions, refs, dotted), lambda t: F.length(t) > 0)
    return F.slice(F.array_distinct(found), 1, cap)
