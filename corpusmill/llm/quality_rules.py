"""Quality rules as weak supervision.

Nine rules look at a text; each votes good or bad or abstains. Expectation-maximisation over the corpus estimates how each
rule votes on good and on bad texts, and the share of good texts, from the votes alone; the posterior probability of good
decides, instead of asking that all rules pass. Texts that fail the hard rules are evidence for the estimates like all others. Two hard rules stay before it: fewer than ``min_words`` words, or more than
half of the words in repeated three-word windows.

Words are runs of other characters than blank, tab, newline, vertical tab, form feed and carriage return. Null text is an
empty one: no words, failed. Repeated rows get equal verdicts; other columns don't matter. Without texts the rules keep
the vote shares assumed at the start. Everything is column expressions; the votes of all texts are summed to at most 3^9 patterns, and
only those reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import let, stored

_SPACES = " \t\n\x0b\x0c\r"
_SPACE = r"[\x20\x09-\x0D]+"
#: A whole word of letters, with a quote, a bracket and one mark around it at most.
_PLAIN = r"(?<![^\x20\x09-\x0D])[(\"'“„«]?\p{L}[\p{L}\p{M}'’-]*+[)\"”»]?[.,;:!?]?[)\"”»]?(?![^\x20\x09-\x0D])"


def _repeated(words: Column) -> Column:
    """Words that three-word windows cover which are in the text twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))

    def places(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: F.coalesce(x.w == F.get(s, j - 1).w, F.lit(False)) | F.coalesce(x.w == F.get(s, j + 1).w, F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x.i))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1), x + 3) - x)), F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(let(F.sort_array(windows), places), covered))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_ends, n_calls, n_bars, n_plain)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    inner = F.btrim(text, F.lit(_SPACES))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPACE))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    of_words = let(words, lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("word_chars"),
        _repeated(w).cast("bigint").alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("bigint")

    rows = docs.select(F.col(id_col).alias("id"), of_words.alias("w"), of_lines.alias("l"), count(r"[#*$%&|<>]").alias("n_symbols"), count(r"[A-Z]").alias("n_capitals"),
                       count(r"[.!?]+(?=[\x20\x09-\x0D]|$)").alias("n_ends"), count(r"!").alias("n_calls"), count(r"\|").alias("n_bars"), count(_PLAIN).alias("n_plain"))
    return rows.select("id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_capitals", "n_ends", "n_calls", "n_bars", "n_plain")


def _vote(bad: str, good: str) -> Column:
    """-1 bad, 1 good, 0 abstains."""
    return F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0)


#: Rules by name: what is bad, what is good. Otherwise they abstain. That a defect is absent says little about a text, so rules
#: that look for one never vote good; an empty text gets no vote.
RULES = {
    "symbols": ("n_symbols * 100 > word_chars * 5", "false"),
    "capitals": ("n_capitals * 100 > word_chars * 30", "false"),
    "duplicate_lines": ("n_dup_lines > 1 and n_dup_lines * 100 > n_lines * 30", "false"),
    "repeats": ("n_repeat_words * 100 > n_words * 30", "false"),
    "exclamations": ("n_calls * 100 > n_words * 20", "false"),
    "bars": ("n_bars * 100 > n_words * 20", "false"),
    "word_length": ("word_chars > n_words * 14 or word_chars < n_words * 2", "n_words > 0 and word_chars between n_words * 3 and n_words * 9"),
    "sentence_ends": ("n_ends * 100 > n_words * 50 or n_words > 100 and n_ends * 200 < n_words", "n_ends * 100 between n_words * 2 and n_words * 25"),
    "plain_words": ("n_plain * 100 < n_words * 50", "n_words > 0 and n_plain * 100 >= n_words * 80"),
}


#: What is assumed of every rule before texts are seen: shares of bad votes, abstentions and good votes on bad and on good texts.
START = ((0.4, 0.4, 0.2), (0.02, 0.3, 0.68))


def _evidence(tables: list, most: float) -> list[dict[int, float]]:
    """Log odds that each vote adds. A rule keeps its sense, abstaining says nothing, and no rule decides alone."""
    ratio = [[math.log(g / b) for b, g in zip(*t)] for t in tables]
    return [{-1: max(-most, min(0.0, r[0])), 0: 0.0, 1: min(most, max(0.0, r[2]))} for r in ratio]


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 100, start: float = 0.8, most: float = 4.6) -> tuple[float, list, list[dict[int, float]]]:
    """(share of good texts, vote shares of each rule on bad and on good texts, log odds that each vote adds) by
    expectation-maximisation over counted vote patterns. Vote shares are kept per class, so a rule that says good of nearly every
    text, bad ones included, adds next to nothing. Counts are smoothed by ten texts that vote as assumed."""
    share, tables = start, [START] * rules
    for _ in range(rounds):
        odds = _evidence(tables, most)
        total, good = 10.0, 10.0 * start
        seen = [[[10.0 * x for x in y] for y in START] for _ in range(rules)]
        for votes, n in patterns:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, math.log(share / (1 - share)) + sum(o[v] for o, v in zip(odds, votes))))))
            total, good = total + n, good + n * p
            for j, v in enumerate(votes):
                seen[j][0][v + 1] += n * (1 - p)
                seen[j][1][v + 1] += n * p
        share, tables = min(0.99, max(0.01, good / total)), [tuple(tuple(x / sum(y) for x in y) for y in s) for s in seen]
    return share, tables, _evidence(tables, most)


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, **options) -> tuple[float, list[float]]:
    """(share of good texts, accuracy of each rule: how often it is right when it votes)."""
    share, tables, _ = fit(patterns, rules, **options)
    right = [share * g[2] + (1 - share) * b[0] for b, g in tables]
    return share, [r / (r + share * g[0] + (1 - share) * b[2]) for r, (b, g) in zip(right, tables)]


def judge(docs: DataFrame, min_words: int = 50, repeat_percent: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures, base_failed, score (posterior of good) and kept, for each row."""
    votes = [_vote(*rule).alias(f"v_{name}") for name, rule in RULES.items()]
    rows = stored(measures(docs, id_col, text_col).select("*", *votes), "measures")
    names = [f"v_{name}" for name in RULES]
    counted = [(tuple(r[:-1]), r[-1]) for r in rows.groupBy(*names).count().collect()]        # at most 3 ** len(RULES) rows
    share, _, odds = fit(sorted(counted), len(names))
    adds = [F.when(F.col(n) < 0, o[-1]).when(F.col(n) > 0, o[1]).otherwise(0.0) for n, o in zip(names, odds)]
    logit = sum(adds, F.lit(math.log(share / (1 - share))))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent)
    out = rows.withColumn("base_failed", failed).withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0.5))
