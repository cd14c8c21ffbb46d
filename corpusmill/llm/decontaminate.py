"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared in lower case with each run of white space as one blank. An item of m characters may differ
by k = m * budget_percent // 100 edits. It is cut into k + 1 pieces of about equal length; where it occurs with at most k
edits, one piece at least occurs unchanged. An Aho-Corasick automaton finds the pieces in a text; each find gives a window,
and windows that hold enough of the item's four-letter strings (an occurrence always does) are verified with Myers'
bit-parallel distance. Overlapping windows of one item count as one and give their best match.

Null and empty texts match nothing; so do items of under ``min_chars`` characters, which would match by accident. Repeated
rows match alike. Texts are read whole, in one pass, without a shuffle. Items go to the tasks in blocks of at most
``block_chars`` characters, a block per pass, so the broadcast has a bound whatever the benchmark's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import append_columns, fresh

_GRAM = 4
MATCH = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def lower(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def normal(text: str | None) -> str:
    return " ".join(lower(text or "").split())


def myers(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to any substring of the text, and where the first such ends."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = at.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(across | plus))
        down = plus & across
        score += bool(up & high) - bool(down & high)
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best[0]:
            best = (score, j + 1)
    return best


class Matcher:
    """Items: (id, normalised text, budget)."""

    def __init__(self, items: list[tuple[int, str, int]]):
        self.items = items
        self.grams = [[t[i:i + _GRAM] for i in range(len(t) - _GRAM + 1)] for _, t, _ in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(items):
            cuts = [len(t) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(t[a:b], []).append((n, a))
        self.trie = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.trie.add_word(piece, (len(piece), places))
        if pieces:
            self.trie.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the matches, places in the text as it is."""
        if not text or not self.items:
            return []
        small = lower(text)
        flat = " ".join(small.split())
        begins: dict[int, set[int]] = {}
        for end, (size, places) in self.trie.iter(flat):
            for n, offset in places:
                begins.setdefault(n, set()).add(end - size + 1 - offset)
        out = []
        for n, starts in begins.items():
            ident, item, k = self.items[n]
            windows: list[list[int]] = []
            for s in sorted(starts):
                a, b = max(0, s - k), min(len(flat), s + len(item) + k)
                if windows and a < windows[-1][1] - k:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            for a, b in windows:
                window = flat[a:b]
                held = {window[i:i + _GRAM] for i in range(len(window) - _GRAM + 1)}
                if sum(map(held.__contains__, self.grams[n])) < len(item) - _GRAM + 1 - k * _GRAM:
                    continue
                distance, end = myers(item, window)
                if distance <= k:
                    size = myers(item[::-1], window[:end][::-1])[1]
                    out.append((ident, distance, a + end - size, a + end))
        if out and len(flat) != len(small):
            place = [m.start() for m in re.finditer(r"(?<=\S)\s+(?=\S)|\S", small)]
            place.append(place[-1] + 1)
            out = [(i, d, place[a], place[b]) for i, d, a, b in out]
        return sorted(out)


def blocks(items: DataFrame, budget_percent: int = 10, min_chars: int = 20, block_chars: int = 4_000_000, id_col: str = "item_id",
           text_col: str = "text") -> Iterator[list[tuple[int, str, int]]]:
    """The items in blocks, fetched a partition at a time; items with equal normalised texts all stay."""
    block, size = [], 0
    for row in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null").toLocalIterator():
        text = normal(row["text"])
        if len(text) < min_chars:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["id"], text, len(text) * budget_percent // 100))
        size += len(text)
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, text_col: str = "text", name: str = "leaks", **settings) -> DataFrame:
    """The rows and the matches of all items in each, as an array ``name`` of (item_id, distance, start, end)."""
    context, names, out = docs.sparkSession.sparkContext, [], docs
    for block in blocks(items, **settings):
        spread = context.broadcast(block)

        def start(spread=spread):
            matcher = Matcher(spread.value)
            return lambda texts: [pa.array([[dict(zip(MATCH.names, m)) for m in matcher.find(t.as_py())] for t in texts],
                                           pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))]

        names += fresh(out, f"leaks_{len(names)}")
        out = append_columns(out, [text_col], [T.StructField(names[-1], T.ArrayType(MATCH))], start)
    found = F.concat(*names) if names else F.array().cast(T.ArrayType(MATCH))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], found.alias(name))
