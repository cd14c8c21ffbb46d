"""Runs of repeated words: maximal stretches with a period, by suffix trees and Lyndon roots.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) and of at least ``least`` words (24) and
``times`` periods (3), that no neighbouring word extends. Per text:

1. A run holds a series of words twice, q apart, that is as long as the run less one period: 16 words at least. Only stretches covered by
   series of 16 words that the text repeats are searched; every run lies in one of them whole.
2. Of a stretch and of its reversal Ukkonen's suffix tree is built; an Euler tour gives the depth of the lowest common ancestor of two
   leaves as a range minimum, so the longest common extension of two places, forwards or backwards, takes constant time.
3. The longest Lyndon word at each place, in the order of the symbols and in its inverse, ends where the next smaller suffix starts. Every run has
   such a word as a root (in one of the two orders); each is extended both ways and kept if it is long enough.

All steps take time and memory in proportion to the stretch (the range minima: times its logarithm). Words are ``[^\\x20\\x09-\\x0D]+``.
A null or empty text has no words and no runs. Rows are independent of each other: ids may be null or repeated, other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.llm.common import append_columns, fresh, scramble

LEAST, TIMES = 24, 3
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


class SuffixTree:
    """Ukkonen's tree of a list of symbols >= 0. ``rank``: each suffix's place in order (a suffix sorts before those it is a prefix of);
    ``common(i, j)``: for arrays of different places, how many symbols the suffixes share."""

    def __init__(self, symbols: list[int]):
        text = [x + 1 for x in symbols] + [0]
        self.n, wide = len(text), max(text) + 1
        start, stop, link, parent, edge = [0], [0], [0], [0], {}
        far = self.n
        node = length = left = at = 0
        for i, c in enumerate(text):
            left += 1
            linked = 0
            while left:
                if not length:
                    at = i
                key = node * wide + text[at]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(start)
                    start.append(i)
                    stop.append(far)
                    link.append(0)
                    parent.append(node)
                    if linked:
                        link[linked] = node
                    linked = node
                else:
                    size = min(stop[child], i + 1) - start[child]
                    if length >= size:
                        at += size
                        length -= size
                        node = child
                        continue
                    if text[start[child] + length] == c:
                        length += 1
                        if linked:
                            link[linked] = node
                        break
                    inner = len(start)
                    begin = start[child]
                    start += [begin, i]
                    stop += [begin + length, far]
                    link += [0, 0]
                    parent += [node, inner]
                    edge[key] = inner
                    start[child] = begin + length
                    parent[child] = inner
                    edge[inner * wide + c] = inner + 1
                    edge[inner * wide + text[begin + length]] = child
                    if linked:
                        link[linked] = inner
                    linked = inner
                left -= 1
                if not node and length:
                    length -= 1
                    at = i - left + 1
                else:
                    node = link[node]
        first = np.array(text)[np.array(start)]
        self.start, self.stop, self.parent = start, stop, parent
        self.tour(first)
        self.first = first

    def _leaves(self, first: np.ndarray) -> tuple[list[int], list[int]]:
        """Euler tour, children by ``first``: the suffixes in order, and the least depth passed between each and the one before it."""
        parent, count = np.array(self.parent), len(self.start)
        order = 1 + np.lexsort((first[1:], parent[1:]))
        begin = np.searchsorted(parent[order], np.arange(count + 1)).tolist()
        order, start, stop, n = order.tolist(), self.start, self.stop, self.n
        places, between = [], []
        stack, depth, low = [0], [0], 0
        cursor = begin[:-1]
        while stack:
            node = stack[-1]
            here = depth[-1]
            if here < low:
                low = here
            k = cursor[node]
            if k < begin[node + 1]:
                cursor[node] = k + 1
                child = order[k]
                if stop[child] == n:
                    places.append(n - here - (n - start[child]))
                    between.append(low)
                    low = here
                else:
                    stack.append(child)
                    depth.append(here + stop[child] - start[child])
            else:
                stack.pop()
                depth.pop()
        return places, between

    def tour(self, first: np.ndarray) -> None:
        places, between = self._leaves(first)
        self.rank = np.empty(self.n, np.int64)
        self.rank[places] = np.arange(self.n)
        self.minima = [np.array(between, np.int32)]
        step = 1
        while 2 * step <= self.n:
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def inverse_rank(self) -> np.ndarray:
        """Places in the order of inverse symbols, the end of the text still smaller than all of them."""
        places, _ = self._leaves(np.where(self.first == 0, 0, self.first.max() + 1 - self.first))
        out = np.empty(self.n, np.int64)
        out[places] = np.arange(self.n)
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.floor(np.log2(b - a)).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][a[at]], self.minima[k][b[at] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For each suffix where the next smaller one starts: the longest Lyndon word at a place ends there."""
    ranks = rank.tolist()
    out, stack = [0] * len(ranks), []
    for i in range(len(ranks) - 1, -1, -1):
        r = ranks[i]
        while stack and ranks[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1] if stack else len(ranks) - 1
        stack.append(i)
    return np.array(out)


def stretch_runs(symbols: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of a list of symbols."""
    n = len(symbols)
    tree, mirror = SuffixTree(symbols.tolist()), SuffixTree(symbols[::-1].tolist())
    found = []
    for rank in (tree.rank, tree.inverse_rank()):
        i = np.arange(n)
        j = next_smaller(rank)[:n]
        i, j = i[j < n], j[j < n]
        end = j + tree.common(i, j)
        start = i - mirror.common(n - i, n - j)
        keep = end - start >= np.maximum(least, times * (j - i))
        found.append(np.stack([start, end - start, j - i], 1)[keep])
    return np.unique(np.concatenate(found), axis=0)


def word_runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period. ``times`` is 2 at least."""
    none = np.zeros((0, 3), np.int64)
    series = max(1, least - least // times)
    if len(words) < least:
        return none
    number: dict = {}
    symbols = np.array([number.setdefault(w, len(number)) for w in words])
    if len(number) == len(words):
        return none
    value, have = scramble(symbols.astype(np.uint64)), 1
    while have < series:
        step = min(have, series - have)
        value = scramble(value[:-step] * np.uint64(3) + value[step:])
        have += step
    order = np.argsort(value, kind="stable")
    same = value[order][1:] == value[order][:-1]
    if not same.any():
        return none
    again = np.zeros(len(words) + 1, np.int64)
    hit = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    np.add.at(again, hit, 1)
    np.add.at(again, hit + series, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(again) > 0).astype(np.int8), [0]])))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        if b - a >= least:
            _, part = np.unique(symbols[a:b], return_inverse=True)
            runs = stretch_runs(part, least, times)
            runs[:, 0] += a
            out.append(runs)
    return np.concatenate([none, *out])


def find_runs(docs: DataFrame, text_col: str = "text", name: str = "runs", collapsed_name: str = "collapsed", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """The rows with ``name``, the runs (start, length, period; words from 0) by start, then period, and ``collapsed_name``, the words that no run
    contains after its first period, joined by one blank. Names that are taken get underscores before them."""
    name, collapsed_name = fresh(docs, name, collapsed_name)

    def work(texts):
        runs, rest = [], []
        for text in texts.to_pylist():
            words = (text or "").encode().split()                   # bytes split at these six characters only
            found = word_runs(words, least, times)
            runs.append(found)
            if len(found):
                kept = np.ones(len(words), bool)
                for start, length, period in found.tolist():
                    kept[start + period:start + length] = False
                words = [words[k] for k in np.flatnonzero(kept).tolist()]
            rest.append(b" ".join(words))
        flat = np.concatenate([np.zeros((0, 3), np.int64), *runs])
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        fields = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        return [pa.ListArray.from_arrays(pa.array(offsets), fields), pa.array(rest, pa.binary()).cast(pa.string())]

    return append_columns(docs, [text_col], [T.StructField(name, RUNS), T.StructField(collapsed_name, T.StringType())], lambda: work)
