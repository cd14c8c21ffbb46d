"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

A suffix is of the smaller type (S) if the suffix after it is greater, else of the larger type (L). Leftmost S suffixes (an L
stands before them) are sorted by their substrings, which are named and, where names repeat, sorted as a shorter text by the same
procedure. From them the order of all L suffixes follows in one pass over the buckets of first symbols, and from those the S ones.

``_Pass`` is that pass. It takes as many buckets at once as don't feed each other, and unrolls the repetition of a bucket's
own symbol, so each of its steps is a few array operations. The S pass is the same one over the complement of the symbols.
"""

from __future__ import annotations

import numpy as np


def _smaller(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of the S type. The last symbol is a unique smallest one."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32)))
    at = np.flatnonzero(step)
    out = np.ones(n, bool)
    out[:-1] = step[at[np.searchsorted(at, np.arange(n - 1))]] > 0
    return out


def _chunks(low: np.ndarray) -> list[int]:
    """Cuts between buckets such that none of a chunk's buckets is fed by another one of it. ``low``: the smallest bucket that each
    bucket feeds, itself left out."""
    cuts, least = [0], len(low)
    for b, x in enumerate(low.tolist()):
        if b >= least:
            cuts.append(b)
            least = len(low)
        if x < least:
            least = x
    return [*cuts, len(low)]


class _Pass:
    """Induction of all suffixes of the wanted type from sorted seeds of the other type. What does not depend on the seeds' order is
    found once: sizes of buckets, repetitions, and which buckets can be scanned together."""

    def __init__(self, key: np.ndarray, seeds: np.ndarray, wanted: np.ndarray):
        n, buckets = len(key), int(key.max()) + 1
        every = np.flatnonzero(wanted)
        self.key, self.size = key, len(every)
        self.head = np.zeros(buckets + 1, np.int64)
        np.cumsum(np.bincount(key[every], minlength=buckets), out=self.head[1:])
        self.seed_head = np.zeros(buckets + 1, np.int64)
        np.cumsum(np.bincount(key[seeds], minlength=buckets), out=self.seed_head[1:])
        same = np.zeros(n, bool)
        np.logical_and(wanted[:-1], wanted[1:], out=same[1:])
        same[1:] &= key[:-1] == key[1:]
        at = np.flatnonzero(same)                                              # how often the symbol repeats before, in wanted suffixes
        self.back = np.zeros(n, np.int32)
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            self.back[at] = at - np.repeat(at[first], np.diff(np.concatenate([first, [len(at)]]))) + 1
        self.feeds = np.zeros(n, bool)
        self.feeds[seeds] = True
        self.feeds |= wanted
        self.feeds[0] = False
        self.feeds[1:] &= wanted[:-1] & ~same[1:]
        source = np.flatnonzero(self.feeds)
        low = np.full(buckets, buckets, np.int64)
        if buckets < 1024:                                                     # few symbols: which of them stand side by side
            pair = np.flatnonzero(np.bincount(key[source].astype(np.int64) * buckets + key[source - 1]))
            of, to = pair[::-1] // buckets, pair[::-1] % buckets
        else:
            order = np.argsort(key[source - 1], kind="stable")[::-1]
            of, to = key[source][order], key[source - 1][order]
        low[of] = to                                                           # the smallest one comes last and stays
        self.cuts = _chunks(low)

    def run(self, seeds: np.ndarray) -> np.ndarray:
        """In scanning a bucket its wanted suffixes come before its seeds; the predecessor of each, if wanted, goes to the end of its own bucket."""
        key, head, seed_head, back, feeds = self.key, self.head, self.seed_head, self.back, self.feeds
        fill = head.copy()
        out = np.full(self.size, -1, np.int32)
        for a, b in zip(self.cuts, self.cuts[1:]):
            region, both = out[head[a]:head[b]], seeds[seed_head[a]:seed_head[b]]
            if len(region):
                first = region[region >= 0]
                if len(first) < len(region):
                    repeat = back[first]
                    which = np.repeat(np.arange(len(first)), repeat + 1)
                    times = np.arange(len(which)) - np.repeat(np.cumsum(repeat + 1) - repeat - 1, repeat + 1)
                    order = np.lexsort((times, key[first][which]))
                    region[:] = first[which[order]] - times[order]
                if len(both):
                    both = np.concatenate([region, both])
                    if b - a > 1:
                        both = both[np.argsort(key[both], kind="stable")]
                else:
                    both = region
            prior = both[feeds[both]] - 1
            if not len(prior):
                continue
            target = key[prior]
            order = np.argsort(target, kind="stable")
            prior, target = prior[order], target[order]
            begin = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
            size = np.diff(begin, append=len(target))
            head_of = target[begin]
            out[np.arange(len(target)) + np.repeat(fill[head_of] - begin, size)] = prior
            fill[head_of] += size
        return out


class _Order:
    """The order of all suffixes that sorted leftmost ones induce."""

    def __init__(self, text: np.ndarray, small: np.ndarray, left: np.ndarray):
        self.text, last = text, np.array([len(text) - 1], np.int32)
        rest = small.copy()
        rest[-1] = False
        self.last = last
        self.to_large = _Pass(text, left, ~small)
        self.to_rest = _Pass(text.max() - text, np.flatnonzero(~small), rest)

    def run(self, leftmost: np.ndarray, whole: bool = True) -> np.ndarray:
        """Without ``whole``, of the smaller type only."""
        large = self.to_large.run(leftmost)
        rest = self.to_rest.run(large[::-1])[::-1]
        if not whole:
            return np.concatenate([self.last, rest])
        both = np.concatenate([self.last, large, rest])
        return both[np.argsort(self.text[both], kind="stable")]


def _sorted(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols whose last one is 0 and stands nowhere else."""
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32)
    text = text.astype(np.uint16 if text.max() < 1 << 16 else np.int32)          # numpy sorts short numbers by digits
    small = _smaller(text)
    is_left = np.concatenate([[False], small[1:] & ~small[:-1]])
    left = np.flatnonzero(is_left).astype(np.int32)
    order = _Order(text, small, left)
    rough = order.run(left[np.argsort(text[left], kind="stable")], whole=False)
    placed = rough[is_left[rough]]
    length = np.ones(n, np.int64)                            # of the substring up to the next leftmost suffix, its first symbol included
    length[left[:-1]] = np.diff(left) + 1
    a, b = placed[:-1], placed[1:]
    new = length[a] != length[b]
    alike = np.flatnonzero(~new)
    if len(alike):
        size = length[a[alike]]
        begin = np.cumsum(size) - size
        step = np.arange(size.sum()) - np.repeat(begin, size)
        differs = text[np.repeat(a[alike], size) + step] != text[np.repeat(b[alike], size) + step]
        new[alike] = np.logical_or.reduceat(differs, begin)
    name = np.zeros(n, np.int32)
    name[placed[1:]] = np.cumsum(new)
    names = name[left]
    if names.max() + 1 < len(left):
        placed = left[_sorted(names)]
    return order.run(placed)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The starts of the suffixes of symbols >= 0 in order; a suffix sorts before those it is a prefix of."""
    return _sorted(np.concatenate([data.astype(np.int64) + 1, np.zeros(1, np.int64)]))[1:]


def permuted_common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each start, how many bytes its suffix shares with the one before it in order. Only where the bytes before the two differ is the number
    found by comparing (such numbers sum to n log n at most); elsewhere it is one less than at the start before."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    prior = np.full(n, -1, np.int64)
    prior[order[1:]] = order[:-1]
    at = np.arange(n)
    linked = (at > 0) & (prior > 0)
    follows = linked & (prior[at - 1] == prior - 1) & (data[at - 1] == data[np.maximum(prior - 1, 0)])
    found = np.flatnonzero(~follows)
    shared = np.zeros(n, np.int64)
    padded = np.concatenate([data.astype(np.uint8), np.zeros(8, np.uint8)])
    word = np.zeros(n + 1, np.uint64)
    for k in range(8):
        word |= padded[k:k + n + 1].astype(np.uint64) << np.uint64(8 * k)
    live = found[prior[found] >= 0]
    done = 0
    while len(live):
        a, b = live + done, prior[live] + done
        room = n - np.maximum(a, b)
        gap = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        low = gap & (~gap + np.uint64(1))
        same = np.where(gap == 0, 8, np.floor(np.log2(np.maximum(low, np.uint64(1)).astype(np.float64))).astype(np.int64) // 8)
        same = np.minimum(same, np.maximum(room, 0))
        shared[live] += same
        live = live[same == 8]
        done += 8
    base = np.maximum.accumulate(np.where(follows, 0, at))
    return np.where(follows, np.maximum(shared[base] - (at - base), 0), shared)
