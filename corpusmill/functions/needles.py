"""Substring search of many needles at once over Arrow batches, in numpy.

The eight bytes at every place of a text are one number; a table of bits says which of these numbers begin a needle, so the cost of a
text hardly depends on how many needles there are. What passes is compared with the needle's last bytes and then as a whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])        # workers need not have this folder

#: Bytes of texts that are looked at together, and the bits of the table of beginnings.
SLICE, BITS = 1 << 20, 20
#: Added to the score where the path holds the needle.
PATH = 100
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    return ((numbers ^ (numbers >> np.uint64(29))) * _MIX) >> np.uint64(64 - BITS)


class Needles:
    """A set of needles (bytes, none empty), grouped by how many bytes their beginning has: eight, or all of a shorter one."""

    def __init__(self, needles: list[bytes]):
        self.needles = needles
        self.length = np.array([len(n) for n in needles], np.int64)
        start = np.frombuffer(b"".join(n[:8].ljust(8, b"\0") for n in needles), "<u8")
        self.tail = np.frombuffer(b"".join(n[-8:].rjust(8, b"\0") for n in needles), np.uint8).reshape(-1, 8)
        self.groups = []
        for n in np.unique(np.minimum(self.length, 8)):
            of = np.flatnonzero(np.minimum(self.length, 8) == n)
            of = of[np.argsort(start[of], kind="stable")]
            numbers, first = np.unique(start[of], return_index=True)
            bits = np.zeros(1 << BITS, bool)
            bits[_mixed(numbers)] = True
            mask = np.uint64((1 << (8 * int(n))) - 1)
            self.groups.append((mask, bits, numbers, np.r_[first, len(of)], of))

    def places(self, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, needle): where a needle may begin, by its first bytes, of one stretch after the other."""
        for at in range(0, len(data), SLICE):
            n = min(SLICE, len(data) - at)
            some = np.zeros((n + 15) // 8 * 8, np.uint8)
            some[:min(n + 7, len(data) - at)] = data[at:at + n + 7]
            windows = np.empty((n + 7) // 8 * 8, np.uint64)
            for i in range(8):
                windows[i::8] = np.frombuffer(some, "<u8", len(windows) // 8, i)
            windows = windows[:n]
            for mask, bits, numbers, first, of in self.groups:
                begins = windows & mask
                place = np.flatnonzero(bits[_mixed(begins)])
                code = np.searchsorted(numbers, begins[place])
                code[code == len(numbers)] = 0
                same = numbers[code] == begins[place]
                place, code = place[same], code[same]
                many = first[code + 1] - first[code]
                ends = np.cumsum(many)
                for low in range(0, int(many.sum()), SLICE):                             # many needles may begin alike
                    nth = np.arange(low, min(low + SLICE, int(ends[-1])))
                    row = np.searchsorted(ends, nth, "right")
                    yield at + place[row], of[first[code[row]] + nth - (ends - many)[row]]

    def pairs(self, texts: pa.Array) -> np.ndarray:
        """text * number of needles + needle of every pair that may meet, ascending: the first and last eight bytes of the needle lie in the text
        at the right distance."""
        ends, data = _offsets(texts), _data(texts)
        found = [np.zeros(0, np.int64)]
        for place, needle in self.places(data):
            text = np.searchsorted(ends, place, "right") - 1
            length = self.length[needle]
            whole = place + length <= ends[text + 1]
            place, needle, text, length = place[whole], needle[whole], text[whole], length[whole]
            back = np.minimum(length, 8)
            off = np.arange(8) >= 8 - back[:, None]
            same = (data[np.where(off, (place + length - 8)[:, None] + np.arange(8), 0)] == self.tail[needle]) | ~off
            same = same.all(axis=1)
            found.append(np.unique(text[same] * len(self.needles) + needle[same]))
        return np.unique(np.concatenate(found))

    def occurrences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, needle, occurrences, not overlapping) where there is one at least."""
        pairs = self.pairs(texts)
        text, needle = pairs // len(self.needles), pairs % len(self.needles)
        ends, data = _offsets(texts), memoryview(_data(texts))
        n, last, body = np.zeros(len(pairs), np.int64), -1, b""
        for i, (t, j) in enumerate(zip(text.tolist(), needle.tolist())):
            if t != last:
                last, body = t, bytes(data[ends[t]:ends[t + 1]])
            n[i] = body.count(self.needles[j])
        some = n > 0
        return text[some], needle[some], n[some]


def _offsets(texts: pa.Array) -> np.ndarray:
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    return ends - ends[0]


def _data(texts: pa.Array) -> np.ndarray:
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)


def best_texts(batches: Iterator[pa.RecordBatch], queries: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    """(chunk_id, source_path, low, path) -> (query_id, chunk_id, source_path, score) of the k best of each batch and query, by score (none
    last), path and id. queries: (query_id, needle); a text that is null has no score, and is found by its path alone."""
    asked = queries["needle"].combine_chunks().dictionary_encode()
    needles = Needles(asked.dictionary.to_pylist())
    code = asked.indices.to_numpy(zero_copy_only=False)
    of = np.argsort(code, kind="stable")                       # the queries of a needle
    first = np.searchsorted(code[of], np.arange(len(needles.needles) + 1))
    ids = queries["query_id"].combine_chunks()
    wide = len(needles.needles)
    for batch in batches:
        if not len(batch):
            continue
        low = batch.column(2)
        text, needle, n = needles.occurrences(pc.fill_null(low, b""))
        there, its, _ = needles.occurrences(pc.fill_null(batch.column(3), b""))
        pair, back = np.unique(np.r_[text * wide + needle, there * wide + its], return_inverse=True)
        score = np.zeros(len(pair), np.int64)
        score[back[:len(text)]] += n
        score[back[len(text):]] += PATH
        text, needle = pair // wide, pair % wide
        by_name = pc.sort_indices(pa.table({"p": batch.column(1), "c": batch.column(0)}), sort_keys=[("p", "ascending"), ("c", "ascending")], null_placement="at_start").to_numpy()
        place = np.empty(len(batch), np.int64)
        place[by_name] = np.arange(len(batch))
        none = low.is_null().to_numpy(zero_copy_only=False)[text]
        order = np.lexsort((place[text], -score, none, needle))
        text, needle, score, none = text[order], needle[order], score[order], none[order]
        best = np.arange(len(needle)) - np.searchsorted(needle, needle) < k
        text, needle, score, none = text[best], needle[best], score[best], none[best]
        many = first[needle + 1] - first[needle]
        row = np.repeat(np.arange(len(needle)), many)
        query = of[first[needle][row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
        text = pa.array(text[row])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), batch.column(0).take(text), batch.column(1).take(text), pa.array(score[row], mask=none[row])],
                                         ["query_id", "chunk_id", "source_path", "score"])
