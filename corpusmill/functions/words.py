"""The tokenisers of ``text`` over Arrow batches: the bytes of many texts are split at once, in numpy.

Each gives the tokens that its expression gives. Texts with characters outside ``PLAIN`` are left to the expression where letters of
all scripts count, so no table of Unicode classes decides but Java's.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from corpusmill.functions.text import DESC_STOPWORDS, LEX_STOPWORDS

cloudpickle.register_pickle_by_value(sys.modules[__name__])        # workers need not have this folder

#: Bytes and rows of text that are split at once.
SLICE, ROWS = 4 << 20, 4096
#: Characters whose classes have been the same since Unicode 8: Latin, punctuation, symbols.
PLAIN = ((0, 0x300), (0x2000, 0x2C00))
ODD = "[^\\u0000-\\u02ff\\u2000-\\u2bff]"


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, after) row numbers of slices of bounded bytes; a larger text is a slice of its own."""
    ends = _offsets(texts)
    at = 0
    while at < len(texts):
        after = max(at + 1, min(at + ROWS, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1))
        yield at, after
        at = after


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins, with the end of the last."""
    ends = _offsets(texts)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _runs(inside: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of ``inside`` start (as marks) and the text of each run; a run ends with its text."""
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edges = begins[:-1][begins[:-1] < len(inside)]
    start[edges] = inside[edges]
    return start, np.searchsorted(begins, np.flatnonzero(start), "right") - 1


def _strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _ascii(letters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(letters.encode(), np.uint8)] = True
    return table


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_LEX, _DESC = _ascii(_LOWER + _DIGITS), _ascii(_LOWER + _LOWER.upper() + _DIGITS + "_")
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def _split(texts: pa.Array, table: np.ndarray, stopwords: list[str], shortest: int = 1) -> tuple[np.ndarray, pa.DictionaryArray]:
    data, begins = _bytes(texts)
    inside = table[data]
    start, owner = _runs(inside, begins)
    at = np.r_[np.flatnonzero(start[inside]), np.count_nonzero(inside)]
    tokens = _strings(_SMALL[data[inside]], at).dictionary_encode()
    words = tokens.dictionary
    use = pc.invert(pc.is_in(words, pa.array(stopwords))).to_numpy(zero_copy_only=False) & (pc.binary_length(words).to_numpy(zero_copy_only=False) >= shortest)
    code = tokens.indices.to_numpy(zero_copy_only=False)
    keep = use[code]
    new = np.cumsum(use) - 1
    return owner[keep], pa.DictionaryArray.from_arrays(pa.array(new[code[keep]].astype(np.int32)), words.filter(pa.array(use)))


def lex_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(row of each token, token) of lower-cased texts, as ``tokens_lex`` has them."""
    return _split(texts, _LEX, LEX_STOPWORDS)


def desc_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The same as ``tokens_desc``; texts need not be lower-cased."""
    return _split(texts, _DESC, DESC_STOPWORDS, 2)


def unicode_words(texts: pa.Array, folds: dict[str, str]) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The same as ``tokens_word`` of texts whose characters are all in ``PLAIN``, after ``folds`` replaced single ones."""
    table, fold = np.zeros(PLAIN[-1][1], bool), np.arange(PLAIN[-1][1], dtype=np.uint32)
    for low, high in PLAIN:
        table[low:high] = [unicodedata.category(chr(c))[0] in "LN" or chr(c) == "_" for c in range(low, high)]
    for a, b in folds.items():
        fold[ord(a)] = ord(b)
    data, begins = _bytes(texts)
    first = (data & 0xC0) != 0x80                                   # bytes that begin a character
    begins = np.r_[0, np.cumsum(first)][begins]
    chars = fold[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    inside = table[chars]
    start, owner = _runs(inside, begins)
    kept = chars[inside]
    wide = np.r_[0, np.cumsum(1 + (kept >= 0x80).astype(np.int64) + (kept >= 0x800))]
    at = wide[np.r_[np.flatnonzero(start[inside]), len(kept)]]
    return owner, _strings(np.frombuffer(kept.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8), at).dictionary_encode()
