"""Byte-level BPE encoding and decoding by automaton matching and backtracking.

The tokens' bytes become Latin-1 strings in an Aho-Corasick automaton, which finds every token inside a pre-token in one
pass. The encoder takes the longest token at each position and keeps it while it is compatible with the token before it:
merging the bytes of the two together must give just those two. Otherwise it tries the next shorter token, and steps back
where none is left. A sequence whose neighbours are all compatible is the sequence that the merges give, and positions
found to be dead ends are never tried again, so the work is linear in the pre-token. Compatibility of a pair is memoised,
and so are whole pre-tokens; both memories start afresh when full.

A null or empty text has no tokens and decodes to no bytes. Texts with lone surrogates cannot be in a Spark string. Repeated
rows are encoded alike; extra columns pass through untouched.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusmill.llm.common import TwoLives, append_columns, process_memory


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token's bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], below: float = float("inf")) -> list[bytes]:
    """Plain merging, of a token's own bytes: join the neighbours of lowest rank under ``below``, leftmost first, while there are any."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if ranks.get(a + b, below) < below), default=None)
        if best is None:
            break
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


class Codec:
    """Encoder and decoder for one rank file; one per worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 350_000):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        self.trie = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.tokens[rank] = token
            self.trie.add_word(token.decode("latin-1"), (len(token), rank))
        self.trie.make_automaton()
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.fits = lru_cache(maxsize=most)(self.compatible)
        self.length = [len(t) for t in self.tokens]
        self.shorter = lru_cache(maxsize=None)(lambda r: next((ranks[t] for k in range(self.length[r] - 1, 0, -1) if (t := self.tokens[r][:k]) in ranks), -1))
        self.halves = lru_cache(maxsize=None)(lambda t: merge(t, ranks, ranks[t]))
        self.last, self.first = lru_cache(maxsize=None)(lambda t: self.spine(t, True)), lru_cache(maxsize=None)(lambda t: self.spine(t, False))
        self.known = TwoLives(self.packed, most // 2)
        self.opening, self.following = TwoLives(self.chunk, most // 10), TwoLives(lambda c: self.chunk(" " + c), most)

    def spine(self, token: bytes, right: bool) -> list[tuple[bytes, int, int]]:
        """What stands at the right (or left) end of a token while merging builds it: bytes, rank of the merge that makes
        them, rank of the merge that takes them up (none for the token itself)."""
        out = [(token, self.ranks[token] if len(token) > 1 else -1, float("inf"))]
        while len(token) > 1:
            born = out[-1][1]
            token = self.halves(token)[-1 if right else 0]
            out.append((token, self.ranks[token] if len(token) > 1 else -1, born))
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Do the merges over the bytes of both tokens leave just these two? They don't if at some time two neighbours across
        the border merge before either is taken up on its own side (the left side comes first among equals)."""
        rank_of, ys = self.ranks.get, self.first(self.tokens[b])
        for x, x_born, x_end in self.last(self.tokens[a]):
            for y, y_born, y_end in ys:
                if (rank := rank_of(x + y)) is not None and rank < x_end and rank <= y_end and max(x_born, y_born) < min(x_end, y_end):
                    return False
        return True

    def chunk(self, chunk: str) -> bytes:
        """Ids of a stretch of text that begins where a pre-token begins, as little-endian 32-bit numbers."""
        pieces = self.split(chunk)
        if len(pieces) == 1:                                  # the chunk's own memory will have it
            return self.packed(pieces[0])
        return b"".join(map(self.known.__getitem__, pieces))

    def packed(self, piece: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit numbers."""
        return array("i", self.piece(piece.encode())).tobytes()

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        text = piece.decode("latin-1")
        out = [rank for _, (_, rank) in self.trie.iter_long(text)]         # the longest tokens one after the other
        if sum(map(self.length.__getitem__, out)) == len(piece) and all(map(self.fits, out, out[1:])):
            return out
        longest = [-1] * len(piece)
        for end, (size, rank) in self.trie.iter(text):
            longest[end - size + 1] = rank                    # ends ascend, so the last one stays
        longest.append(-1)
        out.clear()
        tried: list[int] = []                                 # the next token to try at each chosen token's position
        dead = bytearray(len(piece) + 1)                      # no sequence over the rest begins here
        pos, rank = 0, longest[0]
        while pos < len(piece):
            while rank >= 0:
                size = self.length[rank]
                if not dead[pos + size] and (not out or self.fits(out[-1], rank)):
                    out.append(rank)
                    tried.append(self.shorter(rank))
                    pos += size
                    rank = longest[pos]
                    break
                rank = self.shorter(rank)
            else:
                if not out:
                    raise ValueError("the ranks lack a byte of this text")
                dead[pos] = 1                                 # this border is not one of the merges'
                pos -= self.length[out.pop()]
                rank = tried.pop()
        return out

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text. A blank before something other than white space always begins a pre-token, so the text is encoded
        chunk by chunk between such blanks, and chunks seen before are looked up."""
        chunks = text.split(" ")
        if "  " in text or " " in text[-1:] or any(c[0].isspace() for c in chunks[1:] if c):
            whole = chunks[:1]
            for c in chunks[1:]:
                if c and not c[0].isspace():
                    whole.append(c)
                else:
                    whole[-1] += " " + c
            chunks = whole
        return np.frombuffer(self.opening[chunks[0]] + b"".join(map(self.following.__getitem__, chunks[1:])), "<i4")

    def text_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after the other."""
        size = self.size[ids]
        end = np.cumsum(size)
        return self.flat[np.repeat(self.place[ids] - end + size, size) + np.arange(end[-1] if len(end) else 0)]


def codec_of(rank_file: str, pattern: str) -> Codec:
    """The worker process's codec: a later task in the same process goes on with what earlier ones remember."""
    kept = process_memory("codecs")
    if (rank_file, pattern) not in kept:
        kept[rank_file, pattern] = Codec(read_ranks(rank_file), pattern)
    return kept[rank_file, pattern]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_name: str = "token_ids", decoded_name: str | None = None) -> DataFrame:
    """The rows and the ids of their whole texts as ``ids_name``; with ``decoded_name`` also the bytes that ``decode`` gives
    for those ids, in the same pass. The file must be at that path on every machine."""
    def start():
        codec = codec_of(rank_file, pattern)

        def work(texts):
            ids = [codec.ids(t.as_py() or "") for t in texts]
            return [_lists(ids)] + [pa.array([codec.text_bytes(i).tobytes() for i in ids], pa.binary())] * bool(decoded_name)
        return work

    fields = [T.StructField(ids_name, T.ArrayType(T.IntegerType()))] + [T.StructField(decoded_name or "", T.BinaryType())] * bool(decoded_name)
    return append_columns(docs, [text_col], fields, start, uses="codecs")


def decode(rows: DataFrame, rank_file: str, pattern: str, ids_col: str = "token_ids", name: str = "decoded") -> DataFrame:
    """The rows and the bytes of their ids as ``name``; null ids give no bytes, an id without a token fails."""
    def start():
        codec = codec_of(rank_file, pattern)
        return lambda lists: [pa.array([codec.text_bytes(np.array(x.as_py() or (), np.int64)).tobytes() for x in lists], pa.binary())]

    return append_columns(rows, [ids_col], [T.StructField(name, T.BinaryType())], start, uses="codecs")
