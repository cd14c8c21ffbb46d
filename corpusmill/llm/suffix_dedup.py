"""Removal of long repeats with sharded suffix arrays.

A byte of a text goes if a string of ``length`` bytes (200) that covers it starts at any other place of the corpus too: in
another row, or elsewhere in its own. Strings don't cross texts, overlaps count, and all strings are judged on the input.

Equal strings must meet in one shard, so the shard follows from the string: it is the least hash of a 32-byte piece in it, its
anchor. Consecutive strings with one anchor form a segment; a segment has every byte of its strings, so neighbours overlap in bytes, but each
string is in exactly one segment.

1. Anchors that occur once in the corpus can't belong to a repeated string. The others are counted in a shuffle of hashes and set
   in a bitmap of 32 MB, whatever their number: it only spares segments the way to the shards. A full bitmap spares none; then
   segments of 3 to 4 bytes for each byte of text travel.
2. Equal segments are summed before and while they move, so a group of copies is one segment with a number.
3. A shard is about half a megabyte of segments, whole anchors each (an anchor whose segments are all equal is settled by their number). Its suffix array is induced (``suffix_array``); where the permuted common
   prefix with the suffix before or after reaches ``length``, the string is repeated. All strings of a segment that has copies are.
4. Segments of an anchor with more bytes than a shard holds (a passage in very many different surroundings) are split by string:
   hashes of 128 bits, counted with partial sums.
5. The spans found go back to texts by the segments' and the texts' fingerprints (128 bits); rows with equal texts share them.

Null texts are empty, and texts of fewer than ``length`` bytes keep all. Ids play no part: null or repeated ones and rows repeated whole are
rows like any other (a row repeated whole makes its long strings repeats). Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import append_columns, fresh, scramble, stored
from corpusmill.llm.suffix_array import permuted_common_prefixes, suffix_array

LENGTH, PIECE = 200, 32
#: Bytes of segments in a shard's suffix array, and of an anchor's segments beyond which it is split by string.
SHARD = 1 << 19
BITS = 28
_BASES = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def rolling(data: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """64-bit hashes of all stretches of ``size`` bytes, by doubling: the hash of 2 m bytes is made of those of m and m."""
    out, have, power = data.astype(np.uint64) + np.uint64(1), 1, base
    result, done, shift = None, 0, np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if size & have:
                part = out[done:] if done else out
                m = len(data) - done - have + 1
                result = part[:m].copy() if result is None else result[:m] + part[:m] * shift
                done, shift = done + have, shift * power
            if done == size:
                return scramble(result)
            out = out[:-have] + out[have:] * power
            have, power = have * 2, power * power


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least value in each window of ``width``: the end of one block and the start of the next."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    whole = -(-len(values) // width) * width
    blocks = np.concatenate([values, np.full(whole - len(values), np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def segments(texts: list[bytes], length: int, piece: int) -> tuple:
    """Of the joined texts: (data, number of the text, start in data, number of strings, anchor, whether the anchor occurs more than once in it)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return data, none, none, none, none, none.astype(bool)
    value, width = rolling(data, piece, _BASES[0]), length - piece + 1
    least = least_of(value, width)
    sizes = np.diff(ends, prepend=0)
    inside = np.repeat(ends, sizes)[:len(least)] - np.arange(len(least)) >= length
    edge = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]), [True]]))
    start, count = edge[:-1], np.diff(edge)
    start, count = start[inside[start]], count[inside[start]]
    of = np.searchsorted(ends, start, side="right")
    within = np.arange(width)
    twice = np.zeros(len(start), bool)
    for k in range(0, len(start), 4096):
        a, last = start[k:k + 4096], (start + count - 1)[k:k + 4096]
        first = a + np.argmin(value[a[:, None] + within], axis=1)
        final = last + width - 1 - np.argmin(value[last[:, None] + within[::-1]], axis=1)
        twice[k:k + 4096] = first != final
    return data, of, start, count, scramble(least[start]).view(np.int64), twice


def _portions(batch: pa.RecordBatch, at: int, most: int = 1 << 17) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about an eighth of a megabyte of text, or one row: their hashes fit into a processor's cache."""
    rows = [(t or "").encode() for t in batch.column(at).to_pylist()]
    a = size = 0
    for b, t in enumerate(rows):
        size += len(t)
        if size >= most:
            yield batch.slice(a, b + 1 - a), rows[a:b + 1]
            a, size = b + 1, 0
    if a < len(rows):
        yield batch.slice(a), rows[a:]


def _repeated_anchors(texts: DataFrame, length: int, piece: int) -> DataFrame:
    """Anchors with two places or more in the corpus."""
    def run(batches):
        for whole in batches:
            for _, rows in _portions(whole, 0):
                *_, anchor, twice = segments(rows, length, piece)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(twice.astype(np.int64) + 1)], ["anchor", "n"])

    return texts.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


def _bitmap(anchors: DataFrame) -> np.ndarray:
    """A bitmap of 2^BITS places (32 MB, for any number of anchors) with those of the anchors set."""
    place = F.pmod(F.col("anchor"), F.lit(1 << BITS))
    parts = anchors.select(F.shiftright(place, 15).alias("block"), (place % (1 << 15)).alias("bit")).groupBy("block") \
        .agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in parts.toLocalIterator():
        out[r.block << 12:(r.block + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def _cut(texts: DataFrame, bitmap, length: int, piece: int, where: bool) -> DataFrame:
    """Segments whose anchor may be repeated: (anchor, body, twice), or with ``where`` (print, start, seg), their text, place in it and fingerprint."""
    def run(batches):
        bits = bitmap.value
        for whole in batches:
            for batch, rows in _portions(whole, 1):
                data, of, start, count, anchor, twice = segments(rows, length, piece)
                place = anchor & ((1 << BITS) - 1)
                kept = np.flatnonzero((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                raw = data.tobytes()
                bodies = [raw[a:b] for a, b in zip(start[kept].tolist(), (start + count + length - 1)[kept].tolist())]
                if where:
                    begin = np.concatenate([[0], np.cumsum([len(t) for t in rows])])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[kept])), pa.array((start - begin[of])[kept].astype(np.int32)),
                                                      pa.array([hashlib.md5(b).digest() for b in bodies], pa.binary())], ["print", "start", "seg"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[kept]), pa.array(bodies, pa.binary()), pa.array(twice[kept])], ["anchor", "body", "twice"])

    return texts.mapInArrow(run, "print binary, start int, seg binary" if where else "anchor long, body binary, twice boolean")


def runs_of(at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted starts of repeated strings, with what they belong to, as (group, start, end) of the bytes each unbroken series covers."""
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(group) != 0)])) if len(at) else at
    last = np.concatenate([new[1:], [len(at)]]) - 1 if len(at) else at
    return group[new], at[new], at[last] + length


def repeated_strings(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start in it) of the strings that occur at two places of the segments, by suffix array and permuted common prefixes."""
    data = np.frombuffer(b"\0".join(bodies), np.uint8)
    symbols = data.astype(np.int64) + 1
    ends = np.cumsum([len(b) + 1 for b in bodies]) - 1
    symbols[ends[:-1]] = 0
    order = suffix_array(symbols)
    shared = permuted_common_prefixes(symbols, order)
    long = shared >= length
    again = order[np.flatnonzero(long[order])]
    rank_before = order[np.flatnonzero(long[order]) - 1]
    hit = np.zeros(len(data), bool)
    hit[again] = True
    hit[rank_before] = True
    at = np.arange(len(data))
    of = np.searchsorted(ends, at, side="left")
    hit &= at + length <= ends[np.minimum(of, len(ends) - 1)]
    found = np.flatnonzero(hit)
    begin = np.concatenate([[0], ends[:-1] + 1])
    return of[found], found - begin[of[found]]


def _flat(seg: list[bytes], group: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([seg[g] for g in group.tolist()], pa.binary()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["seg", "start", "end"])


def _shard_spans(found: DataFrame, length: int, shard: int) -> DataFrame:
    """(seg, start, end) of what is repeated in segments (anchor, body, n, twice), each anchor's in one partition and together."""
    def work(anchors, bodies, numbers, inner):
        of_anchor: dict = {}
        for k, a in enumerate(anchors):
            of_anchor.setdefault(a, []).append(k)
        alone = [k[0] for k in of_anchor.values() if len(k) == 1 and not inner[k[0]]]
        many = [k for k in alone if numbers[k] > 1]                 # equal segments only: no other string has their anchor
        yield _flat([hashlib.md5(bodies[k]).digest() for k in many], np.arange(len(many)), np.zeros(len(many)), np.array([len(bodies[k]) for k in many]))
        rest = sorted(set(range(len(anchors))) - set(alone))
        bodies, numbers = [bodies[k] for k in rest], np.array([numbers[k] for k in rest])
        if not bodies:
            return
        of, at = repeated_strings(bodies, length)
        many = np.flatnonzero(numbers > 1)
        one = numbers[of] == 1
        group, start, end = runs_of(at[one], of[one], length)
        sizes = np.array([len(b) for b in bodies])
        yield _flat([hashlib.md5(b).digest() for b in bodies], np.concatenate([group, many]), np.concatenate([start, np.zeros(len(many), np.int64)]), np.concatenate([end, sizes[many]]))

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if size >= shard and row[0] != rows[-1][0]:
                    yield from work(*zip(*rows))
                    rows, size = [], 0
                rows.append(row)
                size += len(row[1])
        if rows:
            yield from work(*zip(*rows))

    return found.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "seg binary, start int, end int")


def _string_spans(found: DataFrame, length: int) -> DataFrame:
    """The same for segments (anchor, body, n) of anchors too large for a shard: strings are counted by their hashes."""
    def strings_of(bodies, numbers):
        data = np.frombuffer(b"".join(bodies), np.uint8)
        count = np.array([len(b) - length + 1 for b in bodies])
        begin = np.cumsum([0, *[len(b) for b in bodies[:-1]]])
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = start + np.repeat(begin, count)
        seg = pa.array([hashlib.md5(b).digest() for b in bodies], pa.binary())
        of = np.repeat(np.arange(len(bodies)), count)
        a, b = (pa.array(rolling(data, length, base)[at].view(np.int64)) for base in _BASES)
        return pa.RecordBatch.from_arrays([seg.take(pa.array(of)), pa.array(start.astype(np.int32)), a, b, pa.array(np.array(numbers)[of])], ["seg", "start", "a", "b", "n"])

    def run(batches):
        for batch in batches:
            bodies, numbers, size = [], [], 0
            for body, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                bodies.append(body)
                numbers.append(n)
                size += len(body)
                if size >= 1 << 17:
                    yield strings_of(bodies, numbers)
                    bodies, numbers, size = [], [], 0
            if bodies:
                yield strings_of(bodies, numbers)

    strings = found.mapInArrow(run, "seg binary, start int, a long, b long, n long")
    often = strings.groupBy("a", "b").agg(F.sum("n").alias("n")).filter("n > 1").select("a", "b")
    hits = strings.drop("n").join(often, ["a", "b"], "left_semi").groupBy("seg").agg(F.sort_array(F.collect_list("start")).alias("starts"))

    def joined(column):
        at = column.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(column)), [len(x) for x in column])
        group, start, end = runs_of(at, of, length)
        offsets = np.searchsorted(group, np.arange(len(column) + 1))
        fields = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "end"])
        return [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), fields)]

    return append_columns(hits, ["starts"], [T.StructField("found", SPANS)], lambda: joined).select("seg", F.inline("found"))


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list = []
    for s, e in sorted((x["start"], x["end"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def repeats(docs: DataFrame, text_col: str = "text", name: str = "spans", length: int = LENGTH, piece: int = PIECE, shard: int = SHARD) -> DataFrame:
    """The rows with ``name`` (underscores before it where it is taken): the maximal spans of bytes (start, end) that strings of
    ``length`` bytes with a second place cover."""
    [name] = fresh(docs, name)
    text = F.coalesce(F.col(text_col), F.lit("")).cast("string")
    texts = docs.select(text.alias("text")).filter(F.octet_length("text") >= length)
    printed = texts.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("print"), "text")
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(_repeated_anchors(texts, length, piece)))
    found = stored(_cut(printed, bits, length, piece, False).groupBy("anchor", "body", "twice").agg(F.count(F.lit(1)).alias("n")).select("anchor", "body", "n", "twice"), "segments")
    large = stored(found.groupBy("anchor").agg(F.sum(F.octet_length("body")).alias("bytes")).filter(F.col("bytes") > shard).select("anchor"), "anchors")
    spans = _shard_spans(found.join(large, "anchor", "left_anti").select("anchor", "body", "n", "twice"), length, shard)
    spans = stored(spans.unionByName(_string_spans(found.join(large, "anchor", "left_semi").select("anchor", "body", "n"), length)), "segment_spans")

    places = _cut(printed, bits, length, piece, True).groupBy("print", "start", "seg").agg(F.lit(1)).select("print", F.col("start").alias("at"), "seg")
    cover = places.join(spans, "seg").select("print", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))
    lists = cover.groupBy("print").agg(F.collect_list(F.struct("start", "end")).alias("cover"))

    def merge(column):
        return [pa.array([[{"start": s, "end": e} for s, e in _merged(x)] for x in column.to_pylist()], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

    own = stored(append_columns(lists, ["cover"], [T.StructField("spans", SPANS)], lambda: merge).select("print", "spans"), "text_spans")
    [key, other] = fresh(docs, "_print", "_of_print")
    [held] = fresh(docs, name)
    rows = docs.withColumn(key, F.unhex(F.md5(text.cast("binary")))).join(own.select(F.col("print").alias(other), F.col("spans").alias(held)), F.col(key) == F.col(other), "left")
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(F.col(held), F.array().cast(SPANS)).alias(name))


def drop_repeats(docs: DataFrame, text_col: str = "text", name: str = "kept_bytes", spans_name: str = "spans", **options) -> DataFrame:
    """The rows with ``spans_name`` and ``name`` (underscores before them where they are taken), the bytes of the text outside the
    spans, joined (binary; it may cut a character)."""
    spans_name, name = fresh(docs, spans_name, name)
    found = repeats(docs, text_col, spans_name, **options)
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("string").cast("binary")
    spans = F.col(spans_name)
    gaps = F.transform(spans, lambda x, k: F.struct(F.when(k == 0, 0).otherwise(spans[k - 1]["end"]).alias("start"), x["start"].alias("end")))
    rest = F.when(F.size(spans) == 0, raw).otherwise(F.substring(raw, F.element_at(spans, -1)["end"] + 1, F.octet_length(raw)))
    pieces = F.transform(gaps, lambda g: F.hex(F.substring(raw, g["start"] + 1, g["end"] - g["start"])))
    return found.withColumn(name, F.when(F.size(spans) == 0, raw).otherwise(F.unhex(F.concat(F.array_join(pieces, ""), F.hex(rest)))))
