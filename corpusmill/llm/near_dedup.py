"""MinHash near-duplicates with odd sketches.

A document's set is its distinct shingles of ``words`` words (five by default), lower-cased in A-Z; with fewer words, the whole
sequence is one. Each
document gets 240 MinHash samples, 40 band keys of six samples each (a pair of similarity 0.8 meets in no band once in two
hundred thousand), and an odd sketch: the samples folded into a bitmap of 2048 parities. The exclusive or of two sketches
counts, by its population, the samples in which they differ.

1. Documents with equal sets are one class, represented by its smallest id; only classes go on.
2. In each band bucket every class is paired with the smallest one. Of the pairs whose sketches and sizes can belong to the
   wanted similarity, each class's closest by sketch is confirmed on the full sets; the links give components.
3. In a bucket that still holds several components, the classes outside its largest one are paired with another member
   of that one, drawn anew each round. What then is still apart in a bucket is compared with all classes of its other components:
   finer sketches (2048 samples, 8192 bits) inside the join, then full sets. So no two classes of a bucket stay
   uncompared unless they are in one component already, and no large group is paired with itself.
4. Components again, over all links.

Null and empty texts have no shingles and are linked with nothing; a row without id is its own component (null). Rows that
repeat an id are one document. Texts move once: the full sets of all classes that share a bucket are written, and confirming
and finer sketches read them; a bitmap of the ids wanted thins them before each join. Hot keys (copies, buckets) meet their partner in joins with one row on the other side,
which adaptive execution splits, or in partial aggregates. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import Words, append_columns, scramble, stored

WORDS, SAMPLES, ROWS, SKETCH, BLOCKS = 5, 240, 6, 2048, 2048
#: Rounds of pairing with one member of a bucket before all that is still apart is compared.
TURNS = 2
#: The finer sketch of classes that first rounds leave apart: samples and bits.
FINE_SAMPLES, FINE_SKETCH = 2048, 8192
_WORD = np.array([b not in b" \t\n\r\x0b\x0c" for b in range(256)])
_LOWER = bytes(range(256)).lower()
_RANDOM = np.random.default_rng(20)
_TIMES = _RANDOM.integers(0, 2**31, FINE_SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(0, 2**32, FINE_SAMPLES, np.uint32)


def shingle_sets(texts: list, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    w = Words(texts, _WORD, _LOWER)
    h = w.hash(w.start, w.end)
    n = len(h)
    whole = np.zeros(n, np.uint64)
    for i in range(words):
        whole[:n - i] = scramble(whole[:n - i] + h[i:])              # right where all of them are of one text
    out, at = [], 0
    for count in w.count:
        if count >= words:
            out.append(np.unique(whole[at:at + count - words + 1]))
        elif count:
            one = np.full(1, count, np.uint64)
            for i in range(count):
                one = scramble(one + h[at + i])
            out.append(one)
        else:
            out.append(h[:0])
        at += count
    return out


def samples(shingles: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """MinHash samples of a set that isn't empty."""
    low = np.full(count, 2**32 - 1, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    step = max(1, 250_000 // count)
    for i in range(0, len(x), step):
        np.minimum(low, (x[i:i + step, None] * _TIMES[:count] + _PLUS[:count]).min(0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(len(rows), dtype=np.uint64)
    for i in range(ROWS):
        key = scramble(key + rows[:, i])
    return key.view(np.int64)


def odd_sketch(low: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """64-bit words: bit b is the parity of the number of samples that fall on b."""
    place = scramble((np.arange(len(low), dtype=np.uint64) << np.uint64(32)) | low) % np.uint64(bits)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def most_bits(count: int = SAMPLES, bits: int = SKETCH, wanted: float = 0.8, deviations: float = 5.0) -> int:
    """The population count up to which a pair of the wanted similarity may come. Of ``count`` samples a binomial number differ,
    and each of them flips two bits at random: d flips leave bits / 2 * (1 - exp(-2 d / bits)) of them set."""
    differ = count * (1 - wanted) + deviations * (count * wanted * (1 - wanted)) ** 0.5
    spread = bits / 2 * (1 - np.exp(-4 * differ / bits))
    return int(spread + deviations / 2 * (differ * 2 * differ * 2 / bits) ** 0.5)


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, print, bands, sketch): size of the set, fingerprint of the set, band keys and odd sketch."""
    def work(texts):
        sets = shingle_sets(texts.to_pylist(), words)
        lows = [samples(s) if len(s) else None for s in sets]
        longs = pa.list_(pa.int64())
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([[] if x is None else band_keys(x) for x in lows], longs), pa.array([[] if x is None else odd_sketch(x) for x in lows], longs)]

    longs = T.ArrayType(T.LongType())
    fields = [T.StructField("n", T.LongType()), T.StructField("print", T.BinaryType()), T.StructField("bands", longs), T.StructField("sketch", longs)]
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return append_columns(rows, ["text"], fields, lambda: work).drop("text")


def _apart(a: str, b: str):
    """In how many bits the sketches differ."""
    return F.aggregate(F.zip_with(F.col(f"{a}.sketch"), F.col(f"{b}.sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def _plausible(a: str, b: str, percent: int, most: int):
    """Can the two belong together, by the sizes of their sets and by their sketches?"""
    low, high = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (low * 100 >= high * percent) & (_apart(a, b) <= most)


def _closest(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """For each node of pairs (node, other) the plausible other whose sketch is closest, as (a, b)."""
    known = pairs.join(marks.alias("y"), "node").join(marks.withColumnRenamed("node", "other").alias("x"), "other").filter(_plausible("x", "y", percent, most_bits(wanted=percent / 100)))
    return known.groupBy("node").agg(F.min_by("other", F.struct(_apart("x", "y").alias("bits"), "other")).alias("a")).select("a", F.col("node").alias("b"))


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (id, ...) whose id may be among the wanted ones: their hashes are set in a bitmap of BLOCKS * 32768 bits (8 MB, for
    any number of ids), which every task gets. It only spares the join below most texts; when full, it spares none."""
    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(BLOCKS * 32768)) + 1

    bits = wanted.select(F.call_function("bitmap_bucket_number", place("id")).alias("block"), F.call_function("bitmap_bit_position", place("id")).alias("bit")) \
        .groupBy("block").agg(F.call_function("bitmap_construct_agg", F.col("bit")).alias("bits"))
    bit = F.call_function("bitmap_bit_position", place("id"))
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.call_function("getbit", byte, (bit % 8).cast("int")) == 1
    return rows.withColumn("block", F.call_function("bitmap_bucket_number", place("id"))).join(F.broadcast(bits), "block").filter(held).drop("block", "bits")


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the documents whose id is wanted."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    return _marked(rows, wanted).join(wanted, "id", "left_semi")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, set): the sorted shingle hashes of the documents whose id is wanted."""
    def work(texts):
        return [pa.array([s.view(np.int64) for s in shingle_sets(texts.to_pylist(), words)], pa.list_(pa.int64()))]

    return append_columns(_texts(docs, wanted, id_col, text_col), ["text"], [T.StructField("set", T.ArrayType(T.LongType()))], lambda: work).drop("text")


def sketches(sets: DataFrame) -> DataFrame:
    """(id, n, sketch): the finer sketches of (id, set)."""
    def work(lists):
        rows = [x.values.to_numpy().view(np.uint64) for x in lists]
        return [pa.array([len(s) for s in rows], pa.int64()), pa.array([odd_sketch(samples(s, FINE_SAMPLES), FINE_SKETCH) for s in rows], pa.list_(pa.int64()))]

    fields = [T.StructField("n", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType()))]
    return append_columns(sets, ["set"], fields, lambda: work).drop("set")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    def side(name):
        return _marked(sets, pairs.select(F.col(name).alias("id"))).select(F.col("id").alias(name), F.col("set").alias(f"set_{name}"))

    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(common * 100 >= (F.size("set_a") + F.size("set_b") - common) * percent).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of the links (a, b). Labels sink along links and are
    followed to their own labels, so paths shorten by half or more in a round."""
    ends = stored(links.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct(), "ends")
    labels = stored(ends.groupBy(F.col("u").alias("node")).agg(F.least(F.first("u"), F.min("v")).alias("label")), "labels")
    while True:
        near = ends.join(labels, ends.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.node == near.u, "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        new = stored(low.join(up, "to", "left").select("node", "was", F.least("to", "beyond").alias("label")), "labels")
        moved = new.filter("was <> label").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: the smallest id that links reach, and whether it is the row's own."""
    sig = stored(signatures(docs, id_col, text_col, words), "signatures")
    linked = sig.filter("n > 0 and id is not null")
    classes = stored(linked.groupBy("print").agg(F.min("id").alias("node")), "classes")
    nodes = linked.join(classes, (linked["print"] == classes["print"]) & (linked.id == classes.node)).select("node", "n", "sketch", "bands")

    buckets = nodes.select("node", F.explode("bands").alias("key"))
    heads = buckets.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head <> last").drop("last")
    shared = stored(buckets.join(heads, "key"), "buckets")
    marks = nodes.select("node", "n", "sketch")
    members = stored(shared.select(F.col("node").alias("id")).distinct(), "members")
    sets = stored(full_sets(docs, members, id_col, text_col, words), "sets")
    pairs = shared.filter("node <> head").select("node", F.col("head").alias("other")).distinct()
    links = None
    for turn in range(TURNS):
        tried = stored(_closest(pairs, marks, percent), "pairs")
        new = stored(confirm(tried, sets, percent), "links")
        links = new if links is None else stored(links.unionByName(new), "links")
        label = components(links)
        placed = shared.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"), F.max_by("node", F.xxhash64("node", "key", F.lit(turn))).alias("pivot"))
        main = stored(sizes.groupBy("key").agg(F.max_by(F.struct("component", "pivot"), F.struct("size", "component")).alias("m"), F.count(F.lit(1)).alias("parts"))
                      .filter("parts > 1").select("key", F.col("m.component").alias("main"), F.col("m.pivot").alias("pivot")), "main")
        pairs = placed.join(main, "key").filter("component <> main").select("node", F.col("pivot").alias("other")).distinct()

    mixed = stored(placed.join(main, "key"), "mixed")
    own = stored(mixed.select(F.col("node").alias("id")).distinct(), "mixed")
    finer = stored(sketches(_marked(sets, own).join(own, "id", "left_semi")).dropDuplicates(["id"]), "finer")
    mixed = mixed.join(finer.withColumnRenamed("id", "node"), "node").join(nodes.select("node", "bands").dropDuplicates(["node"]), "node")
    x, y = mixed.filter("component <> main").alias("x"), mixed.alias("y")
    apart = F.col("x.component") != F.col("y.component")
    once = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key")          # in the first of their common buckets
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & _plausible("x", "y", percent, most_bits(FINE_SAMPLES, FINE_SKETCH, percent / 100)) & once)
    rest = stored(across.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
    more = confirm(rest, sets, percent)
    label = components(links.unionByName(more))

    of_class = classes.join(label, "node", "left").select("print", F.coalesce("component", "node").alias("c"))
    out = sig.select("id", "n", "print").join(of_class, "print", "left").select(
        "id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("c")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
