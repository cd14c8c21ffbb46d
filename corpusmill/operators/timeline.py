"""Time series and geometry: as-of segments, containment, presence intervals, boxes, tracks, near-duplicate hashes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, groupby, islice
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.measures import lcount, ppm
from corpusmill.session import cut_lineage
from corpusmill.operators.events import ordered_groups
from corpusmill.operators.numbering import scan_in_order

MICRO = 1_000_000


def assign_segment(samples: DataFrame, segments: DataFrame) -> DataFrame:
    """samples: (media, t, sample_id); segments: (media, start, idx). Adds segment: index of the last segment that starts at
    or before t, first index - 1 before the first start, NULL for media without segments.

    Starts and samples are scanned together in time order; a start sorts before a sample of the same time.
    """
    extra = [c for c in samples.columns if c not in ("media", "t", "sample_id")]
    s = samples.select("media", "t", F.lit(1).alias("_k"), F.col("sample_id").cast("string").alias("_id"), F.lit(None).cast("bigint").alias("_seg"), F.struct("sample_id", *extra).alias("_row"))
    kind = s.schema["_row"].dataType.simpleString()
    g = segments.select("media", F.col("start").alias("t"), F.lit(0).alias("_k"), F.col("idx").cast("string").alias("_id"), F.col("idx").cast("bigint").alias("_seg"), F.lit(None).cast(kind).alias("_row"))
    first = segments.groupBy("media").agg(F.min_by("idx", "start").cast("bigint").alias("_first"))
    out = scan_in_order(s.unionByName(g), ["media"], ["t", "_k", "_id"], fills={"_last": F.col("_seg")}).filter("_k = 1")
    return out.join(first, "media", "left").select("media", "t", "_row.*", F.coalesce("_last", F.col("_first") - 1).alias("segment"))


def contain(events: DataFrame, intervals: DataFrame, bucket: int) -> DataFrame:
    """events: (media, t, event_id); intervals: (media, start, end, interval_id), half open. Every (event, interval) pair.

    Intervals are laid on a grid of ``bucket`` width, so the join is an equi-join on (media, cell) with a residual test.
    """
    cell = lambda c: F.floor(c / F.lit(bucket)).cast("bigint")
    i = intervals.filter("`end` > start").withColumn("_c", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end") - 1))))
    e = events.withColumn("_c", cell(F.col("t")))
    return e.join(i, ["media", "_c"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))).drop("_c")


def mark_islands(obs: DataFrame, group: str, time: str, tie: str, max_gap: int) -> DataFrame:
    """Adds prev (time of the row before) and island (0-based): a new island starts where the step exceeds max_gap."""
    lagged = scan_in_order(obs, [group], [time, tie], lags={"prev": F.col(time)})
    split = (F.col(time) - F.col("prev") > max_gap).cast("bigint")
    return scan_in_order(lagged, [group], [time, tie], sums={"island": F.coalesce(split, F.lit(0).cast("bigint"))})


def presence_intervals(marked: DataFrame, group: str, time: str) -> DataFrame:
    """(group, kind presence|gap, island, start, end, observations): islands and the gaps between them, never merged."""
    isl = marked.groupBy(group, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("observations"))
    first = marked.filter("island > 0").groupBy(group, "island").agg(F.min(time).alias("end"), F.min_by("prev", time).alias("start"))
    gaps = first.select(group, F.lit("gap").alias("kind"), "island", "start", "end", F.lit(0).cast("bigint").alias("observations"))
    return isl.select(group, F.lit("presence").alias("kind"), "island", "start", "end", "observations").unionByName(gaps)


def interval_evidence(marked: DataFrame, group: str, quality: str, time: str) -> DataFrame:
    """Per island: lowest, highest and half-up mean quality, weakest link (quality of the linked rows), longest step inside,
    and whether it began with a reacquisition."""
    n, total = F.count(quality), F.sum(quality)
    step = F.col(time) - F.col("prev")
    return marked.withColumn("_first", F.col("prev").isNull()).groupBy(group, "island").agg(
        F.min(quality).alias("min_q"), F.max(quality).alias("max_q"), F.floor((total * 2 + n) / (n * 2)).cast("bigint").alias("mean_q"),
        F.min(F.when(~F.col("_first"), F.col(quality))).alias("weakest_link"), F.max(step).alias("longest_step"),
        F.max((F.col("island") > 0).cast("bigint")).alias("reacquisitions"))


def coverage_report(samples: DataFrame, media: DataFrame, group: str = "media", time: str = "t") -> DataFrame:
    """Every media: samples, first, last, span, and what its presence claims are worth (sampled or unknown)."""
    g = samples.groupBy(group).agg(F.count("*").alias("samples"), F.min(time).alias("first_t"), F.max(time).alias("last_t"))
    return media.select(group).distinct().join(g, group, "left").select(
        group, F.coalesce("samples", F.lit(0)).cast("bigint").alias("samples"), "first_t", "last_t", (F.col("last_t") - F.col("first_t")).alias("span"),
        F.when(F.col("samples").isNull(), "unknown").otherwise("sampled").alias("semantics"))


def normalise_events(sources: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Sources with (media, t, ...payload) -> one table (media, t, kind, payload as canonical JSON) and all violations
    (media, kind, violation, payload): missing or negative time, end before start. A row may violate several rules."""
    good, bad = None, None
    for kind, df in sorted(sources.items()):
        cols = sorted(c for c in df.columns if c not in ("media", "t"))
        rules = [F.when(F.col("t").isNull(), F.lit("missing_time")), F.when(F.col("t") < 0, F.lit("negative_time")),
                 F.when(F.col("media").isNull(), F.lit("missing_media"))]
        if "t_end" in df.columns:
            rules.append(F.when(F.col("t_end") < F.col("t"), F.lit("end_before_start")))
        x = df.select("media", "t", F.lit(kind).alias("kind"), F.to_json(F.struct(*cols)).alias("payload"), F.array_compact(F.array(*rules)).alias("_v"))
        g, b = x.filter(F.size("_v") == 0).drop("_v"), x.select("media", "kind", F.explode("_v").alias("violation"), "payload")
        good, bad = (g, b) if good is None else (good.unionByName(g), bad.unionByName(b))
    return good, bad


def timeline_index(events: DataFrame, keys: list[str]) -> DataFrame:
    """(index, value, n, first_id, last_id): which events fall under each value of each key column, as ranges and counts;
    the postings themselves are ``index_postings``."""
    p = index_postings(events, keys)
    return p.groupBy("index", "value").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def index_postings(events: DataFrame, keys: list[str]) -> DataFrame:
    """Long form (index, value, event_id): no list per value, so a frequent value stays spread over partitions."""
    entries = F.array(*[F.struct(F.lit(k).alias("index"), F.col(k).cast("string").alias("value")) for k in keys])
    return events.select("event_id", F.explode(entries).alias("x")).select("x.index", "x.value", "event_id").filter("value IS NOT NULL")


def iou_pairs(a: DataFrame, b: DataFrame, threshold_micro: int = 0, each_once: bool = False) -> DataFrame:
    """Boxes (frame, class, id, x, y, w, h in integer units): id pairs of the same frame and class with their IoU in
    millionths, rounded half up. ``each_once``: only pairs with the smaller id first, for a table against itself.

    Above a threshold of zero boxes must touch; that test and the order are part of the join, so other pairs never leave it.
    """
    r = b.select(F.col("frame").alias("bframe"), F.col("class").alias("bclass"), F.col("id").alias("id_b"), *[F.col(c).alias(f"b{c}") for c in "xywh"])
    on = (F.col("frame") == F.col("bframe")) & (F.col("class") == F.col("bclass"))
    if threshold_micro > 0:
        for p, s in ("xw", "yh"):
            on = on & (F.col(p) < F.col("b" + p) + F.col("b" + s)) & (F.col("b" + p) < F.col(p) + F.col(s))
    if each_once:
        on = on & (F.col("id_a") < F.col("id_b"))
    j = a.withColumnRenamed("id", "id_a").join(r, on)
    side = lambda p, s: F.greatest(F.least(F.col(p) + F.col(s), F.col("b" + p) + F.col("b" + s)) - F.greatest(F.col(p), F.col("b" + p)), F.lit(0)).cast("bigint")
    inter = side("x", "w") * side("y", "h")
    union = F.col("w").cast("bigint") * F.col("h") + F.col("bw").cast("bigint") * F.col("bh") - inter
    out = j.withColumn("iou", ppm(inter, union))
    return out.filter(F.col("iou") >= threshold_micro).select("frame", "class", "id_a", "id_b", "iou")


def _buffered(rows: Iterator[tuple], columns: list[str], nullable: tuple[str, ...] = (), size: int = 8192) -> Iterator[pd.DataFrame]:
    """Row tuples as data frames of a fair size: one frame per group would cost more than the work itself."""
    while chunk := list(islice(rows, size)):
        yield pd.DataFrame(chunk, columns=columns).astype({c: "Int64" for c in nullable})


def nms(dets: DataFrame, threshold: float) -> DataFrame:
    """Greedy non-maximum suppression per (image, class): image, class, id, score, x1, y1, x2, y2 -> kept rows with their
    keep order. Ties by id. Groups stream through sorted partitions, best score first; only what was kept so far in the
    current group is held."""
    key = dict(dets.dtypes)

    def kept_rows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        rows = (r for b in batches for r in b.itertuples(index=False))
        for (image, cls), run in groupby(rows, key=lambda r: (r.image, r.cls)):
            kept: list[tuple] = []
            for r in run:
                area = (r.x2 - r.x1) * (r.y2 - r.y1)
                for x1, y1, x2, y2, other in kept:
                    inter = max(0.0, min(x2, r.x2) - max(x1, r.x1)) * max(0.0, min(y2, r.y2) - max(y1, r.y1))
                    if inter / (other + area - inter + 1e-9) > threshold:
                        break
                else:
                    kept.append((r.x1, r.y1, r.x2, r.y2, area))
                    yield image, cls, r.id, len(kept)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _buffered(kept_rows(batches), ["image", "class", "id", "keep_order"])

    d = dets.withColumnRenamed("class", "cls").repartition("image", "cls").sortWithinPartitions("image", "cls", F.desc("score"), "id")
    return d.mapInPandas(walk, f"image {key['image']}, class {key['class']}, id {key['id']}, keep_order bigint")


def _box_iou(a, b) -> tuple[int, int]:
    ix = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    iy = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return ix * iy, a[2] * a[3] + b[2] * b[3] - ix * iy


def _in_sorted_partitions(df: DataFrame, group: str, order: list[str], walk, schema: str) -> DataFrame:
    """Sequential per group, parallel over groups: rows stream through ``walk`` in order, a group is never materialised."""
    return df.repartition(group).sortWithinPartitions(group, *order).mapInPandas(walk, schema)


def track_greedy(dets: DataFrame, iou_threshold: float = 0.3, max_age: int = 2) -> DataFrame:
    """(media, frame, det, class, x, y, w, h) -> (media, frame, det, track): IoU descending, then detection, then track;
    unmatched detections are born, unmatched tracks coast up to max_age frames. Frames without detections are not rows
    and do not age a track."""
    key = dict(dets.dtypes)

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for media, rows in ordered_groups(batches, "media"):
            tracks, born = [], 0          # live tracks: [id, class, box, age]
            for frame, run in groupby(rows, key=lambda r: r.frame):
                found = [(r.det, getattr(r, "cls"), (r.x, r.y, r.w, r.h)) for r in run]
                pairs = []
                for t in tracks:
                    for d, cls, box in found:
                        if cls == t[1]:
                            inter, union = _box_iou(t[2], box)
                            iou = inter / union if union > 0 else 0.0
                            if iou >= iou_threshold:
                                pairs.append((-iou, d, t[0]))
                owner: dict = {}
                for _, d, tid in sorted(pairs):
                    if d not in owner and tid not in owner.values():
                        owner[d] = tid
                for t in tracks:
                    t[3] += 1
                by_id = {t[0]: t for t in tracks}
                for d, cls, box in found:
                    if d not in owner:
                        owner[d] = born
                        by_id[born] = [born, cls, box, 0]
                        tracks.append(by_id[born])
                        born += 1
                    by_id[owner[d]][2:] = [box, 0]
                    yield media, frame, d, owner[d]
                tracks = [t for t in tracks if t[3] <= max_age]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _buffered(links(batches), ["media", "frame", "det", "track"])

    return _in_sorted_partitions(dets.withColumnRenamed("class", "cls"), "media", ["frame", "det"], walk,
                                 f"media {key['media']}, frame {key['frame']}, det {key['det']}, track bigint")


def _seat(row: int, pays: list[dict], held: dict, closed: set) -> tuple[int, tuple]:
    """The cheapest chain of moves that gives ``row`` a column: it may take a held one, whose row then moves on. Returns what
    the chain adds to the total, and the moves. ``closed`` columns are out of reach."""
    reached, waiting, best = {row: (0, ())}, [row], None
    while waiting:
        r = waiting.pop(0)
        spent, moves = reached[r]
        for column, price in pays[r].items():
            if column in closed:
                continue
            total, chain, other = spent + price, (*moves, (r, column)), held.get(column)
            if other is None:
                best = min(best or (total, chain), (total, chain), key=lambda x: x[0])
            elif other not in reached or total - pays[other][column] < reached[other][0]:
                reached[other] = (total - pays[other][column], chain)
                waiting.append(other)
    return best


def _assign(cost: list[list[int | None]]) -> list[tuple[int, int]]:
    """Most pairs first, then least total cost, then the lexicographically smallest columns by row. None marks a forbidden pair.

    Every row has a column of its own, dear enough to be the last resort, so all rows are seated, one after another. Then each
    row in turn takes the smallest column that leaves the total as it is, and keeps it.
    """
    alone = 1 + sum(max((c for c in r if c is not None), default=0) for r in cost)
    width = max(map(len, cost), default=0)
    pays = [{j: c for j, c in enumerate(r) if c is not None} | {width + i: alone} for i, r in enumerate(cost)]
    held: dict[int, int] = {}
    for row in range(len(pays)):
        held |= {column: r for r, column in _seat(row, pays, held, set())[1]}
    closed: set[int] = set()
    for row, mine in enumerate(pays):
        now = next(column for column, r in held.items() if r == row)
        rest = {column: r for column, r in held.items() if column != now}
        for column in sorted(c for c in mine if c not in closed):
            if column == now:
                break
            other = rest.get(column)
            added, moves = _seat(other, pays, rest, closed | {column}) if other is not None else (0, ())
            if mine[column] + added == mine[now] + (pays[other][column] if other is not None else 0):
                held = {c: r for c, r in rest.items() if r not in dict(moves)} | {c: r for r, c in moves} | {column: row}
                now = column
                break
        closed.add(now)
    return sorted((r, c) for c, r in held.items() if c < width)


def track_stable(dets: DataFrame, iou_threshold_q: int = 300_000, max_gap_ms: int = 2000, max_missed: int = 3,
                 centroid_base_q: int = 250_000, centroid_growth_q: int = 250_000, centroid_cap_q: int = 1_000_000,
                 area_ratio_q: int = 4_000_000) -> DataFrame:
    """(media, sample, ts, scene, det, class, x, y, w, h; a sample without detections has det NULL) -> one row per
    observation: media, sample, det, track, link (birth / iou / centroid), quality, gap_ms, missed.

    A scene change or a too long gap ends a track before linking; each class is assigned globally, IoU links (cost
    1e6 - iou) always before gated centroid links (cost 2e6 + distance); too many missed samples end a track.
    """
    key = dict(dets.dtypes)
    half_up = lambda n, d: (2 * n + d) // (2 * d)

    def link(t: dict, box: tuple, gap: int) -> tuple[int, str, int] | None:
        a, b = t["box"], box
        inter, union = _box_iou(a, b)
        iou = half_up(inter * MICRO, union) if union > 0 else 0
        if iou >= iou_threshold_q and (inter > 0 or iou_threshold_q == 0):
            return MICRO - iou, "iou", iou
        area_a, area_b = a[2] * a[3], b[2] * b[3]
        big = b if area_b > area_a else a
        diag = big[2] ** 2 + big[3] ** 2
        if inter == 0 and gap <= max_gap_ms and diag > 0 and area_a > 0 and area_b > 0:
            moved = (2 * a[0] + a[2] - 2 * b[0] - b[2]) ** 2 + (2 * a[1] + a[3] - 2 * b[1] - b[3]) ** 2
            allowed = min(centroid_base_q + centroid_growth_q * gap // 1000, centroid_cap_q)
            if moved * MICRO <= allowed * 4 * diag and max(area_a, area_b) * MICRO <= min(area_a, area_b) * area_ratio_q:
                dist = half_up(moved * MICRO, 4 * diag)
                return 2 * MICRO + dist, "centroid", max(0, MICRO - dist)
        return None

    def observations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for media, rows in ordered_groups(batches, "media"):
            live: list[dict] = []
            born = 0
            for sample, run in groupby(rows, key=lambda r: r.sample):
                run = list(run)
                ts, scene = int(run[0].ts), int(run[0].scene)
                live = [t for t in live if t["scene"] == scene and ts - t["ts"] <= max_gap_ms]
                found = [(int(r.det), r.cls, tuple(int(v) for v in (r.x, r.y, r.w, r.h))) for r in run if not pd.isna(r.det)]
                out, linked = [], set()
                for cls in sorted({f[1] for f in found}):
                    mine, seen = [t for t in live if t["cls"] == cls], [f for f in found if f[1] == cls]
                    if not mine:
                        continue
                    options = [[link(t, f[2], ts - t["ts"]) for f in seen] for t in mine]
                    for i, j in _assign([[o and o[0] for o in row] for row in options]):
                        t, (d, _, box), (_, kind, quality) = mine[i], seen[j], options[i][j]
                        out.append((media, sample, d, t["id"], kind, quality, ts - t["ts"], t["missed"]))
                        t.update(box=box, ts=ts, missed=0, at=sample)
                        linked.add(d)
                for d, cls, box in found:
                    if d not in linked:
                        live.append({"id": born, "cls": cls, "box": box, "ts": ts, "scene": scene, "missed": 0, "at": sample})
                        out.append((media, sample, d, born, "birth", None, None, 0))
                        born += 1
                for t in live:
                    t["missed"] += t["at"] != sample
                live = [t for t in live if t["missed"] <= max_missed]
                yield from out

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _buffered(observations(batches), ["media", "sample", "det", "track", "link", "quality", "gap_ms", "missed"], ("quality", "gap_ms"))

    return _in_sorted_partitions(dets.withColumnRenamed("class", "cls"), "media", ["sample", "det"], walk,
                                 f"media {key['media']}, sample {key['sample']}, det bigint, track bigint, link string, quality bigint, gap_ms bigint, missed bigint")


def near_dup_pairs(hashes: DataFrame, radius: int, bits: int = 64, spare: int = 2) -> tuple[DataFrame, DataFrame]:
    """(id, bits as 0/1 string) -> (pairs of distinct hashes within the radius, members of each hash).

    Equal hashes are folded first, so a hash with very many copies is one row; pairs(hash_a, hash_b, distance) plus
    members(hash, id) say everything without listing all copies against all. The string is cut into radius + spare bands:
    two hashes within the radius agree on at least ``spare`` bands, so each combination of that many bands is an equi-join
    key (longer, hence rarer, than one band). Where such keys are too short to be rare, hashes meet in blocks instead.
    """
    members = hashes.select(F.col("bits").alias("hash"), "id")
    words = [F.conv(F.substring("hash", 1 + 32 * w, 32), 2, 10).cast("bigint") for w in range(-(-bits // 32))]
    d = cut_lineage(members.select("hash").distinct().select("hash", F.array(*words).alias("words")).filter(~F.exists("words", lambda w: w.isNull())))
    n = radius + spare
    if comb(n, spare) * 1000 > 2 ** (bits * spare // n):      # keys this short meet more than a thousandth of all pairs
        return _pairs_by_blocks(d, radius), members
    cuts = [bits * i // n for i in range(n + 1)]
    bands = [F.substring("hash", cuts[i] + 1, cuts[i + 1] - cuts[i]) for i in range(n)]
    keys = F.array(*[F.concat_ws("|", *[bands[i] for i in c]) for c in combinations(range(n), spare)])
    k = d.select("hash", "words", F.posexplode(keys).alias("_c", "_k"))
    a = k.select(F.col("hash").alias("hash_a"), F.col("words").alias("_wa"), "_c", "_k")
    b = k.select(F.col("hash").alias("hash_b"), F.col("words").alias("_wb"), "_c", "_k")
    dist = F.aggregate(F.zip_with("_wa", "_wb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    pairs = a.join(b, ["_c", "_k"]).filter(F.col("hash_a") < F.col("hash_b")).select("hash_a", "hash_b", dist.alias("distance"))
    return pairs.filter(F.col("distance") <= radius).distinct(), members


def _pairs_by_blocks(d: DataFrame, radius: int, block: int = 8192) -> DataFrame:
    """All pairs of (hash, words) within the radius. Where the radius is too wide for keys, every pair has to be looked at: each
    pair of blocks of some ``block`` hashes meets in one group, which compares a slice at a time, whatever the size of the table."""
    blocks = max(1, -(-d.count() // block))
    own = F.pmod(F.xxhash64("hash"), F.lit(blocks))
    cells = d.withColumn("own", own).select("hash", "words", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("other")).select(
        "hash", "words", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        left, right = pdf[pdf["own"] == low], pdf[pdf["own"] == high]
        x, y = (np.array(side["words"].to_list(), np.int64).reshape(len(side), -1) for side in (left, right))
        hx, hy, out = left["hash"].to_numpy(), right["hash"].to_numpy(), []
        for i in range(0, len(x), 256):
            dist = sum(np.bitwise_count(x[i:i + 256, w, None] ^ y[None, :, w]).astype(np.uint16) for w in range(x.shape[1]))
            at = np.argwhere(dist <= radius)
            out += [(min(p, q), max(p, q), int(dist[r, c])) for r, c in at if (p := hx[i + r]) != (q := hy[c]) and (low != high or p < q)]
        return pd.DataFrame(out, columns=["hash_a", "hash_b", "distance"])

    return cells.groupBy("low", "high").applyInPandas(meet, "hash_a string, hash_b string, distance bigint")


def gap_rows(tracked: DataFrame) -> DataFrame:
    """Gap records of stable tracks: links that bridged missed samples."""
    return tracked.filter("link <> 'birth' AND missed >= 1").groupBy("media", "track").agg(
        F.count("*").alias("gaps"), F.max("gap_ms").alias("longest_gap"), lcount(F.col("link") == "centroid").alias("by_centroid"))
