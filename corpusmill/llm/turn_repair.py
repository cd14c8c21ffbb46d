"""Repair of the role structure of conversations by cheapest edits, ties by the least audit.

The roles' first letters of a repaired conversation read ``(s?(ua)+)?``. Each row is kept (0), given the role user or assistant (1) or
deleted (2; blank rows and duplicates must be); empty user or assistant rows may be inserted anywhere (5 each); a row that stays although it is
truncated adds 5. The audit is the initials of the edits in order; of the cheapest ones the least in ASCII is taken.

1. Equal rows of a turn are one row with a number, and rows are numbered in their conversation without gathering it
   (``numbering``). Texts are represented by their digests until the end.
2. A conversation becomes a string of one character a row: initial and fault. This, the audit and the edits are the only things that one task
   holds of a conversation; the audit is a single value of the result and of the same size.
3. Nodes are (row, what the roles so far end in). The cost to the end is a sweep backwards over all conversations of a batch at once. An arc is optimal if
   it keeps that cost; no node has two optimal arcs of one letter.
4. Prefix doubling: nodes are ranked by their least audits of 1, 2, 4, ... letters, a pair of ranks giving the next one, while pointers double. The arc
   with the least letter and then the least rank where it leads is the node's own, and the doubled pointers list the path from the start.
5. Edits are joined with the texts.

A null role has no initial; a null text is blank. Rows come by turn, nulls first; ties by role, then digest of the text. Conversations without
id are one conversation. Extra columns are not used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import append_columns, stored
from corpusmill.operators.numbering import number_rows

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NO_WORD = " \t\n\x0b\x0c\r"
LETTERS = np.array([ord(c) for c in "DIKR"], np.uint8)
#: What follows a start, an s, a u, an a: the state that a user or assistant row leads to.
_NEXT = np.array([2, 2, 3, 2])
#: State after keeping a row of initial s, u, a or another one; -1: can't be kept.
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_LEGAL = np.array([[0, 1, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], bool)
BLOCK = 4096


def keyed(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, conv, turn, role, text, dig): the operator's own columns; c stands for the conversation and is never null."""
    conv = F.col(conv_col)
    text = F.col(text_col).cast("string")
    return rows.select(F.concat(F.when(conv.isNull(), "-").otherwise("+"), F.coalesce(conv.cast("string"), F.lit(""))).alias("c"), conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                       F.col(role_col).cast("string").alias("role"), text.alias("text"), F.md5(F.coalesce(F.concat(F.lit("+"), text), F.lit("-"))).alias("dig"))


def coded(rows: DataFrame) -> DataFrame:
    """(c, pos, turn, role, dig, code): one row for equal rows of a turn, in order; ``code`` has a character for each of them."""
    ended = F.rtrim(F.coalesce("text", F.lit("")), F.lit(NO_WORD))
    initial = F.coalesce(F.substring("role", 1, 1), F.lit(""))
    which = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    end = F.when(ended == "", 1).when(F.right(ended, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3)
    unique = rows.select("c", "turn", "role", "dig", which.alias("initial"), end.alias("end")).groupBy("c", "turn", "role", "dig", "initial", "end").agg(F.count(F.lit(1)).alias("n"))
    unique = stored(unique, "rows")
    again = unique.groupBy("c", "role", "dig").agg(F.min(F.struct(F.coalesce(F.col("turn").isNotNull().cast("int"), F.lit(0)).alias("known"), "turn")).alias("first"), F.count(F.lit(1)).alias("turns")) \
        .filter("turns > 1").select("c", F.col("role").alias("role_"), "dig", F.col("first.turn").alias("first"), F.lit(True).alias("many"))
    x, y = unique.alias("x"), again.alias("y")
    joined = x.join(y, (F.col("x.c") == F.col("y.c")) & (F.col("x.dig") == F.col("y.dig")) & F.col("x.role").eqNullSafe(F.col("y.role_")), "left")
    later = F.coalesce(F.col("many"), F.lit(False)) & ~F.col("x.turn").eqNullSafe(F.col("first"))
    fault = F.when(F.col("end") == 1, 1).when(later, 2).otherwise(F.col("end"))
    letter = F.char(F.lit(65) + F.col("initial") * 4 + fault)
    copy = F.char(F.lit(81) + F.col("initial") * 4 + F.when(F.col("end") == 1, 1).otherwise(2))
    code = F.concat(letter, F.repeat(copy, (F.col("n") - 1).cast("int")))
    return stored(number_rows(joined.select("x.c", "x.turn", "x.role", "x.dig", code.alias("code")), ["c"], ["turn", "role", "dig"]), "coded")


def costs(codes: list[np.ndarray]) -> tuple:
    """Of conversations as arrays of codes: (cost to the end of each node, letter -> next node or -1, first node of each conversation)."""
    size = np.array([len(c) for c in codes])
    base = np.concatenate([[0], np.cumsum(size + 1)])
    layers = int(base[-1])
    code = np.zeros(layers, np.int64)
    inside = np.ones(layers, bool)
    inside[base[1:] - 1] = False
    code[inside] = np.concatenate([np.zeros(0, np.int64), *codes])
    initial, fault = code % 16 // 4, code % 4
    stays = (fault == 0) | (fault == 3)
    extra = np.where(fault == 3, TRUNCATED, 0)
    far = np.int64(1) << 60
    h = np.full((layers, 4), far)
    states = np.arange(4)

    def insert(at):
        h[at, 2] = np.minimum(h[at, 2], h[at, 3] + INSERT)
        for q in (0, 1, 3):
            h[at, q] = np.minimum(h[at, q], h[at, 2] + INSERT)

    at = base[1:] - 1
    h[at[:, None], [0, 3]] = 0
    insert(at)
    order = np.argsort(-size, kind="stable")
    ends, sizes = at[order], size[order]
    for back in range(1, int(size.max(initial=0)) + 1):
        at = ends[:np.searchsorted(-sizes, -back, side="right")] - back
        after, stay = h[at + 1], stays[at][:, None]
        keep = _KEPT[:, initial[at]].T
        kept = np.where(stay & (keep >= 0), np.take_along_axis(after, np.maximum(keep, 0), 1) + KEEP + extra[at][:, None], far)
        given = np.where(stay, after[:, _NEXT] + REROLE + extra[at][:, None], far)
        h[at] = np.minimum(np.minimum(after + DELETE, kept), given)
        insert(at)
    node = np.arange(layers)[:, None] * 4 + states
    go = np.full((layers, 4, 4), -1, np.int64)                               # letters D, I, K, R
    last = ~inside
    after = np.concatenate([h[1:], np.full((1, 4), far)])
    stay = (stays & inside)[:, None]
    keep = _KEPT[:, initial].T
    kept = np.take_along_axis(after, np.maximum(keep, 0), 1) + KEEP + extra[:, None]
    below = (np.arange(layers)[:, None] + 1) * 4
    go[:, :, 0] = np.where(inside[:, None] & (after + DELETE == h), below + states, -1)
    go[:, :, 1] = np.where(h[:, _NEXT] + INSERT == h, node - states + _NEXT, -1)
    go[:, :, 2] = np.where(stay & (keep >= 0) & (kept == h), below + keep, -1)
    go[:, :, 3] = np.where(stay & (after[:, _NEXT] + REROLE + extra[:, None] == h), below + _NEXT, -1)
    go[last[:, None] & np.isin(states, [0, 3])] = -1                          # the end
    return h.reshape(-1), go.reshape(-1, 4), base[:-1] * 4


def least_paths(go: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The paths of least letters from the start nodes to nodes without arcs, as (path, letter, node reached), by prefix doubling."""
    n = len(go)
    has = go >= 0
    ends = ~has.any(1)
    letter = np.where(ends, -1, has.argmax(1))
    own = np.where(ends, np.arange(n), go[np.arange(n), np.maximum(letter, 0)])
    rank, jump = np.unique(letter, return_inverse=True)[1], own
    while (jump != jump[jump]).any():                                        # ranks and pointers of twice the length
        rank = np.unique(rank.astype(np.int64) * n + rank[jump], return_inverse=True)[1]
        jump = jump[jump]
    rank = np.unique(rank.astype(np.int64) * n + rank[jump], return_inverse=True)[1]
    choice = np.where(has, np.arange(4) * (n + 1) + rank[np.maximum(go, 0)], np.iinfo(np.int64).max)
    letter = np.where(ends, -1, choice.argmin(1))
    own = np.where(ends, np.arange(n), go[np.arange(n), np.maximum(letter, 0)])
    pointers, steps = [own], (~ends).astype(np.int64)
    while (pointers[-1] != pointers[-1][pointers[-1]]).any():
        steps = steps + steps[pointers[-1]]
        pointers.append(pointers[-1][pointers[-1]])
    count = steps[start]
    path = np.repeat(np.arange(len(start)), count)
    step = np.arange(len(path)) - np.repeat(np.cumsum(count) - count, count)
    at = start[path]
    for k, far in enumerate(pointers):
        at = np.where(step >> k & 1, far[at], at)
    return path, letter[at], own[at]


def solve(strings: list[str]) -> dict:
    """For conversations as strings of codes: counts, cost, audit, and the lines of the repaired conversation: number of the distinct row, or null
    for an inserted one, and new role, or null for the row's own."""
    codes = [np.frombuffer(s.encode(), np.uint8).astype(np.int64) - 65 for s in strings]
    h, go, start = costs(codes)
    path, letter, reached = least_paths(go, start)
    number = [np.cumsum(c < 16) - 1 for c in codes]
    first = start // 4
    audits, rows, roles = [], [], []
    bounds = np.searchsorted(path, np.arange(len(codes) + 1))
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        did = letter[a:b]
        audits.append(LETTERS[did].tobytes().decode())
        out = did > 0
        row = (reached[a:b] // 4 - first[k] - 1)[out]
        made, state = did[out], (reached[a:b] % 4)[out]
        rows.append([None if m == 1 else int(number[k][r]) for m, r in zip(made.tolist(), row.tolist())])
        roles.append([None if m == 2 else "user" if q == 2 else "assistant" for m, q in zip(made.tolist(), state.tolist())])
    faults = [np.bincount(c % 4, minlength=4) for c in codes]
    illegal = [int((~_LEGAL[c[:-1] % 16 // 4, c[1:] % 16 // 4]).sum()) for c in codes]
    return {"blank": [int(f[1]) for f in faults], "duplicate": [int(f[2]) for f in faults], "truncated": [int(f[3]) for f in faults], "illegal": illegal,
            "cost": h[start].tolist(), "audit": audits, "rows": rows, "roles": roles}


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, repaired). Report, per conversation: conv, gaps (turns missing between the first and the last), blank, duplicate, truncated, illegal, cost, audit.
    Repaired: conv, line (from 0), role, text. Both also have c, which stands for conv and is not null."""
    own = keyed(rows, conv_col, turn_col, role_col, text_col)
    order = coded(own)
    pieces = order.groupBy("c", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("piece"))
    whole = pieces.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("codes"))
    longs = [T.StructField(k, T.LongType()) for k in ("blank", "duplicate", "truncated", "illegal", "cost")]
    fields = [*longs, T.StructField("audit", T.StringType()), T.StructField("rows", T.ArrayType(T.LongType())), T.StructField("roles", T.ArrayType(T.StringType()))]

    def work(column):
        done = solve(column.to_pylist())
        kinds = {"audit": pa.string(), "rows": pa.list_(pa.int64()), "roles": pa.list_(pa.string())}
        return [pa.array(done[f.name], kinds.get(f.name, pa.int64())) for f in fields]

    solved = stored(append_columns(whole, ["codes"], fields, lambda: work).drop("codes"), "solved")
    turns = order.groupBy("c", "turn").agg(F.lit(1)).groupBy("c").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    conv = own.groupBy("c").agg(F.first("conv").alias("conv"))
    report = solved.drop("rows", "roles").join(turns, "c").join(conv, "c")

    lines = solved.select("c", F.posexplode(F.arrays_zip("rows", "roles")).alias("line", "edit")).select("c", F.col("line").cast("long").alias("line"), F.col("edit.rows").alias("pos"), F.col("edit.roles").alias("new_role"))
    kept = lines.filter("pos is not null").join(order.select("c", "pos", "turn", "role", "dig"), ["c", "pos"]).alias("k")
    texts = own.groupBy("c", "turn", "role", "dig").agg(F.first("text").alias("text")).alias("t")
    same = (F.col("k.c") == F.col("t.c")) & (F.col("k.dig") == F.col("t.dig")) & F.col("k.turn").eqNullSafe(F.col("t.turn")) & F.col("k.role").eqNullSafe(F.col("t.role"))
    found = kept.join(texts, same).select("k.c", "line", F.coalesce("new_role", "k.role").alias("role"), "text")
    new = lines.filter("pos is null").select("c", "line", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return report, found.unionByName(new).join(conv, "c")


def digests(repaired: DataFrame) -> DataFrame:
    """(c, sha256) of each conversation's lines ``role:text``, joined by newlines. Lines stream past in order; none is held."""
    def run(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for c, role, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if c != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role or ''}:{text or ''}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in range(2)], ["c", "sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["c", "sha256"])

    return repaired.repartition("c").sortWithinPartitions("c", "line").select("c", "role", "text").mapInArrow(run, "c string, sha256 string")
