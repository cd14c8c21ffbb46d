"""Conversation repair against a search of all edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import queries, turn_repair

SF = "/root/testdata/sf0.001"
VISIBLE = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        found = VISIBLE.findall(text or "")
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "" if found[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit) of all edits, by a best-first search over (row, roles so far)."""
    fault = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, end, out = heapq.heappop(heap)
        if i == len(rows) and end in ("", "a"):
            return cost, audit, out
        if (i, end) in done:
            continue
        done.add((i, end))
        may = {"": "su", "s": "u", "u": "a", "a": "u"}[end]
        full = {"u": "user", "a": "assistant"}
        for r in may.replace("s", ""):
            heapq.heappush(heap, (cost + 5, audit + "I", i, r, (*out, (full[r], ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, end, out))
            if fault[i] in ("", "truncated"):
                more = 5 if fault[i] else 0
                if role and role[0] in may:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, (role, text))))
                for r in may.replace("s", ""):
                    heapq.heappush(heap, (cost + more + 1, audit + "R", i + 1, r, (*out, (full[r], text))))


def report(turns):
    """turns: (turn, role, text) in order."""
    rows = [(r, t) for _, r, t in turns]
    fault, known = faults(rows), [t for t, *_ in turns if t is not None]
    starts = [(r or " ")[:1] for r, _ in rows]
    cost, audit, out = cheapest(rows)
    return (max(known) - min(known) + 1 - len(set(known)) if known else 0, *[fault.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(starts, starts[1:])), cost, audit), list(out)


def test_solver_finds_the_least_audit():
    rng = random.Random(8)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "user", "tool", ""]), rng.choice(["a.", "b!", "c", "", f"d{rng.random()}.", f"e{rng.random()}?"])) for _ in range(rng.randrange(9))]
        fault = [["", "blank", "duplicate", "truncated"].index(f) for f in faults(rows)]
        code = "".join(chr(65 + {"s": 0, "u": 1, "a": 2}.get(r[:1], 3) * 4 + f) for (r, _), f in zip(rows, fault))
        got = turn_repair.solve([code, "E", code])
        want = cheapest(rows)
        for k in (0, 2):
            assert (got["cost"][k], got["audit"][k]) == want[:2]
            assert [(rows[i][0] if r is None else r, rows[i][1] if i is not None else "") for i, r in zip(got["rows"][k], got["roles"][k])] == list(want[2])


def test_rows(spark):
    rows = [(1, 0, "user", "hello."), (1, 0, "user", "hello."), (1, 1, None, "so."), (1, 5, "assistant", None), (2, None, "user", "a."), (2, None, "system", "x"), (2, 3, "assistant", "y? \n"),
            (None, 1, "user", "nobody."), (None, 2, "assistant", "long " * 20000 + "."), (3, 1, "user", " "), (4, 2, "", "z."), (4, 1, "sys", "q!")] + [(5, k, ["user", "assistant"][k % 2], f"{k}.") for k in range(900)]
    rows += [(6, 7, "user", "same.")] * 300
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("c", F.lit(1)).withColumn("pos", F.lit(2)).repartition(3)
    found, repaired = turn_repair.repair(df)
    lines = defaultdict(list)
    for r in sorted(repaired.collect(), key=lambda r: r.line):
        lines[r.conv].append((r.role, r.text))
    turns = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", turn_key(r[3]))):
        turns[c].append((t, r, x))
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in found.collect()}
    assert got.keys() == turns.keys()
    for c, mine in turns.items():
        want, out = report(mine)
        assert got[c] == want and lines[c] == out, c
    none, empty = turn_repair.repair(df.limit(0))
    assert none.count() == 0 and turn_repair.digests(empty).count() == 0


def turn_key(text):
    return hashlib.md5(("-" if text is None else "+" + text).encode()).hexdigest()


def test_query(spark):
    kept, every = defaultdict(list), set()
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        every.add(r.conv_id)
        role, text = (r.role or " "), (r.text or " ") if r.text is not None else " "
        n = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        if n == 0:
            continue
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        kept[r.conv_id] += [(r.turn, "user" if n == 4 else role, text)] * (2 if n == 3 else 1)
    got = {r.conv_id: tuple(r)[1:] for r in queries.op13_turn_repair(spark, SF).collect()}
    assert got.keys() == every
    for c in every:
        want, out = report(sorted(kept[c], key=lambda t: (t[0] is not None, t[0])))
        assert got[c] == (*want, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())
