"""Helpers that the training-data operators share: written intermediate tables, row-wise Arrow columns, hashed words."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusmill.session import ensure_checkpoint_dir


def shared_path(df: DataFrame, label: str) -> str:
    """A new path in the shared folder that the session names in spark.checkpoint.dir."""
    return f"{ensure_checkpoint_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends there, a lost executor costs nothing, and
    Spark knows the table's true size when it chooses a join."""
    path = shared_path(df, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once: Catalyst would copy a plain expression into every lambda that uses it."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from every column of the table."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def process_memory(name: str) -> dict:
    """What the worker process keeps under ``name`` from one task to the next."""
    return sys.modules.setdefault("_corpusmill_process", types.ModuleType("_corpusmill_process")).__dict__.setdefault(name, {})


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task holds only what it keeps."""
    import ctypes                                         # here, because functions go to the workers with their globals

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def forget(but: str | None = None) -> None:
    """Let go of what other operators' tasks left in the worker process: a later stage doesn't pay for it."""
    kept = sys.modules.get("_corpusmill_process")
    gone = [k for k in vars(kept) if not k.startswith("__") and k != but] if kept else []
    for k in gone:
        del kept.__dict__[k]
    if gone:
        gc.collect()
        give_back()


def _portions(batch: pa.RecordBatch, at: list[int], most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of about a quarter of a megabyte of input each, or a single row; arrays over a slice's bytes take some fifty times that."""
    size = np.zeros(batch.num_rows, np.int64)
    for k in at:
        col = batch.column(k)
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
            size += pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(col.type):
            size += 4 * pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size + 64) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def append_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField],
                   start: Callable[[], Callable[..., list[pa.Array]]], uses: str | None = None) -> DataFrame:
    """Add columns computed row by row from ``inputs``. ``start`` runs once in each task; what it returns maps the input
    arrays of a batch to the arrays of the new columns. The names of ``fields`` must be new. ``uses``: the name under which
    the operator keeps something in the worker process."""
    at = [df.columns.index(c) for c in inputs]
    added = [pa.field(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(uses)
        work = start()
        for whole in batches:
            for batch in _portions(whole, at):
                new = work(*[batch.column(k) for k in at])
                yield pa.RecordBatch.from_arrays([*batch.columns, *[a.cast(f.type) if a.type != f.type else a for a, f in zip(new, added)]],
                                                 schema=pa.schema([*batch.schema, *added]))
                del new, batch
            del whole                                      # before the next one is read
        del work
        give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


class TwoLives(dict):
    """A memory of ``make`` that forgets what was not asked for lately: when half of ``most`` keys are in it, they become the
    older generation, and the next such change drops those that were not asked for since. Both together hold ``most`` at most."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if 2 * (len(self) + 1) > self.most:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def scramble(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of some texts (null: empty) as arrays: ``start`` and ``end`` in ``data``, the bytes of all texts; ``text``, the
    number of the text a word is in. ``is_word``: which of the 256 bytes words are made of; a blank is not one of them.
    ``change``: a table for bytes.translate."""

    def __init__(self, texts: list, is_word: np.ndarray, change: bytes | None = None):
        raw = [(t or "").encode() for t in texts]
        joined = b" ".join([*raw, b""])
        self.data = np.frombuffer(joined.translate(change) if change else joined, np.uint8)
        inside = is_word[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), self.start, side="right")
        self.count = np.bincount(self.text, minlength=len(raw))
        n = len(self.data) + 1
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]))
            self.unpower = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BACK, np.uint64)]))
        self.sums = self.running(self.data, np.arange(len(self.data)))

    def running(self, values: np.ndarray, exponent: np.ndarray) -> np.ndarray:
        """Sums of value + 1 times the base to the exponent, from the start."""
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * self.power[exponent], out=out[1:])
        return out

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of stretches of ``data``: polynomial, from the running sums, then scrambled."""
        return scramble((self.sums[end] - self.sums[start]) * self.unpower[start])
