"""What the Python workers hold: bounded arrays over a slice, and nothing of an operator that is not running."""

import sys
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import byte_bpe, common, quality_mil


def test_arrays_over_a_large_batch_are_bounded():
    batch = pa.record_batch({"text": ["some words of a text " * 100] * 2000})
    tracemalloc.start()
    rows = 0
    for part in common._portions(batch, [0]):
        rows += len(quality_mil.encode_passages(part.column(0).to_pylist())[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and peak < 40e6


def test_a_task_lets_go_of_what_others_left(spark):
    one = spark.range(1).select(F.lit("x").alias("text")).coalesce(1)

    def start(name):
        def begin():
            common.process_memory(name)[1] = 2
            kept = sorted(k for k in vars(sys.modules["_corpusmill_process"]) if not k.startswith("__"))
            return lambda texts: [pa.array([",".join(kept)] * len(texts))]
        return begin

    seen = lambda name: common.append_columns(one, ["text"], [T.StructField("kept", T.StringType())], start(name), uses=name).first().kept
    assert [seen(n) for n in ("a", "b", "b")] == ["a", "b", "b"]


def test_the_tokeniser_remembers_what_its_size_says():
    codec = byte_bpe.Codec({bytes([b]): b for b in range(256)}, r" ?\w+| +", most=200)
    for i in range(3000):
        assert codec.ids(f"a{i} b{i}").tobytes() == b"".join(bytes([b, 0, 0, 0]) for b in f"a{i} b{i}".encode())
    held = {n: len(m) + len(m.older) for n, m in (("following", codec.following), ("opening", codec.opening), ("known", codec.known))}
    assert held["following"] <= 200 and held["opening"] <= 20 and held["known"] == 0    # single pre-tokens are held once


def test_a_task_gives_its_memory_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    monkeypatch.setattr(common, "forget", lambda but=None: None)

    class Table:
        columns, schema = ["text"], T.StructType([T.StructField("text", T.StringType())])

        def mapInArrow(self, run, schema):
            return list(run(iter([pa.record_batch({"text": ["x"]})])))

    assert len(common.append_columns(Table(), ["text"], [T.StructField("n", T.StringType())], lambda: lambda texts: [texts])) == 1 and calls == [1]
