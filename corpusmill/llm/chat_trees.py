"""Chat formatting of reply trees.

Messages point to their parents. Rounds of a self-join double how far up each message sees (the ancestor 1, 2, 4 ... steps
above, steps and summed score so far), until all see past their root. A leaf's branch has the mean score of its messages; the
best ``branches`` of each tree are chosen, ties by the leaf's id, and only those paths are enumerated, by the same doubling.
Each becomes one conversation.

The template marks turns as ``<|im_start|>role``, newline, text, newline, ``<|im_end|>``, newline. Control strings inside texts
get a backslash before the backslashes that stand before them already; taking it away again restores the text. Roles are
URL-encoded. The loss mask covers the texts of assistant turns as spans of code points.

Null texts are empty, null roles too; a parent that isn't there makes a root; messages on a cycle of parents are on no path.
Messages that repeat a (tree, id) are an error of the input: make ids unique first, as ``linear`` does for repeated rows. A
null tree is a tree of its own. Only column expressions and joins are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.common import let, stored

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = r"(<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>)"


def linear(rows: DataFrame, tree_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages of conversations without branches: each turn answers the one before. Rows that share a turn follow each other
    by role and text; repeated rows all stay."""
    turns = rows.groupBy(F.col(tree_col).alias("tree")).agg(F.sort_array(F.collect_list(F.struct(
        F.col(order_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))).alias("turns"))
    return turns.select("tree", F.posexplode("turns").alias("id", "t")).select(
        "tree", F.col("id").cast("bigint").alias("id"), F.when(F.col("id") > 0, F.col("id") - 1).cast("bigint").alias("parent"), "t.role", "t.text", F.lit(0.0).alias("score"))


def _same(a: str, b: str, key_a: str, key_b: str) -> Column:
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{key_a}") == F.col(f"{b}.{key_b}"))


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, id, above) of the messages on the chosen paths; ``above`` counts the steps up from the leaf."""
    own = stored(messages.select("tree", "id", "parent", "score"), "messages")
    known = own.select("tree", F.col("id").alias("known"))
    state = stored(own.alias("m").join(known.alias("k"), _same("m", "k", "parent", "known"), "left").select(
        F.col("m.tree"), F.col("m.id"), F.col("k.known").alias("up"), F.lit(1).cast("bigint").alias("steps"), F.coalesce("m.score", F.lit(0.0)).alias("total")), "state")
    jumps, reach, most = [], 1, own.count()
    while state.filter("up is not null").limit(1).count() and reach <= most:
        jumps.append(state)
        climbing = state.filter("up is not null").alias("a").join(state.alias("b"), _same("a", "b", "up", "id")).select(
            "a.tree", "a.id", F.col("b.up").alias("up"), (F.col("a.steps") + F.col("b.steps")).alias("steps"), (F.col("a.total") + F.col("b.total")).alias("total"))
        state = stored(state.filter("up is null").unionByName(climbing), "state")        # what has reached its root joins no more
        reach *= 2
    leaves = state.filter("up is null").alias("s").join(own.alias("c"), _same("s", "c", "id", "parent"), "left_anti").select("tree", "id", (F.col("total") / F.col("steps")).alias("mean"))
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("mean"), "id"))
    path = stored(leaves.withColumn("rank", rank).filter(F.col("rank") <= branches).select("tree", F.col("id").alias("leaf"), "rank", "id", F.lit(0).cast("bigint").alias("above")), "paths")
    for k, jump in enumerate(jumps):
        step = path.alias("p").join(jump.alias("j"), _same("p", "j", "id", "id")).filter("j.up is not null")
        path = stored(path.unionByName(step.select("p.tree", "p.leaf", "p.rank", F.col("j.up").alias("id"), (F.col("p.above") + 2 ** k).alias("above"))), "paths")
    return path


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)(\\*+)" + _CONTROL, r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?<!\\)\\(\\*+)" + _CONTROL, "$1$2")


def conversations(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, leaf, rank, formatted, loss spans): one row for each chosen path."""
    path = best_paths(messages, branches)
    said = path.alias("p").join(messages.alias("m"), _same("p", "m", "id", "id")).select("p.tree", "p.leaf", "p.rank", (-F.col("above")).alias("at"),
                                                                                    F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.text", F.lit("")).alias("text"))
    turns = said.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("at", (F.col("role") == loss_role).alias("loss"), F.concat(F.lit(START), F.url_encode("role"), F.lit("\n")).alias("head"),
                                                                                     escape(F.col("text")).alias("body")))).alias("t"))
    tail = f"\n{END}\n"

    def place(t: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

        def turn(a, x):
            begin = a.at + F.length(x.head)
            end = begin + F.length(x.body)
            span = F.when(x.loss, F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
            return F.struct((end + len(tail)).alias("at"), F.concat(a.spans, span).alias("spans"))
        return F.aggregate(t, zero, turn)

    return turns.select("tree", "leaf", "rank", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "").alias("formatted"), place(F.col("t")).spans.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(formatted, r"(?<!\\)<\|im_start\|>")
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: let(F.substring_index(p, "\n", 1), lambda role: F.struct(
        F.url_decode(role).alias("role"), unescape(F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - len(f"\n{END}\n"))).alias("text"))))


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s.start + 1, s.end - s.start))), "")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  sum(length(role) + length(text) + 25 + len(regexp_extract_all(text,
    '<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>'))) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
