"""Positions in a total order without a single-task window.

Rows are range-partitioned by the order, numbered inside their partition, and shifted by the sizes of the partitions
before. A hot group is spread over as many partitions as its share of the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage


def _with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with what their slice inherits; a NULL group is a group like any other."""
    named = carry.select(*[F.col(k).alias("_of_" + k) for k in keys], *[c for c in carry.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col("_of_" + k)) for k in keys]
    return rows.join(named, same).drop(*["_of_" + k for k in keys])


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """Adds a 0-based ``name`` per group in ascending ``order``; the order must be total inside a group.

    The range split depends on sampling, so it is checkpointed: both uses below see the same split, also after an
    executor is lost.
    """
    cols = [F.col(c) for c in [*group, *order]]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = cut_lineage(df.repartitionByRange(n, *cols).withColumn("_pid", F.spark_partition_id()))
    keys = [*group, "_pid"]
    sizes = split.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1
    return (
        _with_carry(split.withColumn("_local", local), offsets, keys)
        .withColumn(name, (F.col("_local") + F.col("_off")).cast("bigint")).drop("_pid", "_local", "_off"))


def scan_in_order(df: DataFrame, group: list[str], order: list[str], sums: dict | None = None, lags: dict | None = None,
                  fills: dict | None = None, partitions: int | None = None) -> DataFrame:
    """Running values per group in a total order, without gathering a hot group in one task.

    ``sums``: name -> numeric Column, inclusive running sum. ``lags``: name -> Column, value of the row before. ``fills``:
    name -> Column, last non-null value up to this row. Each range slice is scanned on its own and receives what the
    slices before it add up to.
    """
    sums, lags, fills = sums or {}, lags or {}, fills or {}
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = df
    for pre, items in (("_s_", sums), ("_l_", lags), ("_f_", fills)):
        for name, c in items.items():
            work = work.withColumn(pre + name, c)
    split = cut_lineage(work.repartitionByRange(n, *[F.col(c) for c in [*group, *order]]).withColumn("_pid", F.spark_partition_id()))
    keys = [*group, "_pid"]
    at = F.struct(*order)
    aggs = [F.count("*").alias("_n")]
    aggs += [F.sum("_s_" + k).alias("_ts_" + k) for k in sums]
    aggs += [F.max_by(F.struct(F.col("_l_" + k).alias("v")), at).alias("_tl_" + k) for k in lags]
    aggs += [F.max_by("_f_" + k, F.when(F.col("_f_" + k).isNotNull(), at)).alias("_tf_" + k) for k in fills]
    slices = split.groupBy(*keys).agg(*aggs)
    w = W.partitionBy(*group).orderBy("_pid")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    carry = slices.select(*keys, *[F.coalesce(F.sum("_ts_" + k).over(before), F.lit(0)).alias("_cs_" + k) for k in sums],
                          *[F.lag("_tl_" + k).over(w)["v"].alias("_cl_" + k) for k in lags],
                          *[F.last("_tf_" + k, ignorenulls=True).over(before).alias("_cf_" + k) for k in fills])
    lw = W.partitionBy(*keys).orderBy(*order)
    out = split.withColumn("_first", F.row_number().over(lw) == 1)
    for k in sums:
        out = out.withColumn("_s_" + k, F.sum("_s_" + k).over(lw.rowsBetween(W.unboundedPreceding, 0)))
    for k in lags:
        out = out.withColumn("_l_" + k, F.lag("_l_" + k).over(lw))
    for k in fills:
        out = out.withColumn("_f_" + k, F.last("_f_" + k, ignorenulls=True).over(lw.rowsBetween(W.unboundedPreceding, 0)))
    out = _with_carry(out, carry, keys)
    cols = list(df.columns)
    return out.select(*cols, *[(F.col("_s_" + k) + F.col("_cs_" + k)).alias(k) for k in sums],
                      *[F.when(F.col("_first"), F.col("_cl_" + k)).otherwise(F.col("_l_" + k)).alias(k) for k in lags],
                      *[F.coalesce("_f_" + k, "_cf_" + k).alias(k) for k in fills])
