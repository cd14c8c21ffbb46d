"""Integer ratios and scores. Everything published is an integer, so results are equal on any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PPM = 1_000_000
SCORE_DECIMAL = "decimal(28,12)"


def _idiv(a: Column, b: Column) -> Column:
    """Integer division that yields NULL, not an error, on a zero divisor."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def ppm(numer: Column, denom: Column, empty: int = 0) -> Column:
    """Parts per million, rounded half up; ``empty`` where there is no denominator."""
    n, d = numer.cast("bigint"), denom.cast("bigint")
    return F.when(d <= 0, F.lit(empty).cast("bigint")).otherwise(
        _idiv(n * PPM + _idiv(d, F.lit(2)), d)).cast("bigint")


def ppm_floor(numer: Column, denom: Column) -> Column:
    n, d = numer.cast("bigint"), denom.cast("bigint")
    return F.when(d <= 0, F.lit(0).cast("bigint")).otherwise(_idiv(n * PPM, d)).cast("bigint")


def mean_ppm(total: Column, n: Column) -> Column:
    """Half-up integer mean of a non-negative ppm total over n values; 0 when n is 0."""
    return F.when(n <= 0, F.lit(0).cast("bigint")).otherwise(
        _idiv(total + _idiv(n, F.lit(2)), n)).cast("bigint")


def millionths(x: Column) -> Column:
    """Non-negative score to integer millionths, rounded half up."""
    return F.when(x <= 0, F.lit(0).cast("bigint")).otherwise(
        F.floor(x * F.lit(PPM) + F.lit(0.5).cast("decimal(3,1)")).cast("bigint"))


def rrf_term(rank: Column, k: int = 60) -> Column:
    """One reciprocal-rank contribution in millionths: round-half-up(10^6 / (k + rank)); 0 without a rank."""
    d = rank.cast("bigint") + F.lit(k).cast("bigint")
    return F.when(rank >= 1, _idiv(F.lit(PPM).cast("bigint") + _idiv(d, F.lit(2)), d)).otherwise(
        F.lit(0).cast("bigint")).cast("bigint")


def discount_millionths(rank: Column) -> Column:
    """round(log2(rank + 1) * 10^6): the nDCG discount."""
    return F.floor(F.log2(rank.cast("double") + 1) * PPM + 0.5).cast("bigint")


def gain(rank: Column) -> Column:
    return _idiv(F.lit(PPM * PPM).cast("bigint"), discount_millionths(rank))


def lsum(c: Column) -> Column:
    """Sum as bigint, 0 over nothing."""
    return F.coalesce(F.sum(c.cast("bigint")), F.lit(0).cast("bigint"))


def lcount(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")
