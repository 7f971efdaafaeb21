"""Scalar and column rules that the operators share: rounding, guarded statistics, NaN handling, portable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NaN and infinities become null, so that aggregates skip them and comparisons are false."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def half_even(x: Column, places: int = 0) -> Column:
    return F.bround(x, places)


def mapped_score(p: Column) -> Column:
    """Probability to an integer score 0..100, half to even."""
    return F.least(F.greatest(F.bround(p * 100), F.lit(0)), F.lit(100)).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, null where ``b`` is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are present; 0 where either is constant or nothing is there."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def average_rank(value: str, *groups: str) -> Column:
    """Rank from 1 in which ties share their mean rank."""
    within = W.partitionBy(*groups).orderBy(value)
    peers = W.partitionBy(*groups, value)
    return F.rank().over(within) + (F.count(F.lit(1)).over(peers) - 1) / 2.0


def portable_hash(*parts: Column) -> Column:
    """Hex that any engine with md5 reproduces; nulls are empty."""
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def nearest_index(n_from: Column, n_to: Column, i: Column) -> Column:
    """Index in a mask of ``n_from`` entries for frame ``i`` of ``n_to``: round half even of an even spacing."""
    return F.when(n_to > 1, F.bround(i * (n_from - 1) / (n_to - 1).cast("double"))).otherwise(F.lit(0)).cast("int")


def unit(v: Column) -> Column:
    """L2-normalised array of doubles; vectors of norm 1e-12 or less stay as they are."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n > 1e-12, n).otherwise(F.lit(1.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def moment_skew(x: Column) -> Column:
    return F.coalesce(F.skewness(x), F.lit(0.0))


def excess_kurtosis(x: Column) -> Column:
    return F.coalesce(F.kurtosis(x), F.lit(0.0))
