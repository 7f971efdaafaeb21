"""Exact order statistics by key: running sums, ranks and percentiles of which no key's rows meet in one task.

A key may hold all rows, so a window over a key's sorted rows is one task's work. Here rows are cut into ranges of the
sort order, sums of the ranges before come from one small table, and windows run inside ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import kept


def matched(a: DataFrame, b: DataFrame, keys: list[str], small: bool = False) -> DataFrame:
    """``a`` with the other columns of ``b``, inner, null keys equal. ``small``: ``b`` has a few rows for each of a
    caller's fixed keys (systems, strategies, classes) or ranges, and goes to the tasks whole."""
    b = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    b = F.broadcast(b) if small else b
    if not keys:
        return a.crossJoin(b)
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b, on).drop(*[f"_{k}" for k in keys])


def running(rows: DataFrame, keys: list[str], order: list[str], sums: list[str]) -> DataFrame:
    """``rows`` with ``upto_<c>``, the sum of ``c`` over the key's rows up to this one, and ``all_<c>`` over all of them.

    ``order`` must tell a key's rows apart; ascending, nulls first. Ranges are Spark's, over keys and order together, and
    are written, since a second sample would cut elsewhere. Ranges and their sums are as many as shuffle partitions.
    """
    placed = kept(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    per = placed.groupBy(*keys, "_part").agg(*[F.sum(c).alias(c) for c in sums])
    one = W.partitionBy(*keys)
    before = one.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per = per.select(*keys, "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before_{c}") for c in sums], *[F.sum(c).over(one).alias(f"all_{c}") for c in sums])
    inside = W.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    upto = [(F.col(f"_before_{c}") + F.sum(c).over(inside)).alias(f"upto_{c}") for c in sums]
    return matched(placed, per, [*keys, "_part"], small=True).select(*rows.columns, *upto, *[f"all_{c}" for c in sums])


def average_ranks(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the rank of ``value`` from 1 within its key, ties sharing their mean rank."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    upto = running(counts, keys, [value], ["_c"])
    return matched(rows, upto.select(*keys, value, (F.col("upto__c") - (F.col("_c") - 1) / 2).alias(name)), [*keys, value])


#: Bounds of cells by approximate quantiles, one less than a power of two, and equal parts of each.
CUTS, PARTS = 1023, 64


def cells_of(x: DataFrame, keys: list[str]) -> DataFrame:
    """``x(*keys, x)`` with ``cell``, which never falls as ``x`` rises: approximate quantiles of the key cut its values into
    cells of about as many rows each, whatever outliers there are, and each of these is cut into equal parts."""
    shares = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    ends = x.groupBy(*keys).agg(F.array_sort(F.percentile_approx("x", shares, 10_000)).alias("cuts"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    placed = matched(x, ends, keys, small=True)
    # how many cuts are up to x, by halving
    at, step = F.lit(0), (CUTS + 1) // 2
    while step:
        at = at + F.when(F.get("cuts", at + (step - 1)) <= F.col("x"), step).otherwise(0)
        placed = placed.withColumn("at", at)
        at, step = F.col("at"), step // 2
    low = F.when(F.col("at") == 0, F.col("lo")).otherwise(F.get("cuts", F.col("at") - 1))
    high = F.when(F.col("at") == CUTS, F.col("hi")).otherwise(F.get("cuts", F.col("at")))
    share = F.coalesce(F.try_divide(F.col("x") / 2 - low / 2, high / 2 - low / 2), F.lit(0.0))  # halves, for sums of extremes overflow
    part = F.greatest(F.least(F.floor(share * PARTS), F.lit(PARTS - 1)), F.lit(0))
    return placed.select(*keys, "x", (F.col("at") * PARTS + part).alias("cell"))


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """``*keys, pct array<double>``: linearly interpolated percentiles of the non-null values, as of a sorted list.

    Counts by cell (map-side) say which cells hold the wanted ranks; only rows of those are counted by value, and only a
    cell's distinct values are ordered in one task: cells have about as many rows each, however the values lie. The cells
    save work and decide nothing: ranks are exact. ``rows`` is read three times. A key without values has no row; without
    keys and values there is one row of nulls, as of any aggregate.
    """
    x = rows.select(*keys, F.col(value).cast("double").alias("x")).where("x is not null")
    placed = cells_of(x, keys)
    one = W.partitionBy(*keys)
    n = placed.groupBy(*keys, "cell").agg(F.count("*").alias("c"))
    n = n.select(*keys, "cell", "c", F.sum("c").over(one.orderBy("cell")).alias("upto"), F.sum("c").over(one).alias("n"))
    ranks = [f(F.lit(p) * (F.col("n") - 1)) for p in shares for f in (F.floor, F.ceil)]
    inside = lambda r: (r >= F.col("upto") - F.col("c")) & (r < F.col("upto"))
    wanted = F.lit(False)
    for r in ranks:
        wanted = wanted | inside(r)
    n = n.where(wanted).select(*keys, "cell", (F.col("upto") - F.col("c")).alias("before"), "n")
    counted = matched(placed, n, [*keys, "cell"], small=True).groupBy(*keys, "cell", "x", "before", "n").agg(F.count("*").alias("c"))
    found = counted.withColumn("upto", F.col("before") + F.sum("c").over(W.partitionBy(*keys, "cell").orderBy("x")))
    picked = found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(inside(r), F.col("x"))).alias(f"r{k}") for k, r in enumerate(ranks)])

    def between(k: int, p: float):
        low, high, where = F.col(f"r{2 * k}"), F.col(f"r{2 * k + 1}"), F.lit(p) * (F.col("n") - 1)
        return low + (high - low) * (where - F.floor(where))

    return picked.select(*keys, F.array(*[between(k, p) for k, p in enumerate(shares)]).alias("pct"))
