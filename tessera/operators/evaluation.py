"""Does quality predict verification error: reject curves, detection error tradeoff, quadrants, classifier metrics.

Pair tables are ``(genuine int, score double, q, *keys)``. Curves are computed in one pass: pairs are reduced to counts
per integer quality or per threshold interval (map-side), and windows run over those few rows. Thresholds are rounded
to 9 places, as the scores are, before anything is compared with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import ratio
from .order import matched, percentiles, running

PLACES = 9
BINS = [(0, 20, "very_low"), (21, 40, "low"), (41, 60, "medium"), (61, 80, "high"), (81, 100, "very_high")]


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def total_if(n: Column, c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, n).otherwise(0)), F.lit(0)).cast("long")


def error_rates(pairs: DataFrame, tau: float) -> DataFrame:
    """Shares of genuine scores below and of impostor scores at or above ``tau``; null on an empty side."""
    gen, imp = F.col("genuine") == 1, F.col("genuine") == 0
    return pairs.agg(F.avg(F.when(gen, (F.col("score") < tau).cast("int"))).alias("fnmr"), F.avg(F.when(imp, (F.col("score") >= tau).cast("int"))).alias("fmr"))


def percentile_tau(pairs: DataFrame, share: float, genuine: int, keys: list[str]) -> DataFrame:
    """Linear-interpolated percentile of one class's scores, by key."""
    return percentiles(pairs.where(F.col("genuine") == genuine), keys, "score", [share]).select(*keys, F.round(F.col("pct")[0], PLACES).alias("tau"))


def reject_curve(pairs: DataFrame, fnmr: float, keys: list[str]) -> DataFrame:
    """``*keys, t, n_gen, n_imp, reject_frac, fnmr, fmr`` for t = 0..100, keeping pairs of quality ``q >= t``.

    ``pairs`` is read four times: pass a written table where it is dear. For whole t, q >= t is floor(q) >= t, so counts per floor(q) and their sums from above give every row. Rejection is
    relative to all pairs; rates are null where no pair is kept.
    """
    tau = percentile_tau(pairs, fnmr, 1, keys)
    bucket = F.greatest(F.lit(-1), F.least(F.lit(100), F.floor("q"))).cast("int")
    cells = pairs.withColumn("t", bucket).join(F.broadcast(tau), keys)
    gen, imp = F.col("genuine") == 1, F.col("genuine") == 0
    cells = cells.groupBy(*keys, "t").agg(
        count_if(gen).alias("g"), count_if(imp).alias("i"), count_if(gen & (F.col("score") < F.col("tau"))).alias("ge"), count_if(imp & (F.col("score") >= F.col("tau"))).alias("ie")
    )
    return curve_of(cells, tau, keys)


def curve_of(cells: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """The curve of counts ``*keys, t, g, i, ge, ie``: genuine and impostor pairs of quality t, those in error; a row set for
    each key of ``present``."""
    grid = present.select(*keys, F.explode(F.sequence(F.lit(-1), F.lit(100))).alias("t"))
    above = W.partitionBy(*keys).orderBy(F.desc("t"))
    total = W.partitionBy(*keys)
    dense = grid.join(cells, [*keys, "t"], "left").fillna(0, ["g", "i", "ge", "ie"])
    summed = dense.select(*keys, "t", *[F.sum(c).over(above).alias(c) for c in ("g", "i", "ge", "ie")], F.sum(F.col("g") + F.col("i")).over(total).alias("all"))
    return summed.where("t >= 0").select(
        *keys, "t", F.col("g").alias("n_gen"), F.col("i").alias("n_imp"), (1 - ratio(F.col("g") + F.col("i"), F.col("all"))).alias("reject_frac"),
        ratio(F.col("ge"), F.col("g")).alias("fnmr"), ratio(F.col("ie"), F.col("i")).alias("fmr"),
    )


def strategies(pairs: DataFrame, s: str, v: str, keys: list[str]) -> DataFrame:
    """The pair table once for each way to combine two qualities, as ``strategy`` and ``q``."""
    ways = [("s_only", F.col(s)), ("v_only", F.col(v)), ("reject_if_either", F.least(s, v)), ("reject_if_both", F.greatest(s, v))]
    stacked = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), q.cast("double").alias("q")) for n, q in ways])).alias("w")
    return pairs.select(*keys, "genuine", "score", stacked).select(*keys, "genuine", "score", "w.strategy", "w.q")


def fnmr_reduction(curve: DataFrame, keys: list[str], targets: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """E5: at the row whose rejection is nearest to each target (first on ties), the FNMR's reduction in percent of that
    at t = 0 (0 where that is 0 or nothing is kept), and the rejection that the row has."""
    goals = curve.withColumn("target", F.explode(F.array(*[F.lit(x) for x in targets])))
    near = F.struct(F.round(F.abs(F.col("reject_frac") - F.col("target")), PLACES).alias("d"), F.col("t"))
    picked = goals.groupBy(*keys, "target").agg(F.min_by(F.struct("fnmr", "reject_frac"), near).alias("at"), F.min_by("fnmr", "t").alias("base"))
    share = F.coalesce((1 - ratio(F.col("at.fnmr"), F.col("base"))) * 100, F.lit(0.0))
    return picked.select(*keys, "target", share.alias("reduction"), F.col("at.reject_frac").alias("actual_reject_frac"))


def relative_reduction(curve: DataFrame, keys: list[str], targets: tuple[float, ...] = (0.1, 0.2, 0.3)) -> DataFrame:
    """As ``fnmr_reduction``, but null where an error is null or that at t = 0 is 0: nothing is put in its place."""
    goals = curve.withColumn("target", F.explode(F.array(*[F.lit(x) for x in targets])))
    near = F.struct(F.round(F.abs(F.col("reject_frac") - F.col("target")), PLACES).alias("d"), F.col("t"))
    picked = goals.groupBy(*keys, "target").agg(F.min_by("fnmr", near).alias("at"), F.min_by("fnmr", "t").alias("base"))
    return picked.select(*keys, "target", (ratio(F.col("base") - F.col("at"), F.col("base")) * 100).alias("reduction"))


def det(pairs: DataFrame, keys: list[str], points: int = 500) -> DataFrame:
    """``*keys, i, threshold, fmr, fnmr`` at ``points`` evenly spaced thresholds from the least to the largest score.

    A score is reduced to how many thresholds it reaches; the guess by division is put right by comparing with its two
    neighbours, so counts are those of the comparisons themselves.
    """
    ends = pairs.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    rows = pairs.join(F.broadcast(ends), keys)
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    at = lambda i: F.col("lo") + i * step
    guess = F.coalesce(F.floor(F.try_divide(F.col("score") - F.col("lo"), step)), F.lit(points - 1))
    rows = rows.withColumn("g", guess).withColumn("reached", F.least(F.lit(points), F.col("g") + 1 + F.when(F.col("score") >= at(F.col("g") + 1), 1).otherwise(0) - F.when(F.col("score") < at(F.col("g")), 1).otherwise(0)))
    cells = rows.groupBy(*keys, "reached").agg(count_if(F.col("genuine") == 1).alias("g"), count_if(F.col("genuine") == 0).alias("m"))
    return det_of(ends, cells, keys, points)


def det_of(ends: DataFrame, cells: DataFrame, keys: list[str], points: int = 500) -> DataFrame:
    """The tradeoff from the ends ``*keys, lo, hi`` and counts ``*keys, reached, g, m`` by how many thresholds are reached."""
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    at = lambda i: F.col("lo") + i * step
    grid = ends.withColumn("reached", F.explode(F.sequence(F.lit(0), F.lit(points)))).withColumn("threshold", at(F.col("reached")))
    dense = grid.join(cells, [*keys, "reached"], "left").fillna(0, ["g", "m"])
    upto, total = W.partitionBy(*keys).orderBy("reached"), W.partitionBy(*keys)
    below = dense.select(*keys, F.col("reached").alias("i"), "threshold", F.sum("g").over(upto).alias("gen"), F.sum("m").over(upto).alias("imp"), F.sum("g").over(total).alias("gs"), F.sum("m").over(total).alias("ms"))
    return below.where(F.col("i") < points).select(*keys, "i", "threshold", (1 - ratio(F.col("imp"), F.col("ms"))).alias("fmr"), ratio(F.col("gen"), F.col("gs")).alias("fnmr"))


def equal_error(curve: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of FMR and FNMR at the first threshold where they differ least."""
    near = F.struct(F.round(F.abs(F.col("fmr") - F.col("fnmr")), PLACES).alias("d"), F.col("i"))
    return curve.groupBy(*keys).agg(F.min_by((F.col("fmr") + F.col("fnmr")) / 2, near).alias("eer"), F.min_by("threshold", near).alias("threshold"))


def fnmr_at_fmr(pairs: DataFrame, keys: list[str], fmrs: tuple[float, ...] = (0.01, 0.001)) -> DataFrame:
    """FNMR at the impostor percentile of 100 (1 - fmr)."""
    impostor = percentiles(pairs.where("genuine = 0"), keys, "score", [1 - f for f in fmrs])
    goals = [F.struct(F.lit(f).alias("target_fmr"), F.round(F.col("pct")[k], PLACES).alias("tau")) for k, f in enumerate(fmrs)]
    taus = impostor.select(*keys, F.explode(F.array(*goals)).alias("x")).select(*keys, "x.target_fmr", "x.tau")
    below = F.avg(F.when(F.col("genuine") == 1, (F.col("score") < F.col("tau")).cast("int")))
    return pairs.join(F.broadcast(taus), keys).groupBy(*keys, "target_fmr").agg(F.max("tau").alias("tau"), below.alias("fnmr"))


def ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs with the group of their quality: below P15 bottom, above P85 top, else middle."""
    edges = percentiles(pairs, keys, "q", [0.15, 0.85]).withColumnRenamed("pct", "e")
    group = F.when(F.col("q") < F.col("e")[0], "bottom").when(F.col("q") > F.col("e")[1], "top").otherwise("middle")
    return pairs.join(F.broadcast(edges), keys).withColumn("grp", group).drop("e")


def quadrant(s: Column, v: Column, s_mid: Column, v_mid: Column) -> Column:
    """1 both high, 2 only v high, 3 both low, 4 only s high; at the middle is high."""
    return F.when((s >= s_mid) & (v >= v_mid), 1).when((s < s_mid) & (v >= v_mid), 2).when((s < s_mid) & (v < v_mid), 3).otherwise(4)


def monotone(curve: DataFrame, order: str, value: str, keys: list[str], slack: float = 0.02) -> DataFrame:
    """Whether ``value`` never rises over its predecessor by more than ``slack`` of the first; nulls are left out."""
    w = W.partitionBy(*keys).orderBy(order)
    rows = curve.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("x"), F.lag(value).over(w).alias("p"), F.first(value).over(w).alias("f"))
    return rows.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("x") <= F.col("p") + slack * F.col("f"), F.lit(True))).alias("monotone"))


def confusion(rows: DataFrame, threshold: float) -> DataFrame:
    """Counts and accuracy, precision, recall, F1 of ``score >= threshold`` against ``label``; 0 for 0 / 0."""
    rows = rows.where(F.col("label").isNotNull())
    yes, true = F.col("score") >= threshold, F.col("label") == 1
    c = rows.agg(count_if(yes & true).alias("tp"), count_if(yes & ~true).alias("fp"), count_if(~yes & true).alias("fn"), count_if(~yes & ~true).alias("tn"))
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", zero(tp + tn, tp + fp + fn + tn).alias("accuracy"), zero(tp, tp + fp).alias("precision"), zero(tp, tp + fn).alias("recall"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"))


def by_score(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each distinct score its positives ``p`` and negatives ``n``, those up to it and those of the key."""
    per = rows.groupBy(*keys, "score").agg(count_if(F.col("label") == 1).alias("p"), count_if(F.col("label") == 0).alias("n"))
    return running(per, keys, ["score"], ["p", "n"])


def roc_points(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each distinct score from above, what is at or above it: ``tp, fp, tpr, fpr, precision``."""
    at_least = lambda c: (F.col(f"all_{c}") - F.col(f"upto_{c}") + F.col(c)).alias({"p": "tp", "n": "fp"}[c])
    c = by_score(rows, keys).select(*keys, "score", "p", at_least("p"), at_least("n"), F.col("all_p").alias("ps"), F.col("all_n").alias("ns"))
    return c.select(*keys, "score", "p", "tp", "fp", ratio(F.col("tp"), F.col("ps")).alias("tpr"), ratio(F.col("fp"), F.col("ns")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), "ps")


def roc_auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties a half, from counts per distinct score."""
    c = by_score(rows, keys).withColumn("u", F.col("p") * (F.col("upto_n") - F.col("n") / 2.0))
    groups = c.groupBy(*keys) if keys else c.groupBy()
    return groups.agg(ratio(F.sum("u"), F.sum("p") * F.sum("n")).alias("auc"))


def mann_whitney(rows: DataFrame) -> DataFrame:
    """U of the positives from average ranks, which all rows of a score share."""
    both = F.col("upto_p") + F.col("upto_n")
    rank = both - (F.col("p") + F.col("n") - 1) / 2.0
    n1 = F.coalesce(F.sum("p"), F.lit(0))
    c = by_score(rows, []).agg(F.sum(F.col("p") * rank).alias("s"), n1.alias("n1"), F.coalesce(F.sum("n"), F.lit(0)).alias("n0"))
    return c.select((F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2.0).alias("u"), "n1", "n0")


def youden(points: DataFrame) -> DataFrame:
    """The highest threshold of the largest tpr - fpr."""
    best = F.struct(F.round(F.col("tpr") - F.col("fpr"), PLACES).alias("j"), F.col("score"))
    return points.agg(F.max(best).alias("b")).select(F.col("b.score").alias("threshold"), F.col("b.j").alias("j"))


def average_precision(points: DataFrame) -> DataFrame:
    return points.agg(F.sum(F.col("precision") * F.col("p") / F.col("ps")).alias("auc_pr"))


def calibration_bins(rows: DataFrame, bins: int = 10, last_closed: bool = True) -> DataFrame:
    """Per bin of probability ``p`` the count, mean of p and share of label 1; bins are closed below."""
    b = F.floor(F.col("p") * bins)
    b = F.least(b, F.lit(bins - 1)) if last_closed else F.when(b < bins, b)
    return rows.withColumn("bin", b.cast("int")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("label").cast("double")).alias("share"))


def calibration_error(bins: DataFrame, total: Column | None = None) -> DataFrame:
    """Expected and largest calibration error."""
    gap = F.abs(F.col("mean_p") - F.col("share"))
    return bins.agg((F.sum(gap * F.col("n")) / (F.sum("n") if total is None else total)).alias("ece"), F.max(gap).alias("mce"))


def quality_bin(score: Column) -> Column:
    """Named bins on integers; a value between two of them is in none."""
    out = None
    for lo, hi, name in BINS:
        inside = (score >= lo) & (score <= hi)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def ecdf(rows: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """Sorted values of each group with i / n; equal values keep steps of their own, in the order of ``key``."""
    x = running(rows.select(group, key, value, F.lit(1).alias("one")), [group], [value, key], ["one"])
    return x.select(group, key, value, (F.col("upto_one") / F.col("all_one")).alias("cdf"))


def ks_statistic(rows: DataFrame) -> DataFrame:
    """Largest difference of the two classes' distribution functions."""
    return by_score(rows, []).agg(F.max(F.abs(F.col("upto_p") / F.col("all_p") - F.col("upto_n") / F.col("all_n"))).alias("ks"))
