"""Training labels from provider scores: thresholds, gates, discriminability, balancing, targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import portable_hash, ratio
from .order import percentiles


def thresholds(genuine: DataFrame, impostor: DataFrame) -> DataFrame:
    """A5: per provider the 90th percentile of genuine and the 99.9th of impostor scores."""
    a = percentiles(genuine, ["provider"], "score", [0.9]).select("provider", F.round(F.col("pct")[0], 9).alias("percentile_90"))
    b = percentiles(impostor, ["provider"], "score", [0.999]).select("provider", F.round(F.col("pct")[0], 9).alias("fmr_001"))
    return a.join(b, "provider")


def wide_scores(scores: DataFrame, providers: list[str]) -> DataFrame:
    """``row_idx, score_<provider>...`` from long scores, by one aggregation instead of a join for each provider."""
    return scores.groupBy("row_idx").agg(*[F.max(F.when(F.col("provider") == p, F.col("score"))).alias(f"score_{p}") for p in providers])


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def label(wide: DataFrame, limits: DataFrame, providers: list[str], use_duration: bool = True) -> DataFrame:
    """0 where all scores are below the impostor threshold (or the recording is shorter than 1.5 s), else 1
    where all are at their 90th percentile or above (and it has 3 s or more), else null. A failed duration of -1 is short."""
    one = limits.groupBy().agg(*[F.max(F.when(F.col("provider") == p, F.col(c))).alias(f"{c}_{p}") for p in providers for c in ("percentile_90", "fmr_001")])
    rows = wide.crossJoin(F.broadcast(one))
    high = [F.col(f"score_{p}") >= F.col(f"percentile_90_{p}") for p in providers]
    low = [F.col(f"score_{p}") < F.col(f"fmr_001_{p}") for p in providers]
    c1 = _all([*high, *([F.col("duration") >= 3.0] if use_duration else [])])
    c0 = _all(low) | (F.coalesce(F.col("duration") < 1.5, F.lit(False)) if use_duration else F.lit(False))
    return rows.withColumn("label", F.when(c0, 0).when(c1, 1)).select(*wide.columns, "label")


def fisher(genuine: DataFrame, impostor: DataFrame) -> DataFrame:
    """A3: per provider and speaker (mean - impostor mean) / (std of ddof 1, 0 for one, + impostor std of ddof 0)."""
    mu = impostor.groupBy("provider").agg(F.avg("score").alias("mu"), F.stddev_pop("score").alias("sigma"))
    per = genuine.groupBy("provider", "speaker").agg(F.avg("score").alias("m"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("s"))
    return per.join(F.broadcast(mu), "provider").select("provider", "speaker", ratio(F.col("m") - F.col("mu"), F.col("s") + F.col("sigma")).alias("fisher"))


def fisher_mean(per_provider: DataFrame) -> DataFrame:
    """A4: mean over the providers that have a value."""
    return per_provider.groupBy("speaker").agg(F.avg("fisher").alias("fisher_mean"))


def balanced(rows: DataFrame, label: str, key: str, seed: str) -> DataFrame:
    """As many rows of each class as the smallest has, in hash order. Counts per hash prefix say how many rows stand
    before a prefix, so rows are only ranked within a prefix and no class is sorted as a whole."""
    n = rows.groupBy(label).agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    hashed = rows.withColumn("h", portable_hash(F.col(key), F.lit(seed))).withColumn("prefix", F.substring("h", 1, 3))
    per = hashed.groupBy(label, "prefix").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(W.partitionBy(label).orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("before", before).crossJoin(F.broadcast(n)).where("before < least").select(label, "prefix", "before", "least")
    place = F.col("before") + F.row_number().over(W.partitionBy(label, "prefix").orderBy("h", key))
    return hashed.join(F.broadcast(per), [label, "prefix"]).withColumn("place", place).where("place <= least").select(*rows.columns)


def regression_target(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of the scores, scaled to 0..1 by its extremes and clipped."""
    mean = sum(F.col(c) for c in columns[1:]) + F.col(columns[0])
    rows = wide.withColumn("fused", mean / len(columns))
    ends = rows.agg(F.min("fused").alias("lo"), F.max("fused").alias("hi"))
    scaled = F.least(F.greatest(ratio(F.col("fused") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    return rows.crossJoin(F.broadcast(ends)).select("row_idx", scaled.alias("target"))


def target_statistics(rows: DataFrame, column: str) -> DataFrame:
    """Count, mean, std (ddof 0), extremes, median, biased skewness and excess kurtosis."""
    x = F.col(column)
    moments = rows.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"))
    return moments.join(percentiles(rows, [], column, [0.5]).select(F.col("pct")[0].alias("median")), how="left")


def score_statistics(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Count, missing, mean, std (ddof 0), extremes."""
    x = F.col(column)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), (F.count("*") - F.count(x)).alias("n_missing"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
