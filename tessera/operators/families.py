"""What two families of features tell together: combined model, importances, ablation, cross-prediction, hold-out.

Rows are ``(key, label double, *features, fold int)``; folds are portable hashes of the key, so every engine sees the
same split. A model is fitted on the rows outside a fold and judged on those inside.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import correlation, portable_hash, ratio
from ..functions.storage import kept
from .evaluation import roc_auc
from .models import vector_to_array, weighted
from .order import running
from .statistics import permuted_block


def folded(rows: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``rows`` with ``fold``, 0 to ``folds - 1``: the first eight hex digits of a portable hash of key and seed."""
    h = F.conv(F.substring(portable_hash(F.col(key), F.lit(seed)), 1, 8), 16, 10).cast("long")
    return rows.withColumn("fold", (h % folds).cast("int"))


def forest(trees: int = 20, subset: str = "sqrt", depth: int = 8) -> RandomForestClassifier:
    """Leaves of five rows at least and balanced classes, as all forests here."""
    return RandomForestClassifier(numTrees=trees, featureSubsetStrategy=subset, maxDepth=depth, minInstancesPerNode=5, seed=42, weightCol="weight")


def fitted(train: DataFrame, names: list[str], label: str = "label", model=None):
    data = train if label == "label" else train.drop("label").withColumnRenamed(label, "label")
    return (model or forest()).fit(VectorAssembler(inputCols=names, outputCol="features").transform(weighted(data)))


def predicted(model, rows: DataFrame, names: list[str], name: str) -> DataFrame:
    """``rows`` with the decision ``name`` and its probability ``p_<name>``."""
    out = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    return out.withColumn(name, F.col("prediction")).withColumn(f"p_{name}", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def accuracy(rows: DataFrame, decision: str, truth: str = "label") -> float:
    return rows.agg(F.avg((F.col(decision) == F.col(truth)).cast("int")).alias("a")).head()["a"] or 0.0


def grid(rows: DataFrame, names: list[str], trees: list[int], subsets: list[str], top: int = 2, folds: int = 5) -> DataFrame:
    """M5: ``trees, subset, held_out, cv_mean, cv_std``: accuracy of each setting on fold 0 (the library has no out-of-bag
    estimate), and over all folds of the ``top`` best, null for the others."""
    score = lambda t, s, k: accuracy(predicted(fitted(rows.where(F.col("fold") != k), names, model=forest(t, s)), rows.where(F.col("fold") == k), names, "d"), "d")
    first = sorted(((score(t, s, 0), t, s) for t in trees for s in subsets), key=lambda r: (-r[0], r[1], r[2]))
    found = []
    for place, (a, t, s) in enumerate(first):
        each = [a, *[score(t, s, k) for k in range(1, folds)]] if place < top else []
        mean = sum(each) / len(each) if each else None
        found.append((t, s, float(a), mean, math.sqrt(sum((x - mean) ** 2 for x in each) / len(each)) if each else None))
    return rows.sparkSession.createDataFrame(found, "trees int, subset string, held_out double, cv_mean double, cv_std double")


def converged(curve: list[tuple[int, float]], least: int = 200, slack: float = 0.001) -> int | None:
    """M5: the first number of trees, ``least`` or more, whose accuracy is within ``slack`` of the largest forest's."""
    curve = sorted(curve)
    return next((t for t, a in curve if t >= least and abs(a - curve[-1][1]) <= slack), None)


def paired_t(a: list[float], b: list[float]) -> tuple[float, float]:
    """Paired t and its two-sided p for five folds (four degrees of freedom, where the tail has a closed form)."""
    d = [x - y for x, y in zip(a, b, strict=True)]
    if len(d) != 5:
        raise ValueError("five folds are needed")
    mean = sum(d) / 5
    var = sum((x - mean) ** 2 for x in d) / 4
    if var == 0:
        return (0.0, 1.0) if mean == 0 else (math.copysign(math.inf, mean), 0.0)
    t = mean / math.sqrt(var / 5)
    u = t * t / (1 + t * t / 4)
    return t, max(0.0, 1 - 0.75 * math.sqrt(u) * (1 - u / 12))


def combined(rows: DataFrame, s: list[str], v: list[str]) -> DataFrame:
    """M13 A: ``config, n_features, cv_mean, cv_std, t, p_value, significant`` of either family and both; t compares the
    folds with those of both families, significant at 0.05 / 3."""
    sets = {"s_only": s, "v_only": v, "combined": s + v}
    each = {c: [accuracy(predicted(fitted(rows.where(F.col("fold") != k), n), rows.where(F.col("fold") == k), n, "d"), "d") for k in range(5)] for c, n in sets.items()}
    out = []
    for c, a in each.items():
        t, p = (None, None) if c == "combined" else paired_t(each["combined"], a)
        mean = sum(a) / 5
        out.append((c, len(sets[c]), mean, math.sqrt(sum((x - mean) ** 2 for x in a) / 5), t, p, None if p is None else p < 0.05 / 3))
    return rows.sparkSession.createDataFrame(out, "config string, n_features int, cv_mean double, cv_std double, t double, p_value double, significant boolean")


def redistribution(rows: DataFrame, s: list[str], v: list[str]) -> DataFrame:
    """M13 C: ``feature, origin, importance, rank, solo_rank, rank_shift``: importances in the combined model, and how far
    each feature moved from its rank among its own family."""

    def ranks(names: list[str]) -> dict[str, tuple[float, int]]:
        values = fitted(rows, names).featureImportances.toArray()
        return {n: (float(values[i]), place + 1) for place, (i, n) in enumerate(sorted(enumerate(names), key=lambda x: (-values[x[0]], x[1])))}

    both, solo = ranks(s + v), ranks(s) | ranks(v)
    found = [(n, "s" if n in s else "v", x, r, solo[n][1], solo[n][1] - r) for n, (x, r) in both.items()]
    return rows.sparkSession.createDataFrame(found, "feature string, origin string, importance double, rank int, solo_rank int, rank_shift int")


def ablation(rows: DataFrame, key: str, s: list[str], v: list[str], seeds: int = 10) -> DataFrame:
    """M13 D: ``seed, baseline, drop_s, drop_v``: accuracy of the combined model on all rows, and what it loses where one
    family's columns come from other rows."""
    names = s + v
    model = fitted(rows, names)
    loss = lambda block, seed: accuracy(predicted(model, permuted_block(rows, key, block, seed), names, "d"), "d")
    base = accuracy(predicted(model, rows, names, "d"), "d")
    found = [(k, base, base - loss(s, 2 * k + 1), base - loss(v, 2 * k + 2)) for k in range(seeds)]
    return rows.sparkSession.createDataFrame(found, "seed int, baseline double, drop_s double, drop_v double")


def cross_prediction(rows: DataFrame, s: list[str], v: list[str]) -> DataFrame:
    """M13 E: agreement, kappa and rank correlation of the two families' models, and how well either family foretells the
    other's decisions, judged on fold 0."""
    x = predicted(fitted(rows, v), predicted(fitted(rows, s), rows, s, "by_s"), v, "by_v")
    x = kept(x.withColumnsRenamed({"p_by_s": "p_s", "p_by_v": "p_v"}), "predicted")
    a, b = F.col("by_s"), F.col("by_v")
    po = x.agg(F.avg((a == b).cast("int")).alias("po"), F.avg(a).alias("a"), F.avg(b).alias("b"))
    pe = F.col("a") * F.col("b") + (1 - F.col("a")) * (1 - F.col("b"))

    def ranks(column: str) -> DataFrame:
        per = running(x.groupBy(F.col(column).alias("x")).agg(F.count("*").alias("c")), [], ["x"], ["c"])
        return per.select(F.col("x").alias(column), (F.col("upto_c") - (F.col("c") - 1) / 2.0).alias(f"r_{column}"))

    rho = x.groupBy("p_s", "p_v").count().join(ranks("p_s"), "p_s").join(ranks("p_v"), "p_v")
    rho = rho.select("r_p_s", "r_p_v", F.explode(F.sequence(F.lit(1), F.col("count")))).agg(correlation(F.col("r_p_s"), F.col("r_p_v")).alias("rho"))
    train, test = x.where("fold <> 0"), x.where("fold = 0")
    sv = accuracy(predicted(fitted(train, s, "by_v"), test, s, "d"), "d", "by_v")
    vs = accuracy(predicted(fitted(train, v, "by_s"), test, v, "d"), "d", "by_s")
    return po.select(F.col("po").alias("agreement"), ratio(F.col("po") - pe, 1 - pe).alias("kappa")).crossJoin(rho).select("agreement", "kappa", "rho", F.lit(sv).alias("s_to_v"), F.lit(vs).alias("v_to_s"))


def held_out_comparison(rows: DataFrame, s: list[str], v: list[str]) -> DataFrame:
    """M13 F: ``config, n, accuracy, auc`` on fold 0 of models fitted on the rest."""
    train, test = rows.where("fold <> 0"), rows.where("fold = 0")
    out = None
    for c, names in {"s_only": s, "v_only": v, "combined": s + v}.items():
        d = kept(predicted(fitted(train, names), test, names, "d").select(F.col("label").cast("int").alias("label"), "d", F.col("p_d").alias("score")), "judged")
        one = d.agg(F.count("*").alias("n"), F.avg((F.col("d") == F.col("label")).cast("int")).alias("accuracy")).crossJoin(roc_auc(d, [])).select(F.lit(c).alias("config"), "n", "accuracy", "auc")
        out = one if out is None else out.unionByName(one)
    return out
