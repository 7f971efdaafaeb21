"""Models over feature tables: scaling, ridge, forests, boosting, calibration, components, and the scoring pipeline."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import dot, mapped_score
from ..functions.storage import kept

FAMILIES = {
    "forest": lambda: RandomForestClassifier(numTrees=50, minInstancesPerNode=5, seed=42, weightCol="weight"),
    "boosting": lambda: GBTClassifier(maxIter=20, seed=42, weightCol="weight"),
    "logistic": lambda: LogisticRegression(weightCol="weight"),
    "linear_svm": lambda: LinearSVC(weightCol="weight"),
}
REGRESSORS = {"forest": lambda: RandomForestRegressor(numTrees=20, minInstancesPerNode=5, seed=42), "boosting": lambda: GBTRegressor(maxIter=10, maxDepth=6, stepSize=0.05, seed=42)}


def perceptron(inputs: int) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=[inputs, 16, 2], seed=42, maxIter=50)


def fourier_features(rows: DataFrame, names: list[str], dims: int = 128, gamma: float | None = None, seed: int = 42) -> DataFrame:
    """M8: ``rows`` with ``features``, a vector of ``dims`` random Fourier features of the standardised columns: their products
    tend to the radial kernel ``exp(-gamma d^2)``, so a linear machine on them is a kernel machine whose cost grows with the
    rows and not with their square. ``gamma``: one over the number of columns unless given."""
    import numpy as np

    from .spectra import transformed

    rng = np.random.default_rng(seed)
    w = rng.standard_normal((len(names), dims)) * np.sqrt(2 * (gamma or 1 / len(names)))
    b = rng.uniform(0, 2 * np.pi, dims)
    z = standardised(rows, names).withColumn("fourier_in", vector_to_array("features")).drop("features")
    out = transformed(z, "fourier_in", "fourier", lambda x: np.sqrt(2 / dims) * np.cos(x @ w + b))
    return out.withColumn("features", array_to_vector("fourier")).drop("fourier_in", "fourier")


def standardised(rows: DataFrame, names: list[str]) -> DataFrame:
    """M9: ``features`` as a vector of the columns less their means, divided by population deviations (1 for constants)."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names])
    z = [(F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in names]
    return rows.crossJoin(F.broadcast(stats)).withColumn("features", array_to_vector(F.array(*z))).drop(*stats.columns)


def weighted(rows: DataFrame, label: str = "label") -> DataFrame:
    """Class weights n / (classes * n of the class)."""
    n = rows.groupBy(label).agg(F.count("*").alias("c"))
    total = n.agg(F.sum("c").alias("t"), F.count("*").alias("k"))
    w = n.crossJoin(total).select(label, (F.col("t") / (F.col("k") * F.col("c"))).alias("weight"))
    return rows.join(F.broadcast(w), label)


def ridge(rows: DataFrame, target: str, alpha: float) -> LinearRegression:
    """M6: the estimator whose solution is closed-form ridge with penalty ``alpha``, for this training set."""
    s = rows.agg(F.count("*").alias("n"), F.stddev_pop(target).alias("s")).head()
    return LinearRegression(labelCol=target, elasticNetParam=0.0, standardization=False, solver="normal", regParam=alpha * s["s"] / s["n"] if s["n"] else 0.0)


def ridge_path(rows: DataFrame, target: str, folds: int = 5, alphas: int = 50) -> tuple[float, DataFrame]:
    """M6: the penalty of least squared error over hashed folds, and the error of each.

    Errors of all penalties come from sufficient statistics: per fold the Gram matrix of features and target, one
    aggregation whose size is the square of the number of features.
    """
    import numpy as np

    x = vector_to_array("features")
    n = rows.select(F.size(x).alias("n")).head()["n"]
    z = F.concat(x, F.array(F.lit(1.0), F.col(target).cast("double")))
    size = n + 2
    outer = F.flatten(F.transform(z, lambda a: F.transform(z, lambda b: a * b)))
    folded = rows.select(F.pmod(F.xxhash64(x, F.col(target)), F.lit(folds)).alias("fold"), F.posexplode(outer).alias("at", "v")).groupBy("fold", "at").agg(F.sum("v").alias("v"))
    gram = np.zeros((folds, size * size))
    for r in folded.collect():  # folds * (features + 2) squared numbers
        gram[r["fold"], r["at"]] = r["v"]
    gram = gram.reshape(folds, size, size)
    found = []
    for alpha in np.logspace(-3, 3, alphas):
        error = 0.0
        for k in range(folds):
            g = gram.sum(axis=0) - gram[k]
            a = g[:-1, :-1] + np.diag([alpha] * n + [0.0])
            w = np.append(np.linalg.lstsq(a, g[:-1, -1], rcond=None)[0], -1.0)
            error += float(w @ gram[k] @ w)
        found.append((float(alpha), error))
    return min(found, key=lambda p: p[1])[0], rows.sparkSession.createDataFrame(found, "alpha double, error double")


def importances(model, names: list[str], spark) -> DataFrame:
    """``feature, importance, rank`` of a fitted tree model."""
    rows = spark.createDataFrame([(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())], "feature string, importance double")
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc("importance"), "feature")))


def prune_by_importance(rows: DataFrame, names: list[str], share: float = 0.005, rounds: int = 20) -> list[str]:
    """M3: drop features of less than ``share`` of the largest importance until none is left to drop."""
    for _ in range(rounds):
        data = VectorAssembler(inputCols=names, outputCol="features").transform(weighted(rows))
        values = FAMILIES["forest"]().fit(data).featureImportances.toArray()
        kept = [n for n, v in zip(names, values) if v >= share * values.max()]
        if len(kept) == len(names):
            break
        names = kept
    return names


def cells(rows: DataFrame, target: str) -> DataFrame:
    """``features, weight``, and ``target``'s mean: a row per distinct vector. What trees of squared error gain by a split
    depends on counts and sums of the target alone, so trees that draw no rows are the same on cells as on rows."""
    x = rows.groupBy(vector_to_array("features").alias("x")).agg(F.avg(target).alias(target), F.count("*").cast("double").alias("weight"))
    return x.select(array_to_vector("x").alias("features"), target, "weight")


def regressor_errors(data: DataFrame, target: str) -> DataFrame:
    """M7: ``family, n, rmse, r2`` on fold 0 of regressors fitted on the rest (``features``, ``fold``). Boosting, which takes
    all rows in each of its rounds, is fitted on their ``cells``; forests draw rows and keep them."""
    train, test = data.where("fold <> 0"), data.where("fold = 0")
    y = F.col(target)
    out = None
    for name, make in REGRESSORS.items():
        model = make().setLabelCol(target)
        if name == "boosting":
            model = model.setWeightCol("weight").fit(kept(cells(train, target), "cells"))
        else:
            model = model.fit(train)
        e = model.transform(test).withColumn("e", y - F.col("prediction"))
        one = e.agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse"), (1 - F.try_divide(F.avg(F.col("e") * F.col("e")), F.var_pop(y))).alias("r2")).select(F.lit(name).alias("family"), "n", "rmse", "r2")
        out = one if out is None else out.unionByName(one)
    return out


def plane(rows: DataFrame) -> DataFrame:
    """``rows`` with ``x, y``, the centred ``features`` on their first two principal components; a component's sign
    is that which makes its largest loading positive."""
    import numpy as np

    pc = PCA(k=2, inputCol="features", outputCol="pc").fit(rows).pc.toArray()
    pc = pc * np.sign(pc[np.abs(pc).argmax(axis=0), [0, 1]])
    v = vector_to_array("features")
    mean = rows.select(F.posexplode(v).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).orderBy("pos").collect()
    shift = np.array([r["m"] for r in mean]) @ pc
    on = [dot(v, F.array(*[F.lit(float(w)) for w in pc[:, k]])) - float(shift[k]) for k in (0, 1)]
    return rows.withColumn("x", on[0]).withColumn("y", on[1]).drop("features")


def components_for(rows: DataFrame, share: float, inputs: int) -> tuple[int, object]:
    """M9: the fewest principal components that explain ``share`` of the variance, and the fitted transform."""
    variance = PCA(k=inputs, inputCol="features", outputCol="pc").fit(rows).explainedVariance.toArray()
    k = next((i + 1 for i in range(inputs) if variance[: i + 1].sum() >= share - 1e-12), inputs)
    return k, PCA(k=k, inputCol="features", outputCol="pc").fit(rows)


def calibrated(rows: DataFrame, label: str = "label", p: str = "p"):
    """Isotonic calibration, clipped to what was seen."""
    return IsotonicRegression(labelCol=label, featuresCol=p, predictionCol="calibrated").fit(rows)


def scoring_pipeline(names: list[str], classifier) -> Pipeline:
    """Assemble and classify; scores come from ``scored``."""
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), classifier])


def save(model: PipelineModel, path: str) -> None:
    """The fitted pipeline under a new path of a file system that driver and executors share."""
    model.write().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def scored(model: PipelineModel, rows: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with ``p`` and the integer ``quality``; missing or non-finite features count as 0."""
    clean = rows.withColumns({n: F.coalesce(F.when(F.isnan(F.col(n)) | (F.abs(F.col(n)) == math.inf), None).otherwise(F.col(n)), F.lit(0.0)) for n in names})
    out = model.transform(clean).withColumn("p", vector_to_array("probability")[1])
    return out.withColumn("quality", mapped_score(F.col("p"))).drop("features", "rawPrediction", "probability", "prediction")
