"""M5: forests whose trees know which rows they left out.

Each tree draws a row as often as a Poisson number with mean one says, by a portable hash of the row's key and the tree, as
a bootstrap of many rows does. A tree is fitted on the rows that it drew and votes on those that it did not; the majority of
these votes is the out-of-bag decision. Trees are jobs of their own; votes are rows.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import portable_hash
from ..functions.storage import kept
from .models import weighted

#: Distribution function of the Poisson number of mean one, at 0 to 7. Fixed values.
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]


def draws(key: Column, tree: int, seed: int = 42) -> Column:
    """How often a tree draws a row: 0 to 8."""
    share = F.conv(F.substring(portable_hash(key, F.lit(tree), F.lit(seed)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return sum((F.when(share >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def votes(rows: DataFrame, key: str, names: list[str], trees: int, subset: str = "sqrt", depth: int = 8, seed: int = 42) -> DataFrame:
    """``key, label, tree, vote`` of every tree on the rows that it left out; written once. Classes are balanced."""
    data = kept(VectorAssembler(inputCols=names, outputCol="features").transform(weighted(rows)).select(key, "label", "weight", "features"), "bag-rows")
    out = None
    for t in range(trees):
        bagged = data.withColumn("times", draws(F.col(key), t, seed))
        tree = RandomForestClassifier(numTrees=1, bootstrap=False, featureSubsetStrategy=subset, maxDepth=depth, minInstancesPerNode=5, seed=seed + t, weightCol="drawn")
        model = tree.fit(bagged.where("times > 0").withColumn("drawn", F.col("weight") * F.col("times")))
        one = model.transform(bagged.where("times = 0")).select(key, "label", F.lit(t).alias("tree"), F.col("prediction").alias("vote"))
        out = one if out is None else out.unionAll(one)
    return kept(out, "bag-votes")


def out_of_bag(cast: DataFrame, key: str, counts: list[int]) -> DataFrame:
    """``trees, n, oob_accuracy, oob_error`` of the first ``trees`` trees for each of ``counts``, of ``votes``; ``n`` is the
    number of rows that some tree left out. The larger label wins a tie."""
    sizes = F.explode(F.array(*map(F.lit, counts))).alias("trees")
    rows = cast.select(key, "label", "vote", "tree", sizes).where(F.col("tree") < F.col("trees"))
    # by row and forest, counted before the shuffle
    best = rows.groupBy("trees", key, "label", "vote").agg(F.count("*").alias("c")).groupBy("trees", key, "label").agg(F.max(F.struct("c", "vote")).alias("m"))
    a = best.groupBy("trees").agg(F.count("*").alias("n"), F.avg((F.col("m.vote") == F.col("label")).cast("double")).alias("oob_accuracy"))
    return a.select("trees", "n", "oob_accuracy", (1 - F.col("oob_accuracy")).alias("oob_error"))


def convergence(curve: DataFrame, least: int = 200, slack: float = 0.001) -> DataFrame:
    """``curve`` with ``converged``: true for the smallest forest of ``least`` trees or more whose error is within ``slack``
    of the least error of all, or for the largest forest if there is none."""
    low = curve.agg(F.min("oob_error").alias("low"), F.max("trees").alias("most"))
    rows = curve.join(F.broadcast(low))  # one row
    fit = rows.agg(F.coalesce(F.min(F.when((F.col("oob_error") <= F.col("low") + slack) & (F.col("trees") >= least), F.col("trees"))), F.max("most")).alias("at"))
    return curve.join(F.broadcast(fit)).withColumn("converged", F.col("trees") == F.col("at")).drop("at")
