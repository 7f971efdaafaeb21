"""Queries that fit models or run streams."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..functions.storage import kept, shared_path
from ..operators import bags as bg
from ..operators import components as cp
from ..operators import families as fm
from ..operators import models as md
from ..operators import spectra as sp
from ..sources import tables as src
from ..streaming import frames as sf
from . import signals as sg
from .registry import query, rounded

NAMES = ["quantity", "discount", "tax"]


def _regression(spark, folder):
    l = src.table(spark, folder, "lineitem")
    return l.select(F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"), (F.col("l_extendedprice") / 1000).alias("target"))


def _labelled(spark, folder):
    d = src.labelled(spark, folder).withColumn("x3", (F.col("row_idx") % 29).cast("double"))
    return d.select("row_idx", F.col("label").cast("double").alias("label"), F.col("score").cast("double").alias("x1"), F.col("score_v").cast("double").alias("x2"), "x3")


@query()
def m6_ridge(spark, folder):
    """M6: ridge coefficients on standardised features."""
    rows = md.standardised(_regression(spark, folder), NAMES)
    m = md.ridge(rows, "target", 10.0).fit(rows)
    return rounded(spark.createDataFrame([*zip(NAMES, map(float, m.coefficients)), ("intercept", float(m.intercept))], "feature string, coefficient double"))


@query()
def m6_ridge_path(spark, folder):
    """M6: cross-validated error of 50 penalties."""
    return md.ridge_path(md.standardised(_regression(spark, folder), NAMES), "target")[1]


@query()
def m3_forest_importances(spark, folder):
    """Importances of a balanced forest."""
    data = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(md.weighted(_labelled(spark, folder)))
    return rounded(md.importances(md.FAMILIES["forest"]().fit(data), ["x1", "x2", "x3"], spark))


@query()
def m3_pruned_features(spark, folder):
    """M3: what is left after dropping features of less than 0.5 % of the largest importance; ``x4`` is constant."""
    return spark.createDataFrame([(n,) for n in md.prune_by_importance(_labelled(spark, folder).withColumn("x4", F.lit(1.0)), ["x1", "x2", "x3", "x4"])], "feature string")


FOLD = "('0x' || substr(md5(doc_id || '|42'), 1, 8))::BIGINT % 5"


def _folded(spark, folder):
    """Labelled rows with two families of features and folds, written once for the fits over them."""
    return kept(fm.folded(_labelled(spark, folder).withColumn("x4", (F.col("row_idx") % 31).cast("double")), "row_idx"), "folded")


S, V = ["x1", "x3"], ["x2", "x4"]


@query(f"SELECT ({FOLD})::INT AS fold, quality AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def m5_folds(spark, folder):
    """M5: rows of each class in each fold that models are judged on."""
    return _folded(spark, folder).groupBy("fold", F.col("label").cast("long").alias("label")).agg(F.count("*").alias("n"))


@query()
def m5_grid(spark, folder):
    """M5: settings of a forest by held-out accuracy, and the cross-validation of the best two."""
    return rounded(fm.grid(_folded(spark, folder), S + V, [10, 20, 40], ["sqrt", "all"]))


@query()
def m7_regressors(spark, folder):
    """M7: error and explained variance on held-out rows of a forest and of boosted trees."""
    rows = fm.folded(_regression(spark, folder).withColumn("row_idx", F.concat_ws("/", *NAMES, "target")), "row_idx")
    data = kept(VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows).select("features", "target", "fold"), "folded")
    return rounded(md.regressor_errors(data, "target"))


@query()
def m13_combined(spark, folder):
    """M13 A: cross-validated accuracy of either family and both, with paired tests."""
    return rounded(fm.combined(_folded(spark, folder), S, V))


@query()
def m13_redistribution(spark, folder):
    """M13 C: importances in the combined model against each family's own."""
    return rounded(fm.redistribution(_folded(spark, folder), S, V))


@query()
def m13_ablation(spark, folder):
    """M13 D: loss of accuracy where a family's columns are permuted, ten seeds."""
    return rounded(fm.ablation(_folded(spark, folder), "row_idx", S, V))


@query()
def m13_cross_prediction(spark, folder):
    """M13 E: whether one family foretells the other's decisions."""
    return rounded(fm.cross_prediction(_folded(spark, folder), S, V))


@query()
def m13_held_out(spark, folder):
    """M13 F: either family and both on held-out rows."""
    return rounded(fm.held_out_comparison(_folded(spark, folder), S, V))


@query()
def m18_plane(spark, folder):
    """Embeddings on their first two principal components, each signed so that its largest loading is positive."""
    e = src.embeddings(spark, folder).select("row_idx", F.col("speaker"), md.array_to_vector("v").alias("features"))
    return rounded(md.plane(e).select("row_idx", "speaker", "x", "y"))


@query()
def m8_model_families(spark, folder):
    """M8: area under the ROC curve, on held-out rows, of each family of classifiers."""
    from ..operators.evaluation import roc_auc

    data = kept(VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="features").transform(md.weighted(_folded(spark, folder))).select("label", "weight", "features", "fold"), "folded")
    radial = kept(md.fourier_features(md.weighted(_folded(spark, folder)), ["x1", "x2", "x3"]).select("label", "weight", "features", "fold"), "folded")
    out = None
    for name, make in (md.FAMILIES | {"perceptron": lambda: md.perceptron(3), "radial_svm": md.FAMILIES["linear_svm"]}).items():
        rows = radial if name == "radial_svm" else data
        raw = make().fit(rows.where("fold <> 0")).transform(rows.where("fold = 0"))
        one = roc_auc(raw.select("label", md.vector_to_array("rawPrediction")[1].alias("score")), []).withColumn("family", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out.select("family", "auc"))


@query()
def m12_isotonic(spark, folder):
    """Calibrated probability of each distinct score."""
    rows = _labelled(spark, folder).withColumn("p", F.col("x1") / 100)
    return rounded(md.calibrated(rows).transform(rows.select("p").distinct()))


@query()
def m9_principal_components(spark, folder):
    """M9: how many components explain 90 % of the variance."""
    rows = md.standardised(_regression(spark, folder), NAMES)
    k, _ = md.components_for(rows, 0.9, len(NAMES))
    return spark.createDataFrame([(0.9, k)], "share double, components int")


@query()
def m17_score_samples(spark, folder):
    """Integer quality of every labelled sample from a pipeline fitted without fold 0, saved and loaded."""
    rows = md.weighted(_folded(spark, folder))
    path = shared_path(spark, "model")
    md.save(md.scoring_pipeline(["x1", "x2", "x3"], md.FAMILIES["forest"]()).fit(rows.where("fold <> 0")), path)
    return rounded(md.scored(md.load(path), rows, ["x1", "x2", "x3"]).select("row_idx", "p", "quality", (F.col("fold") == 0).alias("held_out")))


@query()
def m17_file_scores(spark, folder):
    """From WAV files to scores in one job: decoding, levels and spectra of frames, their statistics, and a pipeline that is
    fitted without fold 0, saved and loaded. Every third recording is labelled good."""
    decoded = sp.decoded(sg.wav_files(spark, folder)).where("error is null")
    x = decoded.select("rec_id", sp.normalised(F.col("samples")).alias("samples"))
    plain, power = sp.framed(x, sg.S), sp.powered(sp.framed(x, sg.S, "zero"), sg.S)
    found = sp.frame_features(sp.level_measures(plain)).unionByName(sp.frame_features(sp.spectral_measures(power, sg.S)))
    names = {m: [f"{m}_{c}" for c in ("Mean", "Std", "Median")] for m in ("FrameE", "FrameSNR", "FrameSF", "FrameSE", "FrameSR")}
    cell = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    wide = found.groupBy("rec_id").agg(*[cell(m, n.split("_")[1]) for m, own in names.items() for n in own])
    features = [n for own in names.values() for n in own]
    rows = kept(fm.folded(wide.withColumn("label", (F.col("rec_id") % 3 == 0).cast("double")), "rec_id"), "file-features")
    path = shared_path(spark, "model")
    train = md.weighted(rows.where("fold <> 0")).fillna(0.0, features)
    md.save(md.scoring_pipeline(features, md.FAMILIES["forest"]()).fit(train), path)
    return rounded(md.scored(md.load(path), rows, features).select("rec_id", "p", "quality", (F.col("fold") == 0).alias("held_out")))


def _stream(spark, folder, stream, keys):
    base = shared_path(spark, "stream")
    sf.run_to_end(stream, f"{base}/state", f"{base}/out")
    return sf.latest(spark, f"{base}/out", keys)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, ((value >= 100)::INT + (value >= 200)::INT + (value >= 300)::INT)::INT AS bin, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def s1_streamed_histogram(spark, folder):
    """H1 as a stream: daily histogram of frame values."""
    found = _stream(spark, folder, sf.windowed_histogram(sf.read_events(spark, folder), [100, 200, 300]), ["start", "bin"])
    return rounded(found.select(F.col("start").cast("timestamp_ntz").alias("start"), "bin", "n", "mean"))


@query("WITH e AS (SELECT user_id AS rec_id, ts, value, (ts - lag(ts) OVER w >= INTERVAL 6 HOUR)::INT AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(coalesce(b, 0)) OVER (PARTITION BY rec_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e) SELECT rec_id, min(ts)::TIMESTAMP AS start, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS peak FROM s GROUP BY rec_id, s")
def s2_sessions(spark, folder):
    """Sessions of a recording's events, by the batch form of the streaming operator."""
    e = src.table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("rec_id"), "value")
    return rounded(sf.sessions(e).select("rec_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", "mean", "peak"))


DIMENSIONS = [f"e{k:02d}" for k in range(64)]


def _dimensions(spark, folder):
    """Embeddings as rows of 64 features. Each is cast by itself: one taken out of a cast array casts the array anew."""
    return src.table(spark, folder, "embeddings").select(*[F.get("embedding", k).cast("double").alias(n) for k, n in enumerate(DIMENSIONS)])


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS k FROM embeddings) SELECT 'e' || lpad(a.k::VARCHAR, 2, '0') AS a, 'e' || lpad(b.k::VARCHAR, 2, '0') AS b, round(corr(a.v, b.v), 6) AS r FROM e a JOIN e b USING (vec_id) WHERE a.k < b.k GROUP BY a.k, b.k")
def r12_feature_matrix(spark, folder):
    """Correlations of all pairs of 64 features, from one aggregate of products."""
    return rounded(cp.correlation_rows(_dimensions(spark, folder), DIMENSIONS))


@query()
def r12_feature_merges(spark, folder):
    """Average linkage of 64 features by correlation distance, a row per merge; tested against brute force."""
    return rounded(cp.clustered(cp.correlation_rows(_dimensions(spark, folder), DIMENSIONS)))


@query()
def r12_feature_clusters(spark, folder):
    """The tree cut where correlations fall below a half."""
    return cp.feature_clusters(cp.correlation_rows(_dimensions(spark, folder), DIMENSIONS), 0.5)


@query()
def m10_parallel_analysis(spark, folder):
    """Eigenvalues of 64 features against the 95th percentile of 100 permutations of their columns."""
    return rounded(cp.parallel_analysis(_dimensions(spark, folder), DIMENSIONS))


@query()
def m10_independent(spark, folder):
    """Mixing weights of eight independent components of 64 features."""
    mixing = cp.independent(kept(_dimensions(spark, folder), "dimensions"), DIMENSIONS, 8)[1]
    rows = [(k + 1, n, float(mixing[i, k])) for i, n in enumerate(DIMENSIONS) for k in range(mixing.shape[1])]
    return rounded(spark.createDataFrame(rows, "component int, feature string, weight double"), 4)


@query()
def m11_factor_sweep(spark, folder):
    """Bayesian information of factor models of 64 features, coarse and fine."""
    return rounded(cp.factor_sweep(_dimensions(spark, folder), DIMENSIONS, start=2, stop=26, step=6, half=1, fine=2), 4)


_TIMES = " + ".join(f"(u >= {p!r})::INT" for p in bg.POISSON)


@query(f"WITH t AS (SELECT unnest(range(5)) AS tree), u AS (SELECT tree, ('0x' || substr(md5(doc_id || '|' || tree || '|42'), 1, 8))::BIGINT / 4294967296 AS u FROM labels JOIN documents USING (doc_id), t) SELECT tree::INT AS tree, ({_TIMES})::INT AS times, count(*) AS n FROM u GROUP BY ALL")
def m5_bag_weights(spark, folder):
    """M5: how often the first five trees draw how many rows."""
    rows = _labelled(spark, folder).select("row_idx", F.explode(F.array(*map(F.lit, range(5)))).alias("tree"))
    times = sum((F.when(F.col("tree") == t, bg.draws(F.col("row_idx"), t)).otherwise(0) for t in range(5)), F.lit(0))
    return rows.groupBy("tree", times.alias("times")).agg(F.count("*").alias("n"))


@query()
def m5_out_of_bag(spark, folder):
    """M5: out-of-bag accuracy of the first 5, 10 and 20 trees, and the smallest forest that has converged."""
    rows = _labelled(spark, folder).withColumn("x4", (F.col("row_idx") % 31).cast("double"))
    cast = bg.votes(rows, "row_idx", ["x1", "x2", "x3", "x4"], 20)
    return rounded(bg.convergence(bg.out_of_bag(cast, "row_idx", [5, 10, 20]), least=10))
