import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import semantics as sm
from tessera.operators import evaluation as ev
from tessera.operators import frames as fr
from tessera.operators import labels as lb
from tessera.operators import models as md
from tessera.operators import statistics as st
from tessera.plans.classification import mcnemar, verdict
from tessera.plans.recordings import random_pairs


def scores(spark, values, genuine=1):
    return spark.createDataFrame([(genuine, float(v)) for v in values], "genuine int, score double")


@pytest.mark.parametrize(("values", "tau", "want"), [([0.8, 0.9, 0.7, 0.85], 0.5, 0.0), ([0.8, 0.9, 0.7, 0.85], 1.0, 1.0), ([0.3, 0.7, 0.2, 0.8], 0.5, 0.5)])
def test_false_non_match_rate(spark, values, tau, want):
    assert ev.error_rates(scores(spark, values), tau).head()["fnmr"] == want


def test_false_match_rate_and_empty_sides(spark):
    imp = scores(spark, [0.1, 0.2, 0.3, 0.4], 0)
    assert ev.error_rates(imp, 0.5).head()["fmr"] == 0 and ev.error_rates(imp, 0.0).head()["fmr"] == 1
    assert ev.error_rates(imp, 0.5).head()["fnmr"] is None


@pytest.mark.parametrize(("rows", "want"), [([(80, 80), (20, 80), (20, 20), (80, 20), (50, 50)], [1, 2, 3, 4, 1])])
def test_quadrants(spark, rows, want):
    d = spark.createDataFrame([(k, s, v) for k, (s, v) in enumerate(rows)], "k int, s int, v int")
    assert [r.q for r in d.select("k", ev.quadrant(F.col("s"), F.col("v"), F.lit(50), F.lit(50)).alias("q")).orderBy("k").collect()] == want


@pytest.mark.parametrize(("curve", "want"), [([0.5, 0.4, 0.3, 0.2, 0.1], True), ([0.5] * 3, True), ([0.5, 0.4, 0.6, 0.3], False), ([0.5, 0.4, 0.405, 0.35], True), ([None, 0.5, 0.4], True)])
def test_monotone(spark, curve, want):
    d = spark.createDataFrame([(0, k, v) for k, v in enumerate(curve)], "k int, t int, x double")
    assert ev.monotone(d, "t", "x", ["k"]).head()["monotone"] is want


@pytest.fixture(scope="module")
def separated(spark):
    """Genuine scores that follow quality, impostor scores that do not."""
    rng = np.random.default_rng(7)
    q = rng.uniform(0, 100, 3000)
    g = np.sort(rng.normal(0.7, 0.1, 3000))[np.argsort(np.argsort(q))]
    rows = [(0, 1, float(s), float(x)) for s, x in zip(g, q)] + [(0, 0, float(s), float(x)) for s, x in zip(rng.normal(0.3, 0.1, 3000), rng.uniform(0, 100, 3000))]
    return spark.createDataFrame(rows, "k int, genuine int, score double, q double").cache()


def test_reject_curve_against_numpy(separated):
    rows = separated.collect()
    s, q, g = (np.array([getattr(r, c) for r in rows]) for c in ("score", "q", "genuine"))
    tau = np.round(np.percentile(s[g == 1], 10), 9)
    curve = ev.reject_curve(separated, 0.1, ["k"]).orderBy("t").collect()
    assert len(curve) == 101
    for r in curve:
        keep = q >= r.t
        assert (r.n_gen, r.n_imp) == ((keep & (g == 1)).sum(), (keep & (g == 0)).sum())
        assert abs(r.reject_frac - (1 - keep.mean())) < 1e-12
        if r.n_gen:
            assert abs(r.fnmr - (s[keep & (g == 1)] < tau).mean()) < 1e-12
    kept = [r.n_gen + r.n_imp for r in curve]
    assert kept == sorted(kept, reverse=True) and curve[0].reject_frac == 0
    assert all(r.reduction > 50 for r in ev.fnmr_reduction(ev.reject_curve(separated, 0.1, ["k"]), ["k"]).collect())


def test_det_against_numpy_and_quality_order(separated):
    rows = separated.collect()
    s, g = np.array([r.score for r in rows]), np.array([r.genuine for r in rows])
    at = s.min() + np.arange(500) * ((s.max() - s.min()) / 499)
    for r in ev.det(separated, ["k"]).collect():
        assert abs(r.fmr - (s[g == 0] >= at[r.i]).mean()) < 1e-12 and abs(r.fnmr - (s[g == 1] < at[r.i]).mean()) < 1e-12
    ranked = ev.ranked(separated, ["k"])
    eer = {r.grp: r.eer for r in ev.equal_error(ev.det(ranked.select("grp", "genuine", "score"), ["grp"]), ["grp"]).collect()}
    assert eer["bottom"] > eer["top"]


def test_strategies_order_rejection(spark):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(1, float(a), int(b), int(c)) for a, b, c in zip(rng.random(500), rng.integers(0, 101, 500), rng.integers(0, 101, 500))], "genuine int, score double, s int, v int")
    d = d.unionByName(d.withColumn("genuine", F.lit(0)))
    c = {(r.strategy, r.t): r.reject_frac for r in ev.reject_curve(ev.strategies(d, "s", "v", []), 0.1, ["strategy"]).collect()}
    for t in range(101):
        one = c["s_only", t], c["v_only", t]
        assert c["reject_if_either", t] >= max(one) - 1e-12 and min(one) >= c["reject_if_both", t] - 1e-12


def test_labels(spark):
    limits = spark.createDataFrame([(p, 0.8, 0.2) for p in ("P1", "P2", "P3")], "provider string, percentile_90 double, fmr_001 double")
    rows = [(1, 0.9, 0.8, 0.85, 3.0), (2, 0.9, 0.8, 0.85, 2.9), (3, 0.1, 0.1, 0.19, 9.0), (4, 0.1, 0.2, 0.1, 9.0), (5, None, 0.9, 0.9, 9.0), (6, 0.9, 0.9, 0.9, -1.0), (7, 0.5, 0.5, 0.5, 1.4)]
    d = spark.createDataFrame(rows, "row_idx int, score_P1 double, score_P2 double, score_P3 double, duration double")
    full = {r.row_idx: r.label for r in lb.label(d, limits, ["P1", "P2", "P3"]).collect()}
    assert full == {1: 1, 2: None, 3: 0, 4: None, 5: None, 6: 0, 7: 0}
    assert {r.row_idx: r.label for r in lb.label(d, limits, ["P1", "P2", "P3"], use_duration=False).collect()}[2] == 1


def test_histogram_features(spark):
    rows = [(1, float(v)) for v in [1, 3, 5, 7, 9] * 10] + [(2, 1.0), (2, 2.0)] + [(3, 5.0)] * 100 + [(4, float("nan"))] * 12
    got = {r.rec: r for r in st.histogram_features(spark.createDataFrame(rows, "rec int, v double"), "rec", "v", [2.0, 4.0, 6.0, 8.0, 10.0, 12.0, 14.0, 16.0, 18.0]).collect()}
    assert got[1].Mean == 5 and got[1].Range == 8 and abs(sum(got[1][f"Hist{k}"] for k in range(10)) - 1) < 1e-12
    assert all(got[2][s] == 0 for s in st.STATISTICS)
    assert got[3].Std == got[3].Skew == got[3].Kurt == got[3].Range == 0 and got[3].Mean == 5
    assert got[4].Mean == 0 and got[4].Hist0 == 1


def test_verdicts(spark):
    rows = [(0.85, 0.80, 0.79, 5.0, 4.0, 0.6), (0.805, 0.80, 0.75, 1.0, 1.0, 0.9), (0.805, 0.80, 0.79, 1.5, 1.5, 0.55), (0.83, 0.8, 0.8, 0.5, 3.0, 0.7), (0.808, 0.80, 0.79, 1.5, 1.5, 0.7), (0.80, 0.80, 0.79, 1.5, 1.5, 0.7)]
    d = spark.createDataFrame(rows, "both double, s double, v double, s_unique double, v_unique double, cross double")
    assert [r[0] for r in d.select(verdict()).collect()] == ["BOTH_NEEDED", "ONE_SUFFICES", "TRULY_INDEPENDENT", "MARGINAL_BENEFIT", "BOTH_RECOMMENDED", "EITHER_SUFFICIENT"]


def test_mcnemar_tail(spark):
    d = spark.createDataFrame([(True, False)] * 20 + [(False, True)] * 5 + [(True, True)] * 50, "a boolean, b boolean")
    r = mcnemar(d, F.col("a"), F.col("b")).head()
    assert (r.n10, r.n01) == (20, 5) and abs(r.chi2 - 14**2 / 25) < 1e-12 and abs(r.p_value - 0.00511) < 1e-4
    assert mcnemar(d.where("a = b"), F.col("a"), F.col("b")).head().p_value == 1


def test_warnings(spark):
    rows = [(1, 0.0005, 0.0, 3.0, 1.0), (2, 0.5, 0.2, 3.0, 1.0), (3, 0.5, 0.0, 0.5, 1.0), (4, 0.5, 0.0, 3.0, 0.033), (5, 0.5, 0.0, 3.0, 0.7)]
    got = fr.warnings(spark.createDataFrame(rows, "rec_id int, peak double, clipped_share double, total_duration_sec double, speech_ratio double")).orderBy("rec_id").collect()
    assert [list(r.warnings) for r in got] == [["TooQuiet"], ["Clipped"], ["TooShort"], ["InsufficientSpeech"], []]


def test_semantic_traps(spark):
    d = spark.createDataFrame([(0.005, 1.0, 5.0), (0.015, 2.0, 5.0), (0.995, float("nan"), 5.0)], "p double, x double, c double")
    assert [r[0] for r in d.select(sm.mapped_score(F.col("p"))).collect()] == [0, 2, 100]
    assert [r[0] for r in d.select(sm.finite(F.col("x"))).collect()] == [1.0, 2.0, None]
    assert d.agg(sm.correlation(F.col("p"), F.col("c"))).head()[0] == 0
    ranks = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, 2.0)], "k int, v double").select("k", sm.average_rank("v").alias("r")).orderBy("k").collect()
    assert [r.r for r in ranks] == [3.5, 1.0, 3.5, 2.0]


def test_balanced_classes_with_a_hot_class(spark):
    d = spark.createDataFrame([(k, int(k % 50 == 0)) for k in range(2000)], "row int, label int")
    got = lb.balanced(d, "label", "row", "s").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in got} == {0: 40, 1: 40}


def test_random_pairs(spark):
    d = spark.createDataFrame([(k, f"s{k % 7}") for k in range(70)] + [(100, "alone")], "row_idx long, speaker_id string")
    speaker = {r.row_idx: r.speaker_id for r in d.collect()}
    got = random_pairs(d, 15, 3).collect()
    assert len([r for r in got if r.genuine]) == 7 * 15 and all(r.i != r.j for r in got)
    assert all((speaker[r.i] == speaker[r.j]) == bool(r.genuine) for r in got)


def test_ridge_is_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=200)
    d = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    rows = md.standardised(d, ["a", "b", "c"])
    m = md.ridge(rows, "y", 5.0).fit(rows)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    want = np.linalg.solve(z.T @ z + 5.0 * np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(m.coefficients.toArray(), want, atol=1e-8) and abs(m.intercept - y.mean()) < 1e-8
    best, path = md.ridge_path(rows, "y")
    assert path.count() == 50 and 1e-3 <= best <= 1e3


def test_models_rank_above_chance_and_score(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(a), float(b), float(a + 0.3 * rng.normal() > 0)) for k, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    d = spark.createDataFrame(rows, "row_idx int, x1 double, x2 double, label double")
    model = md.scoring_pipeline(["x1", "x2"], md.FAMILIES["forest"]()).fit(md.weighted(d))
    out = md.scored(model, md.weighted(d).withColumn("x2", F.when(F.col("row_idx") == 0, float("nan")).otherwise(F.col("x2"))), ["x1", "x2"])
    auc = ev.roc_auc(out.select(F.col("label").cast("int").alias("label"), F.col("p").alias("score")), []).head().auc
    q = out.agg(F.min("quality"), F.max("quality")).head()
    assert auc > 0.9 and 0 <= q[0] <= q[1] <= 100
    assert md.prune_by_importance(d.withColumn("flat", F.lit(1.0)), ["x1", "x2", "flat"]) == ["x1", "x2"]


def test_greedy_redundancy(spark):
    m = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.97), ("a", "d", -0.5)], "a string, b string, r double")
    assert st.prune_redundant(m, {"a": 0.5, "b": 0.4, "c": 0.3, "d": 0.1}) == ["a", "c", "d"]
