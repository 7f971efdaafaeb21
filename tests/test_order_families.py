import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.storage import kept
from tessera.operators import evaluation as ev
from tessera.operators import families as fm
from tessera.operators import models as md
from tessera.operators import vectors as vx
from tessera.operators.order import average_ranks, cells_of, percentiles, running


@pytest.fixture(scope="module")
def skewed(spark):
    """A key with most rows, a null key, ties, null and extreme values."""
    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in np.round(rng.normal(size=900), 2)] + [(None, float(x)) for x in rng.integers(0, 3, 60)]
    rows += [("one", 5.0), ("same", 1.0), ("same", 1.0), ("far", 1e12), ("far", 0.0), ("far", 1e-9), ("hot", None)]
    return rows, spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(rows)], "id int, key string, x double")


def test_percentiles_equal_a_sorted_list(skewed):
    rows, d = skewed
    shares = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {r.key: r.pct for r in percentiles(d, ["key"], "x", shares).collect()}
    for k in {k for k, _ in rows}:
        want = np.percentile([x for q, x in rows if q == k and x is not None], [100 * s for s in shares])
        assert np.allclose(got[k], want, atol=1e-9, rtol=1e-12)
    assert len(got) == len({k for k, _ in rows})
    assert percentiles(d.where("false"), [], "x", [0.5]).head().pct == [None] and percentiles(d.where("false"), ["key"], "x", [0.5]).count() == 0


def test_cells_stay_even_with_an_outlier_and_keep_the_order(spark):
    """One value of 1e300 among many: no cell gets much more than its share, and cells never fall as values rise."""
    rng = np.random.default_rng(1)
    values = np.append(np.round(rng.beta(8, 2, 200_000), 7), [1e300, -1e300])
    d = spark.createDataFrame([(1, float(x)) for x in values], "key int, x double").repartition(4)
    placed = cells_of(d, ["key"])
    sizes = [r["count"] for r in placed.groupBy("cell").count().collect()]
    assert max(sizes) < 4 * len(values) / 1024 and len(sizes) > 10_000
    ends = placed.groupBy("cell").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("cell").collect()
    assert all(a.hi < b.lo for a, b in zip(ends, ends[1:], strict=False))
    assert np.allclose(percentiles(d, ["key"], "x", [0.001, 0.5, 0.9, 0.999]).head().pct, np.percentile(values, [0.1, 50, 90, 99.9]))
    assert percentiles(d, ["key"], "x", [0.0, 1.0]).head().pct == [-1e300, 1e300]


def test_average_ranks_share_ties(skewed):
    rows, d = skewed
    got = {r.id: r.k for r in average_ranks(d.where("x is not null"), ["key"], "x", "k").collect()}
    for key in {k for k, _ in rows}:
        mine = [(x, i) for i, (q, x) in enumerate(rows) if q == key and x is not None]
        for x, i in mine:
            less, same = sum(y < x for y, _ in mine), sum(y == x for y, _ in mine)
            assert got[i] == less + (same + 1) / 2


def test_products_of_pairs_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 5))
    d = spark.createDataFrame([("p" if k % 4 else None, 3 * k, v.tolist()) for k, v in enumerate(x)], "g string, n int, v array<double>")
    got = {(r.g, r.a, r.b): r.score for r in vx.pair_products(d.where("g is not null"), ["g"], "n", "v", block=16).collect()}
    want = {("p", 3 * i, 3 * j): x[i] @ x[j] for i in range(40) for j in range(i + 1, 40) if i % 4 and j % 4}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert vx.pair_products(d, [], "n", "v", block=50).count() == 40 * 39 // 2 and vx.pair_products(d.where("false"), [], "n", "v").count() == 0


def test_running_sums_equal_a_loop(skewed):
    rows, d = skewed
    d = d.where("x is not null").withColumn("c", F.col("id") % 5)
    got = {r.id: (r.upto_c, r.all_c) for r in running(d, ["key"], ["x", "id"], ["c"]).collect()}
    for k in {k for k, _ in rows}:
        mine = sorted((x, i) for i, (q, x) in enumerate(rows) if q == k and x is not None)
        sums = np.cumsum([i % 5 for _, i in mine])
        assert [got[i] for _, i in mine] == [(s, sums[-1]) for s in sums]


def test_kept_is_read_back(spark):
    d = spark.range(10).withColumn("a b", F.lit(None).cast("string"))
    assert kept(d).dtypes == d.dtypes and kept(d).count() == 10


def test_reduction_keeps_missing_errors(spark):
    rows = [(0, t, f, r) for t, f, r in [(0, 0.2, 0.0), (1, 0.1, 0.1), (2, None, 0.2)]] + [(1, 0, 0.0, 0.0), (1, 1, 0.1, 0.1)]
    curve = spark.createDataFrame(rows, "k int, t int, fnmr double, reject_frac double")
    got = {(r.k, r.target): r.reduction for r in ev.relative_reduction(curve, ["k"], (0.1, 0.2)).collect()}
    assert got == {(0, 0.1): 50.0, (0, 0.2): None, (1, 0.1): None, (1, 0.2): None}


def test_cohort_moments_and_mutual_best(spark):
    rng = np.random.default_rng(5)
    x, k = rng.normal(size=(40, 6)), rng.normal(size=(25, 6))
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(unit(x))], "id int, u array<double>")
    cohort = spark.createDataFrame([([float(y) for y in v],) for v in k], "v array<double>")
    cos = unit(x) @ unit(k).T
    for r in vx.cohort_stats(rows, "u", cohort, "c").collect():
        assert abs(r.c_mu - cos[r.id].mean()) < 1e-12 and abs(r.c_sd - cos[r.id].std()) < 1e-9
    assert vx.cohort_stats(rows, "u", cohort.limit(1), "c").agg(F.max("c_sd")).head()[0] == vx.FLOOR
    a, b = rows.where("id % 2 = 0").withColumnRenamed("id", "key_a"), rows.where("id % 2 = 1").withColumnRenamed("id", "key_b")
    s = np.round(unit(x)[::2] @ unit(x)[1::2].T, 9)
    want = {(2 * i, 2 * s[i].argmax() + 1) for i in range(20) if s[:, s[i].argmax()].argmax() == i and s[i].max() >= 0.2}
    for block in (512, 7):
        assert {(r.key_a, r.key_b) for r in vx.mutual_best(a, b, 0.2, block).collect()} == want


def test_paired_t_and_convergence():
    t, p = fm.paired_t([0.8, 0.82, 0.79, 0.81, 0.83], [0.78, 0.80, 0.78, 0.80, 0.79])
    assert abs(t - 3.65148) < 1e-4 and abs(p - 0.0217) < 1e-3
    assert fm.paired_t([1.0] * 5, [1.0] * 5) == (0.0, 1.0)
    assert fm.converged([(50, 0.9), (200, 0.88), (300, 0.8995), (400, 0.9)]) == 300 and fm.converged([(50, 0.9)]) is None


@pytest.fixture(scope="module")
def families(spark):
    """The label follows ``a`` and, weakly, ``b``; ``c`` and ``d`` are noise."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = (2 * x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    rows = [(i, float(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))]
    return kept(fm.folded(spark.createDataFrame(rows, "id int, label double, a double, b double, c double, d double"), "id"))


def test_folds_are_portable(families):
    for r in families.limit(50).collect():
        assert r.fold == int(hashlib.md5(f"{r.id}|42".encode()).hexdigest()[:8], 16) % 5


def test_families_are_told_apart(families):
    c = {r.config: r for r in fm.held_out_comparison(families, ["a", "b"], ["c", "d"]).collect()}
    assert c["s_only"].auc > 0.9 > 0.7 > c["v_only"].auc and c["combined"].accuracy > 0.8
    first = min(fm.redistribution(families, ["a", "b"], ["c", "d"]).collect(), key=lambda r: r["rank"])
    assert (first.feature, first.rank_shift) == ("a", 0)
    assert all(r.drop_s > 0.2 > r.drop_v for r in fm.ablation(families, "id", ["a", "b"], ["c", "d"], seeds=2).collect())
    e = fm.cross_prediction(families, ["a", "b"], ["c", "d"]).head()
    assert -0.3 < e.kappa < 0.5 and e.v_to_s < 0.7 and 0 <= e.agreement <= 1


def test_projection_and_saved_model(spark, families, tmp_path):
    v = families.select("id", md.array_to_vector(F.array("a", "b", "c", "d")).alias("features"))
    x = np.array([r.features.toArray() for r in v.orderBy("id").collect()])
    got = np.array([(r.x, r.y) for r in md.plane(v).orderBy("id").collect()])
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ axes[:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    model = md.scoring_pipeline(["a", "b"], md.FAMILIES["forest"]()).fit(md.weighted(families))
    md.save(model, f"file://{tmp_path}/model")
    one, two = (md.scored(m, families, ["a", "b"]).select("id", "p").orderBy("id").collect() for m in (model, md.load(f"file://{tmp_path}/model")))
    assert one == two


@pytest.mark.parametrize("holes", [False, True])
def test_rank_correlations_with_and_without_holes(spark, holes):
    """Whole tables rank features and targets once; with nulls every pair has its own rows."""
    from tessera.operators import statistics as st

    rng = np.random.default_rng(7)
    n = 80
    data = {"a": rng.integers(0, 9, n).astype(float), "b": rng.standard_normal(n), "flat": np.ones(n)}
    y = {"y1": data["a"] + rng.standard_normal(n), "y2": rng.integers(0, 4, n).astype(float)}
    gone = lambda f, i: holes and (f == "b" and i % 7 == 0 or f == "y2" and i % 5 == 0)
    long = spark.createDataFrame([(i, f, None if gone(f, i) else float(v)) for f, x in data.items() for i, v in enumerate(x)], "row_idx int, feature string, value double")
    targets = spark.createDataFrame([(i, float(y["y1"][i]), None if gone("y2", i) else float(y["y2"][i])) for i in range(n)], "row_idx int, y1 double, y2 double")
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    def rho(f, t):
        keep = [i for i in range(n) if not gone(f, i) and not gone(t, i)]
        p, q = rank(data[f][keep]), rank(y[t][keep])
        return 0.0 if p.std() == 0 or q.std() == 0 else np.corrcoef(p, q)[0, 1]

    got = {r.feature: r for r in st.spearman_to_targets(long, targets, ["y1", "y2"]).collect()}
    for f in data:
        want = [rho(f, "y1"), rho(f, "y2")]
        assert np.allclose([got[f].rho_y1, got[f].rho_y2, got[f].mean_rho, got[f].mean_abs_rho], [*want, np.mean(want), np.mean(np.abs(want))]), f
    # rows that a table has twice are joined and ranked as often
    twice = st.spearman_to_targets(long.where("feature = 'a'"), targets.unionByName(targets.where("row_idx < 20")), ["y1"]).head()
    i = np.append(np.arange(n), np.arange(20))
    assert abs(twice.rho_y1 - np.corrcoef(rank(data["a"][i]), rank(y["y1"][i]))[0, 1]) < 1e-9


def test_rank_correlations_shuffle_values_and_not_rows(spark):
    """A row that counts several times weighs as if it were there as often, and no row is dealt out with its ranks: what is
    grouped is a feature's distinct values."""
    from tessera.operators import statistics as st

    rng = np.random.default_rng(11)
    n = 300
    x, y, z, w = rng.integers(0, 7, n).astype(float), rng.standard_normal(n), rng.integers(0, 5, n).astype(float), rng.integers(1, 4, n)
    rows = [(f, float(v), float(y[i]), None if i % 6 == 0 else float(z[i]), int(w[i])) for f, c in (("a", x), ("b|c", y + x)) for i, v in enumerate(c)]
    rows += [("few", float(i), float(i), None, 1) for i in range(9)] + [("none", float(i), None, None, 1) for i in range(20)]
    d = spark.createDataFrame(rows, "feature string, value double, y double, z double, times int")
    rank = lambda v: np.array([(v < q).sum() + ((v == q).sum() + 1) / 2 for q in v])
    rho = lambda p, q: np.corrcoef(rank(p), rank(q))[0, 1]
    got = {r.feature: r for r in st.rank_correlations(d, ["y", "z"], "times").collect()}
    some = np.repeat(np.arange(n) % 6 != 0, w)
    for f, c in (("a", x), ("b|c", y + x)):
        c, a, b = np.repeat(c, w), np.repeat(y, w), np.repeat(z, w)
        want = [rho(c, a), rho(c[some], b[some])]
        assert np.allclose([got[f].rho_y, got[f].rho_z, got[f].mean_rho, got[f].mean_abs_rho], [*want, np.mean(want), np.mean(np.abs(want))]), f
    assert (got["few"].rho_y, got["few"].rho_z, got["few"].mean_rho) == (0.0, None, 0.0) and "none" not in got


def test_boosting_on_cells_is_boosting_on_rows(spark):
    """Boosted trees see a row per distinct vector, however many rows there are, and err as those fitted on all rows."""
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(3 * a - b + rng.standard_normal()), int(k % 5)) for k, (a, b) in enumerate(zip(rng.integers(0, 6, 1500), rng.integers(0, 5, 1500), strict=True))]
    data = md.VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, t double, fold int"))
    train = data.where("fold <> 0")
    held = md.cells(train, "t").collect()
    assert len(held) == 30 and sum(r.weight for r in held) == train.count()
    got = {r.family: r for r in md.regressor_errors(data.select("features", "t", "fold"), "t").collect()}
    whole = md.REGRESSORS["boosting"]().setLabelCol("t").fit(train).transform(data.where("fold = 0")).select("t", "prediction").collect()
    assert got["boosting"].n == len(whole) == 300
    assert abs(got["boosting"].rmse - np.sqrt(np.mean([(r.t - r.prediction) ** 2 for r in whole]))) < 1e-9
