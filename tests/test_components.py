"""Factors, independent components, linkage and out-of-bag votes against planted structure and brute force."""

import numpy as np
import pytest

from tessera.operators import bags
from tessera.operators import components as cp
from tessera.operators import models


def rows_of(spark, x):
    names = [f"c{k}" for k in range(x.shape[1])]
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)), names


def test_covariance_leaves_out_nulls_and_empty_tables(spark):
    x = np.random.default_rng(1).standard_normal((50, 3)) + 1e6
    d, names = rows_of(spark, x)
    withnull = d.unionByName(spark.createDataFrame([(1.0, None, 2.0)], d.schema))
    n, mean, cov = cp.covariance(withnull, names)
    assert n == 50 and np.allclose(mean, x.mean(axis=0)) and np.allclose(cov, np.cov(x.T, ddof=0), atol=1e-9)
    assert cp.covariance(d.where("false"), names)[0] == 0
    r = {(row.a, row.b): row.r for row in cp.correlation_rows(d, names).collect()}
    assert set(r) == {("c0", "c1"), ("c0", "c2"), ("c1", "c2")} and abs(r["c0", "c2"] - np.corrcoef(x.T)[0, 2]) < 1e-9


@pytest.mark.parametrize("planted", [2, 4])
def test_factors_are_found_and_likelihood_never_falls(spark, planted):
    rng = np.random.default_rng(planted)
    load = rng.standard_normal((12, planted))
    x = rng.standard_normal((3000, planted)) @ load.T + rng.standard_normal((3000, 12)) * rng.uniform(0.4, 0.9, 12)
    d, names = rows_of(spark, x)
    found = cp.factor_sweep(d, names, start=1, step=4, half=1).collect()
    assert [r.n_components for r in found if r.best] == [planted] and {r.phase for r in found} == {"coarse", "fine"}
    cov = cp.scaled(np.cov(x.T, ddof=0))
    for k in (1, planted, 6):
        loadings, noise, likelihoods = cp.factors(cov, k)
        assert (np.diff(likelihoods) > -1e-9).all()
        whole = loadings @ loadings.T + np.diag(noise)
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        direct = -0.5 * (12 * np.log(2 * np.pi) + np.linalg.slogdet(whole)[1] + np.einsum("ij,jk,ik->i", z, np.linalg.inv(whole), z)).mean()
        assert abs(direct - cp.factors(cov, k, steps=len(likelihoods) + 1)[2][-1]) < 1e-4
    ll = {r.n_components: r.mean_ll for r in found}
    best = [r for r in found if r.best][0]
    assert abs(best.bic - (-2 * 3000 * ll[planted] + (12 * planted - planted * (planted - 1) // 2 + 12) * np.log(3000))) < 1e-6
    assert cp.factor_sweep(d.where("false"), names).collect() == []


def test_independent_sources_are_recovered(spark):
    rng = np.random.default_rng(5)
    s = np.stack([rng.uniform(-1, 1, 4000), rng.laplace(size=4000), np.sign(rng.standard_normal(4000)) * rng.uniform(0.5, 1, 4000)], axis=1)
    mix = np.array([[1.0, 0.5, 0.2], [0.3, 1.0, -0.6], [0.1, -0.4, 1.0], [0.5, 0.5, 0.5]])
    d, names = rows_of(spark, s @ mix.T)
    unmix, mixing, steps = cp.independent(d.cache(), names, 3)
    got = (s @ mix.T - (s @ mix.T).mean(axis=0)) @ unmix.T
    match = np.abs(np.corrcoef(got.T, s.T)[:3, 3:])
    assert steps < 50 and sorted(match.argmax(axis=1)) == [0, 1, 2] and match.max(axis=1).min() > 0.99
    assert np.allclose(unmix @ mixing, np.eye(3), atol=1e-8) and (mixing[np.abs(mixing).argmax(axis=0), range(3)] > 0).all()


def brute_linkage(d):
    """Merge the two clusters of the least mean distance, by looking at all of them."""
    groups, out = {k: [k] for k in range(len(d))}, []
    while len(groups) > 1:
        h, a, b = min((np.mean([d[i, j] for i in groups[a] for j in groups[b]]), a, b) for a in groups for b in groups if a < b)
        out.append((a, b, h, len(groups[a]) + len(groups[b])))
        groups[len(d) + len(out) - 1] = groups.pop(a) + groups.pop(b)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_linkage_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 30))
    x = rng.standard_normal((n, 3))
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))
    got, want = cp.linkage(d), brute_linkage(d)
    assert [(a, b, s) for a, b, _, s in got] == [(a, b, s) for a, b, _, s in want] and np.allclose([m[2] for m in got], [m[2] for m in want])


def test_linkage_with_ties_and_cuts(spark):
    d = np.array([[0, 1, 5, 5], [1, 0, 5, 5], [5, 5, 0, 1], [5, 5, 1, 0.0]])
    assert cp.linkage(d) == [(0, 1, 1.0, 2), (2, 3, 1.0, 2), (4, 5, 5.0, 4)]
    assert cp.cut_at(cp.linkage(d), 4, 1.0) == [0, 0, 1, 1] and cp.cut_at(cp.linkage(d), 4, 0.5) == [0, 1, 2, 3] and cp.linkage(np.zeros((1, 1))) == []
    same = cp.linkage(np.ones((5, 5)) - np.eye(5))
    assert [m[2] for m in same] == [1.0] * 4 and same[-1][3] == 5
    m = spark.createDataFrame([("a", "b", -0.99), ("a", "c", 0.1), ("b", "c", 0.2)], "a string, b string, r double")
    merges = cp.clustered(m).orderBy("step").collect()
    assert [(r.a, r.b, r["size"]) for r in merges] == [("a", "b", 2), ("c", "#1", 3)] and abs(merges[1].height - 0.85) < 1e-9
    assert [tuple(r) for r in cp.feature_clusters(m).orderBy("feature").collect()] == [("a", 0), ("b", 0), ("c", 1)]
    assert cp.clustered(m.where("false")).collect() == []


def test_bags_leave_rows_out_and_count_their_votes(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 3))
    y = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(float)
    rows = spark.createDataFrame([(k, float(t), *map(float, v)) for k, (t, v) in enumerate(zip(y, x, strict=True))], "row_idx int, label double, a double, b double, c double")
    times = np.array([[r[t] for t in range(6)] for r in rows.orderBy("row_idx").select(*[bags.draws(rows.row_idx, t) for t in range(6)]).collect()])
    assert abs(times.mean() - 1) < 0.1 and abs((times == 0).mean() - np.exp(-1)) < 0.05 and abs(times.var() - 1) < 0.2
    cast = bags.votes(rows, "row_idx", ["a", "b", "c"], 6).cache()
    votes = {(r.row_idx, r.tree): r.vote for r in cast.collect()}
    assert set(votes) == {(i, t) for i in range(300) for t in range(6) if times[i, t] == 0}
    curve = {r.trees: r for r in bags.out_of_bag(cast, "row_idx", [2, 6]).collect()}
    for trees in (2, 6):
        by = {}
        for (i, t), v in votes.items():
            if t < trees:
                by.setdefault(i, []).append(v)
        decided = {i: max((0.0, 1.0), key=lambda c, v=v: (v.count(c), c)) for i, v in by.items()}
        assert curve[trees].n == len(by) and abs(curve[trees].oob_accuracy - np.mean([y[i] == d for i, d in decided.items()])) < 1e-12
    assert curve[6].oob_accuracy > 0.8
    line = spark.createDataFrame([(10, 0.9, 0.1), (200, 0.9, 0.0952), (300, 0.9, 0.0949), (500, 0.9, 0.0945)], "trees int, oob_accuracy double, oob_error double")
    assert [r.trees for r in bags.convergence(line).where("converged").collect()] == [200]
    assert [r.trees for r in bags.convergence(line.where("trees < 200")).where("converged").collect()] == [10]


def test_fourier_features_approach_the_radial_kernel_and_part_what_lines_cannot(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    rows = spark.createDataFrame([(float(t), 1.0, *map(float, v)) for t, v in zip(y, x, strict=True)], "label double, weight double, a double, b double")
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    got = models.fourier_features(rows, ["a", "b"], dims=4096)
    f = np.array([r.features.toArray() for r in got.collect()])
    kernel = np.exp(-0.5 * np.square(z[:, None] - z[None]).sum(axis=2))
    assert np.abs(f @ f.T - kernel).max() < 0.12
    few = models.fourier_features(rows, ["a", "b"], dims=64, gamma=1.0).cache()
    right = lambda m, d: m.fit(d).transform(d).where("prediction = label").count() / 400
    plain = models.standardised(rows, ["a", "b"])
    assert right(models.FAMILIES["linear_svm"](), few) > 0.9 > 0.75 > right(models.FAMILIES["linear_svm"](), plain)
