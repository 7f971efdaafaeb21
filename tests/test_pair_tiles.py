"""Tiles of sorted stripes against a row for each pair."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.functions.storage import shared_path
from tessera.operators import pairs as pr
from tessera.plans import verification as vf


def local(stripes):
    """``in_cells`` without workers, so that limits of this process hold: rows of a key in ``stripes`` stripes."""

    def run(e, keys, columns, fold, schema, vector, other=None, most=0, **_):
        rows, out = e.collect(), []
        for key in sorted({tuple(r[k] for k in keys) for r in rows}):
            mine = sorted((r for r in rows if tuple(r[k] for k in keys) == key), key=lambda r: r["row_idx"])
            sides = []
            for s in range(stripes):
                part = [r for r in mine if r["row_idx"] // 3 % stripes == s]
                x = {c: np.array([r[c] if r[c] is not None else np.nan for r in part], np.float64 if k else np.int64) for k, c in enumerate(columns)}
                sides.append(x | {"_v": pr.units(np.array([r["v"] for r in part], float))})
            for lo in range(stripes):
                for hi in range(lo, stripes):
                    for arrays in fold(key, sides[lo], sides[lo] if lo == hi else sides[hi], lo == hi):
                        out += [(*key, *row) for row in zip(*[pa.array(a).to_pylist() for a in arrays])]
        return e.sparkSession.createDataFrame(out, ", ".join([*[f"{k} {e.schema[k].dataType.simpleString()}" for k in keys], schema]))

    return run


@pytest.fixture(params=[(1, 256, 512), (3, 7, 11)])
def tiled(request, monkeypatch):
    stripes, high, wide = request.param
    for name, value in (("HIGH", high), ("WIDE", wide), ("WAITING", 1 << 18 if stripes == 1 else 300), ("in_cells", local(stripes))):
        monkeypatch.setattr(pr, name, value)


class Paired:
    """Recordings of 4 or 60 speakers, copies, one without a speaker, two of one number; and a row for each pair."""

    def __init__(self, spark, speakers, seed=5):
        rng = np.random.default_rng(seed)
        n = 160
        v, spk = rng.normal(size=(n, 6)), rng.integers(0, speakers, n).astype(object)
        v[20:26] = v[19]
        spk[7] = None
        ids = rng.permutation(n) * 3 + rng.integers(0, 3, n)
        ids[31] = ids[30]
        q = np.stack([ids * 37 % 101, (ids * 53 + 11) % 101])
        self.e = spark.createDataFrame([(int(i), None if s is None else int(s), [float(y) for y in x], int(a), int(b)) for i, s, x, a, b in zip(ids, spk, v, *q)], "row_idx long, speaker int, v array<double>, q_s int, q_v int")
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        a, b = np.nonzero(ids[:, None] < ids[None, :])
        named = np.array([-1 - k if s is None else s for k, s in enumerate(spk)])
        self.own = named[a] == named[b]
        self.score = np.round((u[a] * u[b]).sum(axis=1), 9)
        self.q = np.minimum(q[:, a], q[:, b])


GROUPS = pr.Groups(4, lambda x: (x["q_s"] >= 20) + np.int64(2) * (x["q_v"] >= 45), lambda x: (x["q_s"] >= 30) + np.int64(2) * (x["q_v"] >= 35), np.array([2, 3, 1, 0]))


@pytest.mark.parametrize("speakers", [4, 60])
def test_tradeoffs(spark, tiled, speakers):
    p = Paired(spark, speakers)
    s, v = (p.q[k] >= np.where(p.own, *m) for k, m in enumerate(((20, 30), (45, 35))))
    group = np.where(v, np.where(s, 0, 1), np.where(s, 3, 2))
    ends, cells, errors = (d.collect() for d in pr.tradeoffs(p.e, ["row_idx", "speaker", "q_s", "q_v"], GROUPS, 50, (0.01, 0.001)))
    assert {(r.grp, r.lo, r.hi) for r in ends} == {(g, p.score[group == g].min(), p.score[group == g].max()) for g in range(4)}
    want = {}
    for r in ends:
        at = r.lo + np.arange(50) * ((r.hi - r.lo) / 49)
        for k, g in zip((p.score[group == r.grp][:, None] >= at).sum(axis=1).tolist(), p.own[group == r.grp].tolist()):
            want.setdefault((r.grp, k), [0, 0])[g] += 1
    assert {(r.grp, r.reached): [r.m, r.g] for r in cells} == want
    assert len(errors) == 8
    for r in errors:
        tau = np.round(np.percentile(p.score[(group == r.grp) & ~p.own], 100 * (1 - r.target_fmr)), 9)
        assert abs(r.tau - tau) < 2e-9 and r.fnmr == (p.score[(group == r.grp) & p.own] < r.tau).mean()


@pytest.mark.parametrize("speakers", [4, 60])
def test_cells_of_one_quality(spark, tiled, speakers):
    p = Paired(spark, speakers)
    tau = np.round(np.percentile(p.score[p.own], 10), 9)
    got = {(r.q_s, r.genuine, r.below): r.n for r in pr.quality_cells(p.e, [], ["q_s"], 0.1).collect()}
    want: dict = {}
    for c in zip(p.q[0].tolist(), p.own.astype(int).tolist(), (p.score < tau).astype(int).tolist()):
        want[c] = want.get(c, 0) + 1
    assert got == want


def test_keys_without_pairs_of_one_speaker_have_no_cells(spark, tiled):
    e = Paired(spark, 4).e
    both = e.selectExpr("'a' AS provider", "*").unionByName(e.selectExpr("'b' AS provider", "row_idx", "row_idx AS speaker", "v", "q_s", "q_v").dropDuplicates(["row_idx"]))
    assert {r.provider for r in pr.quality_cells(both, ["provider"], ["q_s"], 0.1).collect()} == {"a"}


def test_no_pairs(spark):
    one = Paired(spark, 4).e.limit(1)
    assert [d.count() for d in pr.tradeoffs(one, ["row_idx", "speaker"], pr.one_group(), 500, (0.01,))] == [0, 0, 0]
    assert pr.quality_cells(one, [], ["q_s"], 0.1).count() == 0


@pytest.mark.parametrize("name, most", [("e11_quadrant_performance", 2), ("e13_cross_system", 3)])
def test_passes_over_pairs(name, most, spark, small, monkeypatch):
    """Quadrants were multiplied six times."""
    assert shared_path(spark, "x")
    passes, in_cells = [], pr.in_cells
    monkeypatch.setattr(pr, "in_cells", lambda *a, **k: passes.append(a) or in_cells(*a, **k))
    assert getattr(vf, name)(spark, small).count() > 0
    assert len(passes) <= most


def test_stripes_of_many_vectors():
    """600,000 recordings in three systems were in 57 stripes, and each vector was shuffled 58 times."""
    assert pr.stripes_of(600_000, 22) == pr.stripes_of(600_000, 64) == 16
    assert pr.stripes_of(600_000, 22, keys=3) == 9 and pr.stripes_of(1_000, 22, keys=500) == 1
    assert pr.stripes_of(600_000, 1_024) * pr.BYTES >= 600_000 * 1_024 * 8


def test_stripes_of_ordered_rows():
    """Stripes of pairs that leave in order are large enough for equal scores to meet, and few enough to be held together."""
    for n in (51_282, 102_564, 120_000):
        k = pr.stripes_of(n, 64, pr.SQUARE, stripes=pr.FEW)
        assert pr.ORDERED <= (n / k) ** 2 <= pr.TOGETHER


@pytest.mark.parametrize("single, size", [(True, 4), (False, 8)])
def test_vectors_travel_in_single_precision(spark, single, size):
    kind = "float" if single else "double"
    e = spark.range(50).selectExpr("id AS row_idx", f"CAST(array(sin(id), cos(id), 1 / (id + 3)) AS array<{kind}>) AS v").selectExpr("row_idx", "CAST(v AS array<double>) AS v")
    parts = pr.packed(e, [], ["row_idx"], 2, "v").collect()
    assert sum(len(r["_v"]) for r in parts) == 50 * 3 * size + len(parts)
    x = [pr.stripe([(r["row_idx"], r["_v"]) for r in parts if r["stripe"] == s], ["row_idx"], "u") for s in range(2)]
    assert {int(i): row.tolist() for y in x for i, row in zip(y["row_idx"], y["_v"])} == {r["row_idx"]: r["v"] for r in e.collect()}


@pytest.mark.parametrize("together, placed", [(1 << 20, 1 << 36), (3_000, 1 << 36), (3_000, 1_000_000)])
def test_normalised_scores_of_large_stripes_leave_in_order(spark, together, placed, monkeypatch):
    """Equal scores lay far apart, and a file took 8.4 bytes for a pair."""
    for name, value in (("ORDERED", 1), ("TOGETHER", together), ("PLACED", placed), ("WAITING", 500), ("in_cells", local(2))):
        monkeypatch.setattr(pr, name, value)
    e = Paired(spark, 4).e.selectExpr("*", "q_s / 700 AS utt_mu", "(q_v + 1) / 200 AS utt_sd")
    rows = e.collect()
    want = []
    for a in rows:
        for b in rows:
            if a.row_idx < b.row_idx:
                u, v = (np.array(r.v) / np.linalg.norm(r.v) for r in (a, b))
                s = np.round(u @ v, 9)
                want.append((a.row_idx, b.row_idx, int(a.speaker == b.speaker and a.speaker is not None), np.round(((s - a.utt_mu) / a.utt_sd + (s - b.utt_mu) / b.utt_sd) / 2, 6)))
    got = [tuple(r) for r in pr.scores(e, normalised=True).collect()]
    assert len(got) == len(want)
    assert all(g[:3] == w[:3] and abs(g[3] - w[3]) < 2e-6 for g, w in zip(sorted(got), sorted(want)))
    falls = sum(a[3] > b[3] for a, b in zip(got, got[1:]))
    assert falls <= 2 if together == 1 << 20 else placed < 1 << 36 or falls <= 12


@pytest.mark.parametrize("x, whole", [(0.4999999999999999, 0), (0.5, 1), (-0.5, -1), (-2.5, -3), (1.4999999, 1), (-0.2, 0)])
def test_halves_go_away_from_zero(x, whole):
    assert pr.wholes(np.array([x]), 1.0)[0] == whole
