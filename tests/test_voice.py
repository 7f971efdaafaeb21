"""Pitch, harmonicity, prediction polynomials, formants, periods and decay against direct sums and synthetic signals."""

import numpy as np
import pytest

from tessera.operators import paths, pitch, spectra, voice
from tessera.operators import statistics as st

RATE = 16000


def harmonics(f, n=8, power=1.0):
    """A sum of harmonics of the pitch ``f`` (hertz at every sample)."""
    phase = 2 * np.pi * np.cumsum(f) / RATE
    return sum(np.sin(k * phase + 0.7 * k * k) / k**power for k in range(1, n + 1))


def framed_rows(x, size, hop, pad=0):
    return np.lib.stride_tricks.sliding_window_view(np.pad(x, pad), size)[::hop]


@pytest.fixture(scope="module")
def tones(spark):
    rng = np.random.default_rng(0)
    t = np.arange(RATE) / RATE
    vibrato = 200 * 2 ** (0.5 / 12 * np.sin(2 * np.pi * 5 * t))
    glide = np.linspace(100, 160, RATE)
    mixed = 0.3 * harmonics(vibrato) + 0.01 * rng.standard_normal(RATE)
    half = np.concatenate([mixed[:8000], 0.3 * rng.standard_normal(8000)])
    signals = {1: mixed, 2: 0.3 * harmonics(glide) + 0.03 * rng.standard_normal(RATE), 3: half, 4: np.zeros(RATE // 2), 5: 0.3 * rng.standard_normal(RATE // 2)}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in signals.items()], "rec_id int, samples array<double>")
    found = pitch.candidates(spectra.framed(rows, pitch.PITCH, "zero")).cache()
    return signals, {1: vibrato, 2: glide, 3: vibrato}, rows, found


def rows_by(df):
    out = {}
    for r in df.orderBy("rec_id", "frame").collect():
        out.setdefault(r.rec_id, []).append(r)
    return out


def test_differences_and_dips_by_direct_sums():
    rng = np.random.default_rng(2)
    x = np.sin(np.arange(400) / 3.1) + 0.3 * rng.standard_normal((5, 400))
    x[4] = 0
    c = pitch.differences(x, 150)
    for row, got in zip(x, c, strict=True):
        d = np.array([((row[:200] - row[lag : lag + 200]) ** 2).sum() for lag in range(1, 151)])
        want = d * np.arange(1, 151) / np.cumsum(d) if d.any() else np.ones(150)
        assert np.abs(got - want).max() < 1e-9
    row, col, shift, p = pitch.dips(c)
    for k in range(5):
        h = c[k]
        at = [i for i in range(150) if (h[i] < h[i - 1] if i else h[0] < h[1]) and (i in (0, 149) or h[i] <= h[i + 1])]
        assert list(col[row == k]) == at
        want = dict.fromkeys(at, 0.0)
        for t, mass in zip(pitch.THRESHOLDS, pitch.PRIOR, strict=True):
            below = [i for i in at if h[i] < t]
            for j, i in enumerate(below):
                want[i] += mass * np.exp(-2 * j) / sum(np.exp(-2 * m) for m in range(len(below)))
            if at and not below:
                want[min(at, key=lambda i: h[i])] += 0.01 * mass
        assert np.allclose([want[i] for i in at], p[row == k])
    assert np.abs(shift).max() < 1 and abs(pitch.PRIOR.sum() - 1) < 1e-12 and not (row == 4).any()


def dense_path(values, scores, joined):
    """All states of all frames, one after the other."""
    best, back = np.array(scores[0]), []
    for a, b, s in zip(values, values[1:], scores[1:], strict=False):
        t = best[:, None] + joined(np.array(a), np.array(b))
        back.append(t.argmax(axis=0))
        best = t.max(axis=0) + np.array(s)
    at = [int(best.argmax())]
    for b in reversed(back):
        at.append(int(b[at[-1]]))
    return at[::-1], best.max()


@pytest.mark.parametrize("block", [1, 4, 7, 1000])
def test_paths_in_blocks_against_one_pass(spark, block):
    rng = np.random.default_rng(block)
    joined = lambda a, b: -np.abs(a[:, None] - b[None])
    data = {r: [(rng.integers(0, 30, k).astype(float).tolist(), rng.standard_normal(k).tolist()) for k in rng.integers(1, 5, n)] for r, n in ((1, 40), (2, 1), (3, 28), (4, 7))}
    rows = spark.createDataFrame([(r, f, *x) for r, frames in data.items() for f, x in enumerate(frames)], "rec_id int, frame int, values array<double>, scores array<double>")
    got = {k: [r.state for r in v] for k, v in rows_by(paths.best_path(rows, joined, block)).items()}
    for r, frames in data.items():
        want, _ = dense_path([v for v, _ in frames], [s for _, s in frames], joined)
        assert got[r] == want
    assert paths.best_path(rows.where("false"), joined).count() == 0


def test_pitch_of_tones_noise_and_silence(spark, tones):
    signals, pitches, rows, found = tones
    got = rows_by(pitch.tracked(found))
    for k, true in pitches.items():
        f = np.array([r.FrameF0 for r in got[k]])
        n = len(true) if k < 3 else 7000
        inner = slice(8, n // 160 - 8)
        # a frame compares its first half with what follows a period later, so it tells the pitch of that stretch's middle
        at = np.arange(len(f))[inner] * 160 - 512 + (8000 / true[np.arange(len(f))[inner] * 160]).astype(int)
        assert len(f) == RATE // 160 + 1 and (np.abs(f[inner] / true[at] - 1) < 0.01).mean() > 0.98
        assert np.mean([r.FramePC for r in got[k]][inner]) > 0.8
    assert all(r.FrameF0 == 0 for r in got[4]) and all(r.FramePC == 0 for r in got[4])
    assert np.mean([r.FrameF0 == 0 for r in got[5]]) > 0.9 and np.mean([r.FrameF0 == 0 for r in got[3][60:]]) > 0.8
    again = rows_by(pitch.tracked(found, block=9))
    assert {k: [r.FrameF0 for r in v] for k, v in again.items()} == {k: [r.FrameF0 for r in v] for k, v in got.items()}
    mean = {r.rec_id: r for r in voice.prosody(pitch.tracked(found)).collect()}
    assert abs(mean[1].MeanF0 - 200) < 3 and 2 < mean[1].F0_StdDev < 8 and mean[4].MeanF0 == mean[4].F0_StdDev == 0
    whole = {(r.rec_id, r.measure): r for r in spectra.frame_features(pitch.tracked(found)).collect()}
    edges = st.BOUNDARIES["FrameF0"]
    assert {m for _, m in whole} == {"FramePC", "FrameF0"} and whole[4, "FrameF0"].Hist0 == 1.0
    assert whole[1, "FrameF0"][f"Hist{sum(e <= 200 for e in edges)}"] + whole[1, "FrameF0"][f"Hist{sum(e <= 200 for e in edges) - 1}"] > 0.9


@pytest.mark.parametrize(("f", "periods", "db"), [(f, 4.5, db) for f in (120.0, 240.0, 333.0) for db in (5.0, 15.0, 25.0)] + [(240.0, 1.0, 5.0), (240.0, 1.0, 15.0)])
def test_harmonicity_of_known_mixtures(f, periods, db):
    """Within 1 dB, but for short frames of high harmonicity, in which a tone's own correlation is not exactly periodic."""
    rng = np.random.default_rng(4)
    s = voice.harmonic_frames(periods=periods)
    tone = np.sin(2 * np.pi * f * np.arange(3 * RATE) / RATE)
    noise = rng.standard_normal(len(tone)) * np.sqrt(0.5) * 10 ** (-db / 20)
    share = voice.harmonic_share(framed_rows(tone + noise, s.size, s.hop))[:, 0]
    # the largest of several periods is taken, which noise raises a little
    assert -0.5 < 10 * np.log10(share.mean() / (1 - share.mean())) - db < 1.1


def test_harmonicity_bounds_and_silence(spark):
    s = voice.harmonic_frames()
    tone = 0.5 * np.sin(2 * np.pi * 300 * np.arange(RATE) / RATE)
    quiet = np.concatenate([tone, 0.01 * tone])
    rows = spark.createDataFrame([(1, tone.tolist()), (2, quiet.tolist()), (3, [0.0] * 4000), (4, [0.1] * 5)], "rec_id int, samples array<double>")
    got = {k: np.array([r.FrameHNR for r in v]) for k, v in rows_by(voice.harmonicity(spectra.framed(rows, s))).items()}
    assert set(got) == {1, 2, 3} and got[1].min() > 30 and got[1].max() <= 40 and (got[3] == -10).all()
    assert (got[2][-50:] == -10).all() and got[2][:50].min() > 30
    assert voice.harmonicity(spectra.framed(rows.where("false"), s)).count() == 0


@pytest.mark.parametrize("order", [2, 5, 14])
def test_polynomials_there_and_back(order):
    rng = np.random.default_rng(order)
    k = np.tanh(rng.standard_normal((20, order)))
    filters = voice.filters_of(k)
    assert np.allclose(voice.reflections(filters), k)
    assert all(np.allclose(np.poly(r).real, f) for r, f in zip(voice.roots(filters), filters, strict=True))
    lines = voice.line_frequencies(filters)
    assert lines.shape == (20, order) and (np.diff(lines, axis=1) > 0).all() and (lines > 0).all() and (lines < np.pi).all()
    # the polynomials of the lines give the filter back: half their sum
    for f, w in zip(filters, lines, strict=True):
        pair = lambda a: np.array([1, -2 * np.cos(a), 1])
        total, apart = np.ones(1), np.ones(1)
        for j, a in enumerate(w):
            total, apart = (np.convolve(total, pair(a)), apart) if j % 2 == 0 else (total, np.convolve(apart, pair(a)))
        if order % 2 == 0:
            total, apart = np.convolve(total, [1, 1]), np.convolve(apart, [1, -1])
        else:
            apart = np.convolve(apart, [1, 0, -1])
        assert np.allclose((total + apart)[: order + 1] / 2, f)


def test_prediction_features(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(4000)
    for n in range(2, 4000):
        x[n] += 1.2 * x[n - 1] - 0.6 * x[n - 2]
    rows = spark.createDataFrame([(1, (0.05 * x).tolist()), (2, [0.0] * 1000), (3, [0.1])], "rec_id int, samples array<double>")
    frames = spectra.framed(rows, spectra.Signal())
    got = {r.rec_id: r.asDict() for r in voice.prediction_features(frames).collect()}
    by_hand = voice.prediction_row(framed_rows(0.05 * x, 512, 160))
    assert set(got) == {1, 2} and len(got[1]) == 1 + 14 + 8 + 8 + 3
    assert np.allclose([got[1][f"V_LSF_Mean_{k}"] for k in range(1, 15)], by_hand[:, :14].mean(axis=0)) and abs(got[1]["V_LPCGain_Std"] - by_hand[:, 30].std()) < 1e-9
    # the second reflection coefficient of an autoregression of order two is its last coefficient
    assert abs(got[1]["V_RC_2"] - 0.6) < 0.05 and abs(got[1]["V_RC_1"] + 0.75) < 0.05 and abs(got[1]["V_LAR_2"] - np.log(1.6 / 0.4)) < 0.2
    assert got[2]["V_RC_1"] == 0 and got[2]["V_LPCGain_Mean"] == 0


def vowel(resonances, widths, seconds=0.6, f0=100.0, seed=0):
    """Pulses, falling by 6 dB an octave from 50 Hz as voices do, through a chain of two-pole resonators."""
    n = int(seconds * RATE)
    x = np.zeros(n)
    x[:: int(RATE / f0)] = 1
    x += 1e-3 * np.random.default_rng(seed).standard_normal(n)
    fall = np.exp(-2 * np.pi * 50 / RATE)
    for i in range(1, n):
        x[i] += fall * x[i - 1]
    for f, b in zip(resonances, widths, strict=True):
        r, y = np.exp(-np.pi * b / RATE), np.zeros(n + 2)
        for i in range(n):
            y[i + 2] = x[i] + 2 * r * np.cos(2 * np.pi * f / RATE) * y[i + 1] - r * r * y[i]
        x = y[2:]
    return 0.5 * x / np.abs(x).max()


def test_formants_of_vowels(spark):
    tract = [(1, (600.0, 1400.0, 2600.0)), (2, (350.0, 2100.0, 2900.0))]
    rows = [(k, vowel((*f, 3600.0, 4500.0), (70, 90, 120, 150, 200)).tolist()) for k, f in tract] + [(3, [0.0] * 8000), (4, [0.1] * 50)]
    tracks = voice.formants(spark.createDataFrame(rows, "rec_id int, samples array<double>")).cache()
    means = {r.rec_id: r for r in voice.formant_features(tracks).collect()}
    for k, f in tract:
        assert all(abs(means[k][f"F{j}_Mean"] / v - 1) < 0.03 for j, v in enumerate(f, 1)), (means[k], f)
        assert abs(means[k].FormantDispersion - (means[k].F3_Mean - means[k].F1_Mean) / 2) < 1e-9 and 30 < means[k].F1_BW < 200
    assert set(means) == {1, 2, 3} and tuple(means[3])[1:] == (500.0, 1500.0, 2500.0, 1000.0, 100.0, 100.0, 100.0)
    who = {r.rec_id: r for r in voice.formant_identity(tracks).collect()}
    assert abs(who[1].V_F2F1_Ratio - 1400 / 600) < 0.1 and abs(who[1].V_VTL - 35000 / (2 * 2000)) < 0.5 and tuple(who[3])[1:] == tuple(voice.IDENTITY.values())


def test_identity_by_hand(spark):
    rng = np.random.default_rng(3)
    f = np.array([500, 1500, 2500]) + 60 * rng.standard_normal((30, 3))
    rows = [(1, k, *map(float, v)) for k, v in enumerate(f)] + [(1, 99, 400.0, None, 2000.0)] + [(2, k, 500.0, 1500.0, 2500.0) for k in range(6)] + [(3, k, 700.0, 900.0, 1000.0) for k in range(4)]
    got = {r.rec_id: tuple(r)[1:] for r in voice.formant_identity(spark.createDataFrame(rows, "rec_id int, frame int, f1 double, f2 double, f3 double")).collect()}
    m, c = f.mean(axis=0), np.corrcoef(f.T)
    want = (m[1] / m[0], m[2] / m[1], m[2] / m[0], np.clip(35000 / (2 * (m[2] - m[0])), 5, 30), *f.std(axis=0), np.linalg.norm(m - [500, 1500, 2500]), c[0, 1], c[1, 2], c[0, 2])
    assert np.allclose(got[1], want) and got[2][8:] == (0.0, 0.0, 0.0) and got[3] == tuple(voice.IDENTITY.values())


def planted(lengths, peaks):
    return np.concatenate([[0.02], 0.02 + np.cumsum(lengths)])[: len(peaks)], np.array(peaks)


def brute_perturbation(t, a):
    d = np.diff(t)
    ok = (d >= 1e-4) & (d <= 0.02)
    steady = [i for i in range(1, len(d)) if ok[i] and ok[i - 1] and max(d[i], d[i - 1]) / min(d[i], d[i - 1]) <= 1.3]
    level = [i for i in range(1, len(a)) if ok[i - 1] and min(a[i], a[i - 1]) > 0 and max(a[i], a[i - 1]) / min(a[i], a[i - 1]) <= 1.6]
    mean, height = d[ok].mean(), a[1:][ok].mean()

    def about(v, linked, width):
        h = width // 2
        x = [abs(v[i] - v[i - h : i + h + 1].mean()) for i in range(h, len(v) - h) if all(j in linked for j in range(i - h + 1, i + h + 1))]
        return np.mean(x) if x else 0

    zero = lambda x: np.mean(x) if len(x) else 0
    return (zero([abs(d[i] - d[i - 1]) for i in steady]) / mean, zero([abs(20 * np.log10(a[i] / a[i - 1])) for i in level]), about(d, steady, 3) / mean, about(d, steady, 5) / mean, about(a, level, 3) / height, about(a, level, 5) / height, about(a, level, 11) / height)


def test_perturbation_of_planted_marks(spark):
    rng = np.random.default_rng(6)
    cases = {1: (0.005 + 0.0002 * rng.standard_normal(60), 1 + 0.1 * rng.standard_normal(60)), 2: (np.where(np.arange(40) % 13 == 5, 0.03, 0.004 + 0.0008 * rng.random(40)), 0.2 + rng.random(40)), 3: (np.full(20, 0.01), np.ones(20))}
    marks = {k: planted(*v) for k, v in cases.items()}
    rows = [(k, float(t), float(a)) for k, m in marks.items() for t, a in zip(*m, strict=True)] + [(4, 0.1, 1.0)]
    got = {r.rec_id: tuple(r)[1:] for r in voice.perturbation(spark.createDataFrame(rows, "rec_id int, t double, peak double")).collect()}
    for k, m in marks.items():
        assert np.allclose(got[k], brute_perturbation(*m)), k
    assert got[4] == (0.0,) * 7 and np.allclose(got[3], 0)


def test_marks_of_pulse_trains(spark):
    """Pulses with planted perturbation of their periods and heights."""
    rng = np.random.default_rng(8)
    lengths, peaks = 80 + rng.integers(-2, 3, 150), 0.5 + 0.1 * rng.random(150)
    at = 200 + np.cumsum(lengths)
    x = np.zeros(at[-1] + 400)
    shape = np.exp(-0.5 * (np.arange(-30, 31) / 4) ** 2)
    for a, p in zip(at, peaks, strict=True):
        x[a - 30 : a + 31] += p * shape
    rows = spark.createDataFrame([(1, x.tolist())], "rec_id int, samples array<double>")
    voiced = spark.createDataFrame([(1, f, 200.0 if 2 <= f < len(x) // 160 - 2 else 0.0) for f in range(len(x) // 160)], "rec_id int, frame int, FrameF0 double")
    for longest in (3000, 20):
        got = voice.marks(rows, voiced, longest=longest).orderBy("t").collect()
        t = np.array([r.t * RATE for r in got])
        near = np.abs(t[:, None] - at[None]).min(axis=1)
        assert near.max() < 1e-6 and len(t) > (0.9 if longest == 3000 else 0.75) * len(at)
    inner = np.isin(at, np.rint(t).astype(int))
    whole = voice.marks(rows, voiced).cache()
    seen = np.rint([r.t * RATE for r in whole.orderBy("t").collect()]).astype(int)
    first, last = np.flatnonzero(at == seen[0])[0], np.flatnonzero(at == seen[-1])[0]
    assert list(at[first : last + 1]) == list(seen) and inner.any()
    want = brute_perturbation(at[first : last + 1] / RATE, peaks[first : last + 1])
    assert np.allclose(tuple(voice.perturbation(whole).head())[1:], want, rtol=1e-6)
    assert voice.marks(rows, voiced.where("false")).count() == 0


@pytest.mark.parametrize("seconds", [0.2, 0.6, 1.5])
def test_decay_of_known_time(spark, seconds):
    t = np.arange(3 * RATE) / RATE
    x = np.random.default_rng(9).standard_normal(len(t)) * 10 ** (-3 * t / seconds)
    rows = spark.createDataFrame([(1, x.tolist()), (2, [1.0] * 2000), (3, [0.0] * 600)], "rec_id int, samples array<double>")
    s = spectra.Signal(size=512, hop=160)
    got = {r.rec_id: r for r in voice.decay(spectra.framed(rows, s), s).collect()}
    assert abs(got[1].DecayTime / seconds - 1) < 0.05 and abs(got[1].RT60_Est / seconds - 1) < 0.1
    assert got[3].RT60_Est == 160 / 16000 and got[3].DecayTime is None
    c = {r.rec_id: r.C50_Est for r in voice.clarity(rows).collect()}
    assert abs(c[1] - 10 * np.log10((x[:800] ** 2).sum() / (x[800:] ** 2).sum())) < 1e-9 and c[3] == -30 and abs(c[2] - 10 * np.log10(800 / 1200)) < 1e-9


def test_formant_means_of_high_values_equal_sql(spark, tmp_path):
    """Event values above 750 make second formants below 0, which the SQL's mean takes and its bandwidth leaves out."""
    import duckdb

    import __spark_entry__ as entry

    at = str(tmp_path / "events.parquet")
    with duckdb.connect() as c:
        c.sql(f"""COPY (SELECT k AS event_id, k % 3 AS user_id, TIMESTAMP '2024-01-01' + k * INTERVAL 1 SECOND AS ts, CASE k % 5 WHEN 0 THEN 'error' ELSE 'view' END AS event_type,
          CASE WHEN k % 7 = 0 OR k % 3 = 2 THEN 790.0 ELSE 50.0 + k END AS value FROM range(60) t(k)) TO '{at}' (FORMAT parquet)""")
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{at}'")
        want = c.sql(entry.oracle_sql()["gf_formant_means"]).df().set_index("rec_id").sort_index()
    got = entry.queries()["gf_formant_means"](spark, str(tmp_path)).toPandas().set_index("rec_id").sort_index()
    assert (abs(got[want.columns] - want) < 2e-6).all().all()
