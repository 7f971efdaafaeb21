"""Voice measures of frames and recordings: harmonicity, prediction polynomials, formants, period perturbation, decay.

What a frame gives is a numpy function of Arrow batches of frames (``spectra.transformed``); what a recording gives is an
aggregate or a window over its frame or mark rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import correlation
from .spectra import EPS, Signal, correlations_of, framed, prediction_filters, resampled, residual_energy, transformed

# --- harmonicity

FLOOR, CEILING = -10.0, 40.0


def harmonic_frames(rate: int = 16000, lowest: float = 75.0, periods: float = 1.0, step: float = 0.01) -> Signal:
    """Frames of so many of the longest periods; a period is found that fits twice into a frame."""
    return Signal(rate, int(rate * periods / lowest), int(rate * step))


def at_fractions(r: np.ndarray, at: np.ndarray, reach: int = 30) -> np.ndarray:
    """Each row of ``r``, an even sequence from lag 0, at the fractional lags of the same row of ``at``, by a Hann-windowed sinc."""
    near = np.floor(at).astype(int)[:, :, None] + np.arange(1 - reach, reach + 1)
    away = at[:, :, None] - near
    values = np.take_along_axis(r[:, None, :], np.minimum(np.abs(near), r.shape[1] - 1), axis=2)
    return (values * np.sinc(away) * np.cos(np.pi * np.clip(away / reach, -1, 1) / 2) ** 2).sum(axis=2)


def harmonic_share(x: np.ndarray) -> np.ndarray:
    """Of each row: the largest autocorrelation at a period, over that of the window, 0 where there is none; and the peak."""
    n = x.shape[1]
    centred = x - x.mean(axis=1, keepdims=True)
    window = np.hanning(n + 2)[1:-1]
    own = correlations_of(window[None])[0]
    acf = correlations_of(centred * window)
    half = n // 2
    r = acf[:, : half + 2] / np.maximum(acf[:, :1], EPS) / (own[: half + 2] / own[0])
    inner = r[:, 2 : half + 1]
    is_peak = (inner > r[:, 1:half]) & (inner >= r[:, 3 : half + 2]) & (inner > 0)
    best = np.where(is_peak, inner, -1).argmax(axis=1) + 2
    found = is_peak.any(axis=1) & (acf[:, 0] > EPS)
    # a grid about the highest lag, then a parabola through the best three points of it
    grid = best[:, None] + np.linspace(-1, 1, 41)
    fine = at_fractions(acf, grid) / np.maximum(acf[:, :1], EPS) / (at_fractions(np.repeat(own[None], len(x), 0), grid) / own[0])
    top = np.clip(fine.argmax(axis=1), 1, 39)
    a, b, c = (np.take_along_axis(fine, top[:, None] + k, axis=1)[:, 0] for k in (-1, 0, 1))
    bend = 2 * b - a - c
    share = b + np.where(bend > 0, (c - a) ** 2 / (8 * np.where(bend > 0, bend, 1)), 0)
    share = np.where(share > 1, 1 / np.maximum(share, 1), np.maximum(share, 0))
    return np.stack([np.where(found, share, 0), np.abs(centred).max(axis=1)], axis=1)


def harmonicity(frames: DataFrame, silence: float = 0.1) -> DataFrame:
    """``rec_id, frame, FrameHNR`` of ``frames(rec_id, frame, samples)`` (``harmonic_frames``): decibels of the periodic
    part over the rest, within -10..40; -10 without a period, and below ``silence`` of the recording's peak."""
    rows = transformed(frames.select("rec_id", "frame", "samples"), "samples", "found", harmonic_share)
    rows = rows.select("rec_id", "frame", F.get("found", 0).alias("share"), F.get("found", 1).alias("peak"))
    quiet = F.col("peak") < silence * F.max("peak").over(W.partitionBy("rec_id"))
    db = 10 * F.log10(F.col("share") / F.greatest(1 - F.col("share"), F.lit(EPS)))
    bounded = F.least(F.greatest(db, F.lit(FLOOR)), F.lit(CEILING))
    return rows.select("rec_id", "frame", F.when(quiet | (F.col("share") <= 0), FLOOR).otherwise(bounded).alias("FrameHNR"))


# --- prediction polynomials


def roots(p: np.ndarray) -> np.ndarray:
    """Roots of each row's polynomial ``1, p1, ...``: eigenvalues of companion matrices, all rows at once."""
    n = p.shape[1] - 1
    companion = np.zeros((len(p), n, n))
    companion[:, 0] = -p[:, 1:]
    companion[:, np.arange(1, n), np.arange(n - 1)] = 1
    return np.linalg.eigvals(companion)


def reflections(filters: np.ndarray) -> np.ndarray:
    """Reflection coefficients of each filter by stepping its order down; those of size 1 or more become 0.99."""
    a, order = filters.copy(), filters.shape[1] - 1
    out = np.zeros((len(a), order))
    for m in range(order, 0, -1):
        k = np.where(np.abs(a[:, m]) >= 1, np.sign(a[:, m]) * 0.99, a[:, m])
        out[:, m - 1] = k
        a[:, 1:m] = (a[:, 1:m] - k[:, None] * a[:, m - 1 : 0 : -1]) / (1 - k * k)[:, None]
    return out


def filters_of(k: np.ndarray) -> np.ndarray:
    """The filters that have these reflection coefficients."""
    a = np.ones((len(k), 1))
    for m in range(k.shape[1]):
        longer = np.pad(a, ((0, 0), (0, 1)))
        a = longer + k[:, m, None] * longer[:, ::-1]
    return a


def line_frequencies(filters: np.ndarray) -> np.ndarray:
    """Line spectral frequencies: angles in 0..pi, ascending, of the roots of each filter's sum and difference polynomials;
    their fixed roots at 1 and -1 are divided out."""
    order = filters.shape[1] - 1
    ahead, behind = np.pad(filters, ((0, 0), (0, 1))), np.pad(filters[:, ::-1], ((0, 0), (1, 0)))
    signs = np.ones(order + 1), (-1.0) ** np.arange(order + 1)
    if order % 2 == 0:
        # of a polynomial times 1 + z, the other factor's coefficients are alternating sums, times 1 - z they are sums
        total = np.cumsum((ahead + behind)[:, :-1] * signs[1], axis=1) * signs[1]
        apart = np.cumsum((ahead - behind)[:, :-1], axis=1)
    else:
        total, apart = ahead + behind, (ahead - behind)[:, :-2].copy()
        for j in range(2, apart.shape[1]):
            apart[:, j] += apart[:, j - 2]
    angles = [np.sort(np.angle(roots(p / p[:, :1])), axis=1)[:, -((p.shape[1] - 1) // 2) :] for p in (total, apart) if p.shape[1] > 1]
    return np.sort(np.concatenate(angles, axis=1), axis=1)


def prediction_row(x: np.ndarray, order: int = 14, keep: int = 8) -> np.ndarray:
    """Of each row: ``order`` line frequencies, ``keep`` reflection coefficients, their log area ratios, what is left."""
    filters = prediction_filters(x * np.hamming(x.shape[1]), order)
    k = reflections(filters)[:, :keep]
    areas = np.log((1 + k) / (1 - k + EPS) + EPS)
    left = residual_energy(x, filters) / (np.square(x).sum(axis=1) + EPS * x.shape[1])
    return np.concatenate([line_frequencies(filters), k, areas, left[:, None]], axis=1)


def prediction_features(frames: DataFrame, order: int = 14, keep: int = 8) -> DataFrame:
    """``rec_id`` and means over ``frames(rec_id, frame, samples)``: ``V_LSF_Mean_1..``, ``V_RC_1..``, ``V_LAR_1..``, and
    ``V_LPCGain_Mean, V_LPCGain_Std, V_LPCGain_Range``. The caller picks the speech frames."""
    rows = transformed(frames.select("rec_id", "frame", "samples"), "samples", "lp", lambda x: prediction_row(x, order, keep))
    names = [f"V_LSF_Mean_{k}" for k in range(1, order + 1)] + [f"V_RC_{k}" for k in range(1, keep + 1)] + [f"V_LAR_{k}" for k in range(1, keep + 1)]
    gain = F.get("lp", len(names))
    return rows.groupBy("rec_id").agg(
        *[F.avg(F.get("lp", k)).alias(n) for k, n in enumerate(names)],
        F.avg(gain).alias("V_LPCGain_Mean"), F.stddev_pop(gain).alias("V_LPCGain_Std"), (F.max(gain) - F.min(gain)).alias("V_LPCGain_Range"),
    )


# --- formants


def at_rate(recordings: DataFrame, rate: int, to: int) -> DataFrame:
    """``recordings(rec_id, samples)`` at another rate, one recording at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.array(batch.column("samples")[k].as_py() or [], float)
                yield pa.RecordBatch.from_arrays([batch.column("rec_id").slice(k, 1), pa.array([resampled(x, rate, to)], pa.list_(pa.float64()))], ["rec_id", "samples"])

    rows = recordings.select("rec_id", "samples")
    return rows.mapInArrow(run, T.StructType([rows.schema["rec_id"], T.StructField("samples", T.ArrayType(T.DoubleType()))]))


def resonances(x: np.ndarray, rate: int, keep: int = 3, order: int = 10, emphasis: float = 50.0, margin: float = 50.0) -> np.ndarray:
    """Of each row: ``keep`` lowest resonances in hertz and then their bandwidths, NaN where there are fewer.

    A resonance is a pair of roots of the row's prediction polynomial; roots outside the circle count as their mirror
    images, those within ``margin`` hertz of either end of the band not at all."""
    n = x.shape[1]
    raised = np.concatenate([x[:, :1], x[:, 1:] - np.exp(-2 * np.pi * emphasis / rate) * x[:, :-1]], axis=1)
    bell = np.exp(-48 * ((np.arange(n) - (n - 1) / 2) / (n + 1)) ** 2)
    filters = prediction_filters(raised * (bell - np.exp(-12)) / (1 - np.exp(-12)), order)
    z = roots(filters)
    radius = np.abs(z)
    radius = np.where(radius > 1, 1 / np.maximum(radius, 1), radius)
    hertz, wide = np.angle(z) * rate / (2 * np.pi), -np.log(np.maximum(radius, 1e-300)) * rate / np.pi
    hertz = np.where((hertz > margin) & (hertz < rate / 2 - margin), hertz, np.nan)
    near = np.argsort(hertz, axis=1)[:, :keep]  # NaN last
    hertz, wide = np.take_along_axis(hertz, near, 1), np.take_along_axis(wide, near, 1)
    return np.concatenate([hertz, np.where(np.isnan(hertz), np.nan, wide)], axis=1)


def formants(recordings: DataFrame, rate: int = 16000, top: float = 5500.0, window: float = 0.05, step: float = 0.01, low: float = 50.0) -> DataFrame:
    """``rec_id, frame, f1, f2, f3, b1, b2, b3`` of ``recordings(rec_id, samples)``, null where a frame has fewer; ``low``:
    hertz from which the spectrum is raised, and by which a resonance keeps off the ends of the band."""
    to = int(2 * top)
    frames = framed(at_rate(recordings, rate, to), Signal(to, int(window * to), int(step * to)))
    rows = transformed(frames, "samples", "found", lambda x: resonances(x, to, emphasis=low, margin=low))
    names = [f"{c}{k}" for c in "fb" for k in (1, 2, 3)]
    return rows.select("rec_id", "frame", *[F.nanvl(F.get("found", k), F.lit(None).cast("double")).alias(n) for k, n in enumerate(names)])


def formant_features(tracks: DataFrame, positive: bool = True) -> DataFrame:
    """``rec_id, F1_Mean, F2_Mean, F3_Mean, FormantDispersion, F1_BW, F2_BW, F3_BW``; what no frame has takes the neutral
    tract's values (500, 1500, 2500, bandwidths of 100). ``positive``: only formants above 0 are taken, else all that are
    not null; bandwidths are those of formants above 0 either way."""
    neutral = dict(f1=500.0, f2=1500.0, f3=2500.0, b1=100.0, b2=100.0, b3=100.0)
    a = tracks.groupBy("rec_id").agg(*[F.coalesce(F.avg(F.when((F.col("f" + c[1]) > 0) | F.lit(c[0] == "f" and not positive), F.col(c))), F.lit(v)).alias(c) for c, v in neutral.items()])
    means, wide = [F.col(f"f{k}").alias(f"F{k}_Mean") for k in (1, 2, 3)], [F.col(f"b{k}").alias(f"F{k}_BW") for k in (1, 2, 3)]
    return a.select("rec_id", *means, ((F.col("f3") - F.col("f1")) / 2).alias("FormantDispersion"), *wide)


#: Values of recordings with fewer than five whole frames. Fixed values.
IDENTITY = {"V_F2F1_Ratio": 3.0, "V_F3F2_Ratio": 1.67, "V_F3F1_Ratio": 5.0, "V_VTL": 17.0, "V_F1_Dynamics": 0.0, "V_F2_Dynamics": 0.0, "V_F3_Dynamics": 0.0, "V_FormantCentralization": 0.0, "V_F1F2_Corr": 0.0, "V_F2F3_Corr": 0.0, "V_F1F3_Corr": 0.0}


def formant_identity(tracks: DataFrame, least: int = 5) -> DataFrame:
    """``rec_id`` and the columns of ``IDENTITY``: ratios of mean formants, tract length in cm within 5..30, their spread,
    distance from the neutral tract, and correlations, over the frames that have all three."""
    f = [F.when(F.greatest(*[F.col(f"f{k}") for k in (1, 2, 3)]).isNotNull() & reduce(lambda a, b: a & b, [F.col(f"f{k}") > 0 for k in (1, 2, 3)]), F.col(f"f{j}")) for j in (1, 2, 3)]
    pairs = {"c12": (0, 1), "c23": (1, 2), "c13": (0, 2)}
    a = tracks.groupBy("rec_id").agg(F.count(f[0]).alias("n"), *[F.avg(c).alias(f"m{k}") for k, c in enumerate(f, 1)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(f, 1)], *[correlation(f[i], f[j]).alias(n) for n, (i, j) in pairs.items()])
    m1, m2, m3 = F.col("m1"), F.col("m2"), F.col("m3")
    values = [
        m2 / (m1 + EPS), m3 / (m2 + EPS), m3 / (m1 + EPS), F.least(F.greatest(35000 / (4 * (m3 - m1) / 2 + EPS), F.lit(5.0)), F.lit(30.0)), F.col("s1"), F.col("s2"), F.col("s3"),
        F.sqrt(F.pow(m1 - 500, F.lit(2.0)) + F.pow(m2 - 1500, F.lit(2.0)) + F.pow(m3 - 2500, F.lit(2.0))), F.col("c12"), F.col("c23"), F.col("c13"),
    ]
    return a.select("rec_id", *[F.when(F.col("n") < least, F.lit(d)).otherwise(v).alias(n) for (n, d), v in zip(IDENTITY.items(), values, strict=True)])


# --- periods

SHORTEST, LONGEST, PERIOD_FACTOR, PEAK_FACTOR = 0.0001, 0.02, 1.3, 1.6


def perturbation(marks: DataFrame) -> DataFrame:
    """``rec_id, Jitter, Shimmer, JitterRAP, JitterPPQ5, ShimmerAPQ3, ShimmerAPQ5, ShimmerAPQ11`` of ``marks(rec_id, t, peak)``,
    a mark for each period, ``t`` in seconds.

    A period lasts 0.1 to 20 ms; neighbours are compared where neither lasts over 1.3 times the other and, for shimmer, no
    peak is over 1.6 times its neighbour's. Jitter is the mean difference of neighbours over the mean period, RAP and PPQ5
    of a period from the mean of the 3 and 5 about it; shimmer is decibels between neighbouring peaks, APQ3 to APQ11
    differences from such means over the mean peak. 0 where nothing can be compared."""
    order = W.partitionBy("rec_id").orderBy("t")
    rows = marks.select("rec_id", "t", "peak", (F.col("t") - F.lag("t").over(order)).alias("len"), F.lag("peak").over(order).alias("last"))
    rows = rows.withColumn("len", F.when(F.col("len").between(SHORTEST, LONGEST), F.col("len")))
    rows = rows.withColumn("before", F.lag("len").over(order))
    ratio = lambda a, b: F.greatest(a, b) / F.least(a, b)
    steady = F.coalesce(ratio(F.col("len"), F.col("before")) <= PERIOD_FACTOR, F.lit(False))
    level = F.coalesce(F.col("len").isNotNull() & (F.least("peak", "last") > 0) & (ratio(F.col("peak"), F.col("last")) <= PEAK_FACTOR), F.lit(False))
    rows = rows.withColumn("steady", steady.cast("int")).withColumn("level", level.cast("int"))

    def about(value: str, linked: str, width: int) -> Column:
        """Difference from the mean of ``width`` values about a row, where all of them are linked in turn."""
        h = width // 2
        near = order.rowsBetween(-h, h)
        whole = (F.count(value).over(near) == width) & (F.sum(linked).over(order.rowsBetween(1 - h, h)) == width - 1)
        return F.when(whole, F.abs(F.col(value) - F.avg(value).over(near)))

    wide = {"rap": ("len", "steady", 3), "ppq5": ("len", "steady", 5), "apq3": ("peak", "level", 3), "apq5": ("peak", "level", 5), "apq11": ("peak", "level", 11)}
    rows = rows.select("*", *[about(*w).alias(n) for n, w in wide.items()])
    jitter, shimmer = F.when(F.col("steady") == 1, F.abs(F.col("len") - F.col("before"))), F.when(F.col("level") == 1, F.abs(20 * F.log10(F.col("peak") / F.col("last"))))
    mean, height = F.avg("len"), F.avg(F.when(F.col("len").isNotNull(), F.col("peak")))
    none = F.lit(0.0)
    over = lambda x, y: F.coalesce(F.try_divide(x, y), none)
    return rows.groupBy("rec_id").agg(
        over(F.avg(jitter), mean).alias("Jitter"), F.coalesce(F.avg(shimmer), none).alias("Shimmer"), over(F.avg("rap"), mean).alias("JitterRAP"), over(F.avg("ppq5"), mean).alias("JitterPPQ5"),
        *[over(F.avg(n), height).alias(f"Shimmer{n.upper()}") for n in ("apq3", "apq5", "apq11")],
    )


def marks_of(x: np.ndarray, periods: np.ndarray, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and heights of the periods of a voiced stretch; ``periods``: samples a period at every ``hop`` samples.

    The first mark is the highest sample; on both sides of it the next mark is where, of all places between 0.8 and 1.25
    periods away, a period's samples are most like those about the mark before; places and heights are those of parabolas."""
    period = lambda at: periods[min(max(int(at) // hop, 0), len(periods) - 1)]
    out = []
    start = int(np.abs(x).argmax())
    sign = 1.0 if x[start] >= 0 else -1.0
    for way in (-1, 1):
        at = start
        while True:
            t = period(at)
            h = int(t / 2)
            low, high = int(np.floor(0.8 * t)), int(np.ceil(1.25 * t))
            a, b = at - h, at + h + 1
            first, last = (a - high, b - low) if way < 0 else (a + low, b + high)
            if a < 0 or b > len(x) or first < 0 or last > len(x):
                break
            rows = np.lib.stride_tricks.sliding_window_view(x[first:last], b - a)
            norms = np.sqrt(np.square(rows).sum(axis=1) * (x[a:b] @ x[a:b])) + EPS
            best = int((rows @ x[a:b] / norms).argmax())
            at = first + best + h
            # the highest sample within a tenth of a period
            near = slice(max(at - int(t / 10), 0), at + int(t / 10) + 1)
            at = near.start + int((sign * x[near]).argmax())
            if at == start:
                break
            out.append(at)
    places = np.unique([start, *out])
    places = places[(places > 0) & (places < len(x) - 1)]
    left, mid, right = (sign * x[places + k] for k in (-1, 0, 1))
    bend = 2 * mid - left - right
    shift = np.where(bend > 0, (right - left) / (2 * np.where(bend > 0, bend, 1)), 0.0)
    return places + np.clip(shift, -1, 1), mid + np.clip(shift, -1, 1) * (right - left) / 4


def marks(recordings: DataFrame, pitches: DataFrame, rate: int = 16000, hop: int = 160, longest: int = 3000) -> DataFrame:
    """``rec_id, t, peak``: period marks of ``recordings(rec_id, samples)`` in the voiced frames of ``pitches(rec_id, frame,
    FrameF0)``, whose frames are centred on every ``hop``-th sample. A stretch of voiced frames is a row, cut after
    ``longest`` frames, and holds its own samples only."""
    order = W.partitionBy("rec_id").orderBy("frame")
    voiced = pitches.where("FrameF0 > 0").withColumn("g", F.col("frame") - F.row_number().over(order))
    run = W.partitionBy("rec_id", "g").orderBy("frame")
    voiced = voiced.withColumn("g2", F.floor((F.row_number().over(run) - 1) / longest))
    stretches = voiced.groupBy("rec_id", "g", "g2").agg(F.min("frame").alias("first"), F.array_sort(F.collect_list(F.struct("frame", "FrameF0"))).alias("f"))
    begin = F.greatest(F.col("first") * hop - hop // 2, F.lit(0))
    held = stretches.join(recordings.select("rec_id", "samples"), "rec_id").select("rec_id", begin.alias("begin"), F.slice("samples", (begin + 1).cast("int"), (F.size("f") * hop).cast("int")).alias("samples"), F.transform("f", lambda v: rate / v["FrameF0"]).alias("periods"))
    schema = T.StructType([recordings.schema["rec_id"], T.StructField("t", T.DoubleType()), T.StructField("peak", T.DoubleType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x = np.array(batch.column("samples")[k].as_py() or [], float)
                at, peak = marks_of(x, np.array(batch.column("periods")[k].as_py(), float), hop) if len(x) > 2 else (np.zeros(0), np.zeros(0))
                rec = pa.array([batch.column("rec_id")[k].as_py()] * len(at), batch.schema.field("rec_id").type)
                yield pa.RecordBatch.from_arrays([rec, pa.array((at + batch.column("begin")[k].as_py()) / rate), pa.array(peak)], schema.names)

    return held.mapInArrow(mark, schema)


# --- decay


def decay(frames: DataFrame, s: Signal, most: float = 5.0) -> DataFrame:
    """``rec_id, RT60_Est, DecayTime`` of ``frames(rec_id, frame, samples)``: seconds from the loudest frame to the first
    one 60 dB below it, or to the end, ``most`` at most; and 60 dB over the slope of the line through the energy that is
    still to come, from 5 to 35 dB below the whole, null where it doesn't fall so far."""
    order = W.partitionBy("rec_id").orderBy("frame")
    rows = frames.select("rec_id", "frame", (F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v) / F.size("samples")).alias("e"))
    rows = rows.withColumn("db", 20 * F.log10(F.sqrt("e") + EPS))
    peak = rows.groupBy("rec_id").agg(F.max(F.struct("db", (-F.col("frame")).alias("at"))).alias("p")).select("rec_id", F.col("p.db").alias("top"), (-F.col("p.at")).alias("from"))
    rows = rows.join(peak, "rec_id").where(F.col("frame") >= F.col("from"))
    rows = rows.withColumn("left", F.sum("e").over(order.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("fall", 10 * F.log10(F.try_divide(F.col("left"), F.max("left").over(W.partitionBy("rec_id"))) + EPS))
    inside = F.col("fall").between(-35, -5)
    steps = F.coalesce(F.min(F.when(F.col("db") <= F.col("top") - 60, F.col("frame") - F.col("from"))), F.count("*"))
    slope = F.regr_slope(F.when(inside, F.col("fall")), F.when(inside, F.col("frame") * s.hop / s.rate))
    return rows.groupBy("rec_id").agg(F.least(steps * s.hop / s.rate, F.lit(most)).alias("RT60_Est"), F.when(slope < 0, -60 / slope).alias("DecayTime"))


def clarity(recordings: DataFrame, rate: int = 16000, early: float = 0.05) -> DataFrame:
    """``rec_id, C50_Est``: decibels of the energy of the first 50 ms over that of the rest, within -30..30."""
    n = int(early * rate)
    energy = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    rows = recordings.where(F.size("samples") > 0)
    late = F.slice("samples", n + 1, F.greatest(F.size("samples") - n, F.lit(0)))
    c = 10 * F.log10(energy(F.slice("samples", 1, n)) / (energy(late) + EPS) + EPS)
    return rows.select("rec_id", F.least(F.greatest(c, F.lit(-30.0)), F.lit(30.0)).alias("C50_Est"))


def prosody(pitches: DataFrame) -> DataFrame:
    """``rec_id, MeanF0, F0_StdDev`` over the voiced frames of ``pitches(rec_id, frame, FrameF0)``, 0 without any."""
    f = F.when(F.col("FrameF0") > 0, F.col("FrameF0"))
    return pitches.groupBy("rec_id").agg(F.coalesce(F.avg(f), F.lit(0.0)).alias("MeanF0"), F.coalesce(F.stddev_pop(f), F.lit(0.0)).alias("F0_StdDev"))
