"""Recordings as rows: samples, frames, spectra and their measures.

A recording is one row with an array of samples; its frames are rows ``(rec_id, frame, samples)``, and everything about a
frame is a column of it. Decoding a WAV file, the Fourier transform and linear prediction of a frame are small numpy
functions that see Arrow batches of rows (``transformed``); all measures are expressions over the arrays that these give,
and what looks across frames (floors, medians, slopes, flux) is a window or an aggregate by recording. So a recording's
frames need not be in one task, and long recordings are as good as many short ones.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .statistics import BOUNDARIES, LEAST_FRAMES, STATISTICS

EPS = 1e-12


@dataclass(frozen=True)
class Signal:
    """Sampling rate, samples of a frame, samples from one frame to the next."""

    rate: int = 16000
    size: int = 512
    hop: int = 160

    @property
    def bins(self) -> int:
        return self.size // 2 + 1

    @property
    def step(self) -> float:
        """Hertz from one bin to the next."""
        return self.rate / self.size


# --- samples


def decode_wav(content: bytes, mono: str) -> tuple[np.ndarray, int]:
    """Samples in -1..1 and their rate; channels are averaged (``mean``) or the ``first`` is taken."""
    with wave.open(io.BytesIO(content)) as w:
        channels, width, rate, raw = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())
    if width == 3:  # three bytes become the upper ones of four
        raw, width = b"".join(b"\0" + raw[i : i + 3] for i in range(0, len(raw), 3)), 4
    values = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    values = (values - 128) / 128 if width == 1 else values / 2.0 ** (8 * width - 1)
    values = values.reshape(-1, channels)
    return (values[:, 0] if mono == "first" else values.mean(axis=1)), rate


def resampled(x: np.ndarray, rate: int, to: int, zeros: int = 16) -> np.ndarray:
    """Band-limited interpolation: a Hann-windowed sinc with its cut-off at the lower of the two half rates."""
    if rate == to:
        return x
    scale = min(1.0, to / rate)
    reach = int(np.ceil(zeros / scale))
    padded, out = np.pad(x, reach + 1), []
    for at in range(0, -(-len(x) * to // rate), 1 << 14):
        t = np.arange(at, min(at + (1 << 14), -(-len(x) * to // rate))) * (rate / to)
        near = np.floor(t).astype(int)[:, None] + np.arange(1 - reach, reach + 1)
        away = t[:, None] - near
        out.append((padded[near + reach + 1] * np.sinc(away * scale) * scale * np.cos(np.pi * np.clip(away / reach, -1, 1) / 2) ** 2).sum(axis=1))
    return np.concatenate(out) if out else x


def decoded(recordings: DataFrame, rate: int = 16000, mono: str = "mean") -> DataFrame:
    """O1, O2: ``rec_id, samples array<double>, error`` of ``recordings(rec_id, content)`` at ``rate``; samples are null
    where the error says why a file could not be read. Values that are not finite become 0."""
    kind = recordings.schema["rec_id"]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a recording at a time is held twice, not a batch of them
                samples, error = None, None
                try:
                    x, own = decode_wav(batch.column("content")[k].as_py() or b"", mono)
                    samples = resampled(np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0), own, rate)
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([batch.column("rec_id").slice(k, 1), pa.array([samples], pa.list_(pa.float64())), pa.array([error], pa.string())], names=["rec_id", "samples", "error"])

    schema = T.StructType([kind, T.StructField("samples", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])
    return recordings.select("rec_id", "content").mapInArrow(run, schema)


def cropped(x: Column, most: int) -> Column:
    """O1: at most ``most`` samples from the middle."""
    n = F.size(x)
    return F.when(n > most, F.slice(x, F.floor(n / 2).cast("int") - most // 2 + 1, F.lit(most))).otherwise(x)


def total(x: Column, f: Callable[[Column, Column], Column] | None = None) -> Column:
    """Sum of an array, or of ``f(value, place from 0)`` over it."""
    return F.aggregate(F.transform(x, f) if f else x, F.lit(0.0), lambda s, v: s + v)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with ``value`` computed once and not again for every element of a function inside ``f``."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalised(x: Column) -> Column:
    """V0: no offset, peak at 0.95."""
    centred = bound(F.try_divide(total(x), F.size(x)), lambda mean: F.transform(x, lambda v: v - mean))
    scaled = lambda y: bound(F.array_max(F.transform(y, F.abs)) + 1e-8, lambda peak: F.transform(y, lambda v: v / peak * 0.95))
    return bound(centred, scaled)


# --- frames


def framed(recordings: DataFrame, s: Signal, pad: str | None = None) -> DataFrame:
    """``rec_id, frame, samples`` of ``recordings(rec_id, samples)``. ``pad``: half a frame of ``zero`` or ``edge`` values
    before and behind, so that frames are centred. Recordings shorter than a frame have none."""
    x = F.col("samples")
    if pad:
        fill = lambda v: F.array_repeat(v, s.size // 2)
        x = F.concat(fill(F.lit(0.0)), x, fill(F.lit(0.0))) if pad == "zero" else F.concat(fill(F.element_at(x, 1)), x, fill(F.element_at(x, -1)))
    rows = recordings.where(F.size("samples") > 0).select("rec_id", x.alias("x")).where(F.size("x") >= s.size)
    starts = F.sequence(F.lit(0), F.floor((F.size("x") - s.size) / s.hop).cast("int"))
    parts = F.transform(starts, lambda k: F.slice("x", k * s.hop + 1, F.lit(s.size)))
    return rows.select("rec_id", F.posexplode(parts).alias("frame", "samples"))


#: Numbers that ``transformed`` hands to its function at once.
AT_ONCE = 1 << 14


def transformed(rows: DataFrame, column: str, name: str, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``rows`` with the array column ``name``: ``f`` of the equally long arrays in ``column``, of some ``AT_ONCE`` numbers at
    a time, since what ``f`` makes of a row on its way may be a thousand times as large."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    most = AT_ONCE

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                some = max(1, most // max(x.shape[1], 1))
                out = np.concatenate([f(x[at : at + some]) for at in range(0, len(x), some)])
                offsets = pa.array(np.arange(len(out) + 1) * out.shape[1], pa.int32())
                made = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(out).reshape(-1)))
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=schema.names)

    return rows.mapInArrow(run, schema)


def periodic_hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def powered(frames: DataFrame, s: Signal) -> DataFrame:
    """``frames`` with ``power``: squared magnitudes of the Hann-windowed frame's spectrum."""
    return transformed(frames, "samples", "power", lambda x: np.abs(np.fft.rfft(x * periodic_hann(s.size), axis=1)) ** 2)


def speech_only(frames: DataFrame, mask: str = "speech") -> DataFrame:
    """V5: ``rec_id, samples`` of the speech frames' hops ``(rec_id, frame, hop, speech)`` in order, runs of speech parted
    by a hop of silence; recordings without speech are left out."""
    order = W.partitionBy("rec_id").orderBy("frame")
    rows = frames.withColumn("before", F.lag("frame").over(W.partitionBy("rec_id", mask).orderBy("frame"))).where(mask)
    first = F.row_number().over(order) == 1
    fresh = ~first & ~F.col("before").eqNullSafe(F.col("frame") - 1)
    silence = F.transform("hop", lambda v: F.lit(0.0))
    parts = rows.withColumn("part", F.when(fresh, F.concat(silence, "hop")).otherwise(F.col("hop")))
    held = parts.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("frame", "part"))).alias("parts"))
    return held.select("rec_id", F.flatten(F.transform("parts", lambda p: p["part"])).alias("samples"))


# --- measures of spectra


def spectral_measures(frames: DataFrame, s: Signal) -> DataFrame:
    """``rec_id, frame`` and FrameSF, SE, SR, SS, SSkew, SKurt, SCF, SBW, SFlux of ``frames(rec_id, frame, power)``."""
    p, n = F.col("power"), float(s.bins)
    hertz = lambda i: i * s.step
    middle = (s.bins - 1) / 2
    rows = frames.select("rec_id", "frame", "power", total(p).alias("sum"), F.transform(p, lambda v: F.ln(v + EPS)).alias("logs"), F.transform(p, F.sqrt).alias("mag"))
    rows = rows.withColumn("share", F.transform(p, lambda v: v / (F.col("sum") + EPS))).withColumn("norm", F.sqrt("sum")).withColumn("mags", total(F.col("mag")))
    rows = rows.withColumn("mid", total(F.col("share"), lambda v, i: v * hertz(i))).withColumn("centre", total(F.col("mag"), lambda v, i: v * hertz(i)) / F.when(F.col("mags") > 0, F.col("mags")).otherwise(1.0))
    rows = rows.withColumn("spread", F.sqrt(total(F.col("share"), lambda v, i: v * F.pow(hertz(i) - F.col("mid"), F.lit(2.0))) + EPS))
    before = F.lag("mag").over(W.partitionBy("rec_id").orderBy("frame"))
    rows = rows.withColumn("before", F.coalesce(before, F.col("mag")))
    moment = lambda k: total(F.col("share"), lambda v, i: v * F.pow((hertz(i) - F.col("mid")) / F.col("spread"), F.lit(float(k))))
    run = F.aggregate(p, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, v: F.struct((a["sum"] + v).alias("sum"), (a["n"] + F.when(a["sum"] + v < 0.85 * (F.col("sum") + EPS), 1).otherwise(0)).alias("n")))
    squares = sum((k - middle) ** 2 for k in range(s.bins))
    length = F.sqrt(total(F.col("before"), lambda v, i: v * v)) + EPS
    away = bound(length, lambda n: F.zip_with("mag", "before", lambda a, b: F.pow(a / (F.col("norm") + EPS) - b / n, F.lit(2.0))))
    return rows.select(
        "rec_id", "frame",
        F.least(F.greatest(F.exp(total(F.col("logs")) / n) / (F.col("sum") / n + EPS), F.lit(0.0)), F.lit(1.0)).alias("FrameSF"),
        (-total(F.col("share"), lambda v, i: v * F.ln(v + EPS)) / float(np.log(s.bins))).alias("FrameSE"),
        (F.least(run["n"], F.lit(s.bins - 1)) * s.step).alias("FrameSR"),
        (total(F.col("logs"), lambda v, i: v * (i - middle)) / (squares + EPS)).alias("FrameSS"),
        moment(3).alias("FrameSSkew"), (moment(4) - 3).alias("FrameSKurt"), (F.array_max(p) / (F.col("sum") / n + EPS)).alias("FrameSCF"),
        F.sqrt(total(F.col("mag"), lambda v, i: v * F.pow(hertz(i) - F.col("centre"), F.lit(2.0))) / F.when(F.col("mags") > 0, F.col("mags")).otherwise(1.0)).alias("FrameSBW"),
        F.sqrt(total(away)).alias("FrameSFlux"), F.col("centre").alias("Centroid"),
    )


def decibels(x: Column) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(1e-10)))


def contrast(frames: DataFrame, s: Signal, lowest: float = 200.0, bands: int = 6, quantile: float = 0.02) -> DataFrame:
    """``rec_id, frame, FrameSC``: mean over octave bands of the decibels between the largest and the smallest
    ``quantile`` of a band's magnitudes, at most 80 dB below the recording's loudest.

    A band takes the bin below it too, the last one all bins above; all but the last leave their top bin to the next.
    """
    edges = [0.0, *(lowest * 2.0**k for k in range(bands + 1))]
    tops, lows = [], []
    for k in range(bands + 1):
        inside = [b for b in range(s.bins) if edges[k] <= b * s.step <= edges[k + 1]]
        first, last = inside[0] - (k > 0), s.bins - 1 if k == bands else inside[-1]
        wide, keep = last - first + (k == bands), max(int(np.rint(quantile * (last - first + 1))), 1)
        part = F.array_sort(F.transform(F.slice("power", first + 1, wide), F.sqrt))
        lows.append(total(F.slice(part, 1, min(keep, wide))) / min(keep, wide))
        tops.append(total(F.slice(part, -min(keep, wide), min(keep, wide))) / min(keep, wide))
    rows = frames.select("rec_id", "frame", F.transform(F.array(*tops), decibels).alias("tops"), F.transform(F.array(*lows), decibels).alias("lows"))
    whole = W.partitionBy("rec_id")
    rows = rows.withColumn("top", F.max(F.array_max("tops")).over(whole) - 80).withColumn("low", F.max(F.array_max("lows")).over(whole) - 80)
    above = F.zip_with("tops", "lows", lambda a, b: F.greatest(a, F.col("top")) - F.greatest(b, F.col("low")))
    return rows.select("rec_id", "frame", (total(above) / (bands + 1)).alias("FrameSC"))


def mel_filters(s: Signal, bands: int, low: float, high: float) -> np.ndarray:
    """Triangles of equal area, evenly spaced on a scale that is linear to 1 kHz and logarithmic above."""
    ratio = np.log(6.4) / 27  # per mel step above 1 kHz
    mel = lambda f: f * 0.015 if f < 1000 else 15 + np.log(f / 1000) / ratio
    marks = np.linspace(mel(low), mel(high), bands + 2)
    hertz = np.where(marks < 15, marks / 0.015, 1000 * np.exp(ratio * (marks - 15)))
    f = np.arange(s.bins) * s.step
    left, mid, right = hertz[:-2, None], hertz[1:-1, None], hertz[2:, None]
    return np.clip(np.minimum((f - left) / (mid - left), (right - f) / (right - mid)), 0, None) * 2 / (right - left)


def cosine_basis(keep: int, n: int) -> np.ndarray:
    """Rows of the orthonormal cosine transform."""
    k = np.arange(keep)[:, None]
    return np.cos(np.pi * k * (np.arange(n) + 0.5) / n) * np.sqrt(np.where(k == 0, 1, 2) / n)


def cepstra(frames: DataFrame, s: Signal, keep: int = 14, bands: int = 40, low: float = 20.0, high: float | None = None) -> DataFrame:
    """``rec_id, frame, cepstrum``: cosine transform of mel energies in dB, at most 80 dB below the recording's loudest."""
    filters = mel_filters(s, bands, low, high or s.rate / 2)
    rows = transformed(frames.select("rec_id", "frame", "power"), "power", "mel", lambda p: p @ filters.T)
    rows = rows.select("rec_id", "frame", F.transform("mel", decibels).alias("db"))
    rows = rows.withColumn("floor", F.max(F.array_max("db")).over(W.partitionBy("rec_id")) - 80)
    rows = rows.select("rec_id", "frame", F.transform("db", lambda v: F.greatest(v, F.col("floor"))).alias("db"))
    basis = cosine_basis(keep, bands)
    return transformed(rows, "db", "cepstrum", lambda x: x @ basis.T).select("rec_id", "frame", "cepstrum")


def slopes(rows: DataFrame, column: str, name: str, order: int, width: int = 9) -> DataFrame:
    """``rows`` with ``name``: derivative of degree and order ``order`` of an array column along the frames, by least
    squares in windows of ``width``; the ends have that of the first and last whole window, fewer frames have zeros."""
    t = np.arange(width) - width // 2.0
    weights = np.linalg.pinv(np.vander(t, order + 1, increasing=True))[order] * (1 if order == 1 else 2)
    frame = W.partitionBy("rec_id").orderBy("frame")
    rows = rows.withColumn("near", F.collect_list(column).over(frame.rowsBetween(-(width // 2), width // 2)))
    weighted = F.zip_with("near", F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: F.transform(v, lambda x: x * w))
    added = F.aggregate(weighted, F.transform(column, lambda x: F.lit(0.0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    rows = rows.withColumn("own", F.when(F.size("near") == width, added))
    ahead = F.first("own", ignorenulls=True).over(frame.rowsBetween(0, W.unboundedFollowing))
    behind = F.last("own", ignorenulls=True).over(frame.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(ahead, behind, F.transform(column, lambda x: F.lit(0.0)))).drop("near", "own")


def spread_of(x: Column) -> Column:
    """Variance over an array."""
    n = F.size(x)
    return bound(total(x) / n, lambda m: total(F.transform(x, lambda v: (v - m) * (v - m))) / n)


def cepstral_measures(cepstrum: DataFrame) -> DataFrame:
    """``rec_id, frame, FrameMFCCVar, FrameDeltaMFCC, FrameDeltaDeltaMFCC``: variance over the coefficients but the first."""
    rows = slopes(slopes(cepstrum, "cepstrum", "d1", 1), "cepstrum", "d2", 2)
    body = lambda c: F.slice(c, 2, F.size(c) - 1)
    return rows.select("rec_id", "frame", *[spread_of(body(F.col(c))).alias(n) for c, n in (("cepstrum", "FrameMFCCVar"), ("d1", "FrameDeltaMFCC"), ("d2", "FrameDeltaDeltaMFCC"))])


# --- measures of samples


def level_measures(frames: DataFrame) -> DataFrame:
    """``rec_id, frame, FrameE, FrameSNR``: decibels, and those above the 10th percentile of the recording's frames."""
    rows = frames.select("rec_id", "frame", (total(F.col("samples"), lambda v, i: v * v) / F.size("samples")).alias("level"))
    floor = rows.where("level > 0").groupBy("rec_id").agg(F.greatest(F.percentile("level", 0.1), F.lit(EPS)).alias("floor"))
    rows = rows.join(floor, "rec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(EPS)))
    snr = 10 * F.log10(F.col("level") / F.col("floor") + EPS)
    return rows.select("rec_id", "frame", (20 * F.log10(F.sqrt("level") + EPS)).alias("FrameE"), F.least(F.greatest(snr, F.lit(-10.0)), F.lit(60.0)).alias("FrameSNR"))


def crossings(frames: DataFrame) -> DataFrame:
    """``rec_id, frame, FrameZCR``: share of a frame's samples whose sign differs from the one before, in edge-padded frames."""
    signs = F.transform("samples", lambda v: F.when(v < 0, 1).otherwise(0))
    pairs = F.zip_with(F.slice(signs, 2, F.size("samples") - 1), F.slice(signs, 1, F.size("samples") - 1), lambda a, b: F.abs(a - b).cast("double"))
    return frames.select("rec_id", "frame", (total(pairs) / F.size("samples")).alias("FrameZCR"))


def correlations_of(x: np.ndarray) -> np.ndarray:
    """Autocorrelation of each row at lags 0 .. n - 1."""
    n = x.shape[1]
    return np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n, axis=1)) ** 2, 2 * n, axis=1)[:, :n]


def periodicity(frames: DataFrame, s: Signal, lowest: float = 60.0, highest: float = 500.0) -> DataFrame:
    """``rec_id, frame, FrameAC, FrameSHR``: the largest normalised autocorrelation at a period between the two pitches,
    and the one around twice that period relative to it, within 0..2; both 0 in silence."""
    low, high = int(s.rate // highest), min(int(s.rate // lowest), s.size - 1)
    reach = high // 10
    rows = transformed(frames.select("rec_id", "frame", "samples"), "samples", "acf", correlations_of)
    rows = rows.withColumn("part", F.slice("acf", low + 1, high - low + 1)).withColumn("peak", F.array_max("part")).withColumn("energy", F.element_at("acf", 1))
    rows = rows.withColumn("lag", (F.array_position("part", F.col("peak")) - 1 + low).cast("int"))
    first, last = F.greatest(2 * F.col("lag") - reach, F.lit(0)), F.least(2 * F.col("lag") + reach, F.lit(s.size))
    sub = F.when(last > first, F.array_max(F.slice("acf", first + 1, last - first)))
    quiet, over = F.col("energy") < EPS, F.col("energy") + EPS
    shr = F.least(F.greatest(sub / over / (F.col("peak") / over + EPS), F.lit(0.0)), F.lit(2.0))
    return rows.select("rec_id", "frame", F.when(quiet, 0.0).otherwise(F.col("peak") / over).alias("FrameAC"), F.when(quiet, 0.0).otherwise(F.coalesce(shr, F.lit(0.0))).alias("FrameSHR"))


def cepstral_peak(frames: DataFrame, s: Signal, lowest: float = 60.0, highest: float = 500.0) -> DataFrame:
    """``rec_id, frame, FrameCPP``: how far the real cepstrum's peak at a period between the two pitches stands above the
    straight line through the whole of it. The cepstrum is even, so the lower pitch should have two periods in a frame."""
    low, high = int(s.rate // highest), min(int(s.rate // lowest), s.size - 1)
    taper = np.hanning(s.size)
    rows = transformed(frames.select("rec_id", "frame", "samples"), "samples", "c", lambda x: np.fft.irfft(np.log(np.abs(np.fft.rfft(x * taper, axis=1)) ** 2 + EPS), s.size, axis=1))
    middle = (s.size - 1) / 2
    squares = sum((k - middle) ** 2 for k in range(s.size))
    part = F.slice("c", low + 1, high - low)
    rows = rows.withColumn("peak", F.array_max(part)).withColumn("at", F.array_position(part, F.array_max(part)) - 1 + low)
    line = total(F.col("c")) / s.size + total(F.col("c"), lambda v, i: v * (i - middle)) / squares * (F.col("at") - middle)
    return rows.select("rec_id", "frame", (F.col("peak") - line).alias("FrameCPP"))


def prediction_filters(x: np.ndarray, order: int) -> np.ndarray:
    """Filters ``1, a1, ...`` of linear prediction of the rows (Burg's lattice); a row of zeros has ``1, 0, ...``."""
    forward, backward = x[:, 1:], x[:, :-1]
    filters = np.pad(np.ones((len(x), 1)), ((0, 0), (0, order)))
    for m in range(1, order + 1):
        k = -2 * np.einsum("ij,ij->i", forward, backward) / (np.square(forward).sum(axis=1) + np.square(backward).sum(axis=1) + EPS)
        filters[:, 1 : m + 1] += k[:, None] * filters[:, m - 1 :: -1][:, :m] if m > 1 else k[:, None]
        forward, backward = (forward + k[:, None] * backward)[:, 1:], (backward + k[:, None] * forward)[:, :-1]
    return filters


def residual_energy(x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    """Energy of what the filters leave of the rows."""
    return np.square(sum(filters[:, j, None] * np.pad(x, ((0, 0), (j, 0)))[:, : x.shape[1]] for j in range(filters.shape[1]))).sum(axis=1)


def unpredicted(x: np.ndarray, order: int) -> np.ndarray:
    """Energy that linear prediction of the Hamming-windowed rows leaves of them, and their energy."""
    filters = prediction_filters(x * np.hamming(x.shape[1]), order)
    return np.stack([residual_energy(x, filters), np.square(x).sum(axis=1)], axis=1)


def predictability(frames: DataFrame, order: int = 14) -> DataFrame:
    """``rec_id, frame, FrameGNE``: share of a frame's energy that linear prediction explains, 0 in silence."""
    rows = transformed(frames.select("rec_id", "frame", "samples"), "samples", "left", lambda x: unpredicted(x, order))
    left, energy = F.element_at("left", 1), F.element_at("left", 2)
    return rows.select("rec_id", "frame", F.when(energy < EPS, 0.0).otherwise(F.least(F.greatest(1 - left / (energy + EPS), F.lit(0.0)), F.lit(1.0))).alias("FrameGNE"))


# --- features of recordings


def speech_frames(measures: DataFrame, mask: DataFrame) -> DataFrame:
    """V6: of ``measures(rec_id, frame, ...)`` the rows whose place in the recording falls on a speech frame of
    ``mask(rec_id, frame, speech)``: the mask is read at as many evenly spaced places as there are rows, half to even."""
    whole = W.partitionBy("rec_id")
    rows = measures.withColumn("many", F.count("*").over(whole))
    sized = mask.select("rec_id", F.col("frame").alias("m_frame"), "speech", F.count("*").over(whole).alias("m_many"))
    counts = sized.groupBy("rec_id").agg(F.max("m_many").alias("of"))
    at = F.when(F.col("many") > 1, F.bround(F.col("frame") * (F.col("of") - 1) / (F.col("many") - 1).cast("double"))).otherwise(0)
    rows = rows.join(counts, "rec_id").withColumn("at", at.cast("long"))
    spoken = sized.where("speech").select(F.col("rec_id").alias("m_rec"), "m_frame")
    return rows.join(spoken, (F.col("rec_id") == F.col("m_rec")) & (F.col("at") == F.col("m_frame")), "left_semi").drop("many", "of", "at")


def frame_features(measures: DataFrame) -> DataFrame:
    """H1: ``rec_id, measure, n`` and the 19 statistics of each measure's values in ``measures(rec_id, frame, Frame...)``;
    all 0 below ten frames, values that are not finite count as 0."""
    names = [c for c in measures.columns if c in BOUNDARIES]
    rows = measures.unpivot(["rec_id"], names, "measure", "v")
    x = F.when(F.isnan("v") | (F.abs("v") == float("inf")), None).otherwise(F.col("v"))
    edges = F.create_map(*[c for n in names for c in (F.lit(n), F.array(*[F.lit(float(b)) for b in BOUNDARIES[n]]))])[F.col("measure")]
    rows = rows.select("rec_id", "measure", F.coalesce(x, F.lit(0.0)).alias("x")).withColumn("b", F.size(F.filter(edges, lambda e: F.col("x") >= e)))
    n = F.count("*")
    q = F.percentile("x", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    a = rows.groupBy("rec_id", "measure").agg(
        n.alias("n"), *[(F.count_if(F.col("b") == k) / n).alias(f"Hist{k}") for k in range(10)], F.avg("x").alias("Mean"), F.stddev_pop("x").alias("Std"),
        F.coalesce(F.skewness("x"), F.lit(0.0)).alias("Skew"), F.coalesce(F.kurtosis("x"), F.lit(0.0)).alias("Kurt"), q.alias("q"), (F.max("x") - F.min("x")).alias("Range"),
    )
    a = a.select("*", F.col("q")[2].alias("Median"), (F.col("q")[3] - F.col("q")[1]).alias("IQR"), F.col("q")[0].alias("P5"), F.col("q")[4].alias("P95"))
    return a.select("rec_id", "measure", "n", *[F.when(F.col("n") < LEAST_FRAMES, 0.0).otherwise(F.col(c)).alias(c) for c in STATISTICS])


def mean_spectrum(frames: DataFrame) -> DataFrame:
    """``rec_id, bin, power``: the mean over a recording's frames."""
    return frames.select("rec_id", F.posexplode("power").alias("bin", "p")).groupBy("rec_id", "bin").agg(F.avg("p").alias("power"))


def spectrum_features(frames: DataFrame, s: Signal, split: float = 1000.0, top: float = 5000.0, edge: float = 2000.0, slope: tuple[float, float] = (500.0, 1500.0)) -> DataFrame:
    """Whole-recording features of the mean spectrum: ``rec_id, bandwidth`` (95 % of the energy lies below), ``alpha_ratio``
    (decibels of the band from ``split`` to ``top`` over the one below it), ``hammarberg`` (strongest bin below ``edge`` over
    the strongest from there to ``top``, in dB), ``slope`` (decibels a hertz in that range), ``low_to_high``."""
    rows = mean_spectrum(frames).withColumn("hertz", F.col("bin") * s.step).withColumn("db", decibels(F.col("power")))
    whole = W.partitionBy("rec_id")
    rows = rows.withColumn("run", F.sum("power").over(whole.orderBy("bin"))).withColumn("all", F.sum("power").over(whole))
    f = F.col("hertz")
    some = lambda c, x: F.when(c, x)
    low, high = F.sum(some(f < split, F.col("power"))), F.sum(some((f >= split) & (f <= top), F.col("power")))
    inside = f.between(*slope)
    return rows.groupBy("rec_id").agg(
        F.min(some(F.col("run") >= 0.95 * F.col("all"), f)).alias("bandwidth"), (10 * F.log10((high + EPS) / (low + EPS))).alias("alpha_ratio"),
        (F.max(some(f < edge, F.col("db"))) - F.max(some((f >= edge) & (f <= top), F.col("db")))).alias("hammarberg"),
        F.coalesce(F.regr_slope(some(inside, F.col("db")), some(inside, f)), F.lit(0.0)).alias("slope"),
        ((low + EPS) / (F.sum(some(f >= split, F.col("power"))) + EPS)).alias("low_to_high"),
    )


def band_noise(frames: DataFrame, s: Signal, bands: list[tuple[float, float]]) -> DataFrame:
    """``rec_id, band, snr``: decibels of the mean power in the speech frames of ``frames(rec_id, frame, power, speech)``
    over that in the others, of each band, within -20..60; where no frame is without speech, 60."""
    f = F.col("bin") * s.step
    named = [F.when((f >= a) & (f < b), k) for k, (a, b) in enumerate(bands)]
    rows = frames.select("rec_id", "speech", F.posexplode("power").alias("bin", "p")).withColumn("band", F.coalesce(*named)).where("band is not null")
    a = rows.groupBy("rec_id", "band").agg(F.avg(F.when(F.col("speech"), F.col("p"))).alias("voice"), F.avg(F.when(~F.col("speech"), F.col("p"))).alias("noise"))
    snr = 10 * F.log10((F.coalesce("voice", F.lit(0.0)) + EPS) / (F.col("noise") + EPS))
    return a.select("rec_id", "band", F.coalesce(F.least(F.greatest(snr, F.lit(-20.0)), F.lit(60.0)), F.lit(60.0)).alias("snr"))


def sample_features(recordings: DataFrame) -> DataFrame:
    """``rec_id, dc, clipped_share, zcr`` of ``recordings(rec_id, samples)``: the offset, the share of samples at 0.99 or
    more, sign changes a sample."""
    x = F.col("samples")
    n = F.size(x)
    signs = F.transform(x, lambda v: F.when(v < 0, 1).otherwise(0))
    turns = total(F.zip_with(F.slice(signs, 2, n - 1), F.slice(signs, 1, n - 1), lambda a, b: F.abs(a - b).cast("double")))
    return recordings.where(n > 0).select("rec_id", F.abs(total(x) / n).alias("dc"), (total(x, lambda v, i: F.when(F.abs(v) >= 0.99, 1.0).otherwise(0.0)) / n).alias("clipped_share"), (turns / n).alias("zcr"))


def energy(levels: DataFrame) -> DataFrame:
    """``rec_id, energy``: decibels of the mean root mean square of the speech frames of ``levels(rec_id, rms, speech)``,
    -60 where there are none."""
    voiced = F.avg(F.when(F.col("speech"), F.col("rms")))
    return levels.groupBy("rec_id").agg(F.coalesce(20 * F.log10(F.greatest(voiced, F.lit(1e-10))), F.lit(-60.0)).alias("energy"))


def modulation(levels: DataFrame, rate: float, low: float, high: float, block: int) -> DataFrame:
    """``rec_id, share``: how much of the power in the spectrum of a recording's levels ``(rec_id, frame, rms)``, their mean
    taken off and cut into blocks of ``block`` frames, lies from ``low`` to ``high`` hertz; the last, incomplete block is
    left out, and without a whole one the share is 0. ``rate``: frames a second."""
    rows = levels.withColumn("rms", F.col("rms") - F.avg("rms").over(W.partitionBy("rec_id")))
    parts = rows.groupBy("rec_id", F.floor(F.col("frame") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", "rms"))).alias("x"))
    whole = parts.where(F.size("x") == block).select("rec_id", F.transform("x", lambda v: v["rms"]).alias("x"))
    spectra = transformed(whole, "x", "power", lambda x: np.abs(np.fft.rfft(x, axis=1)) ** 2)
    bins = spectra.select("rec_id", F.posexplode("power").alias("bin", "p"))
    f = F.col("bin") * (rate / block)
    a = bins.groupBy("rec_id").agg((F.sum(F.when((f >= low) & (f <= high), F.col("p")).otherwise(0.0)) / (F.sum("p") + EPS)).alias("share"))
    return levels.select("rec_id").distinct().join(a, "rec_id", "left").select("rec_id", F.coalesce("share", F.lit(0.0)).alias("share"))


def turns(cepstrum: DataFrame, window: int = 20, step: int = 10, keep: int = 13) -> DataFrame:
    """``rec_id, turns``: speaker changes by the Bayesian information criterion. Two neighbouring windows of frames are
    worse described by one normal distribution of independent coefficients than by two, by more than the penalty."""
    low, high = F.col("frame") - window, F.col("frame") + window - 1
    marks = cepstrum.select("rec_id", "frame", F.max("frame").over(W.partitionBy("rec_id")).alias("last")).where((F.col("frame") >= window) & (F.col("frame") % step == 0) & (high <= F.col("last")))
    rows = cepstrum.select("rec_id", "frame", F.posexplode("cepstrum").alias("k", "v")).where(F.col("k") < keep)
    order = W.partitionBy("rec_id", "k").orderBy("frame")
    spread = lambda a, b: F.var_pop("v").over(order.rowsBetween(a, b)) + 1e-6
    rows = rows.withColumn("left", spread(-window, -1)).withColumn("right", spread(0, window - 1)).withColumn("both", spread(-window, window - 1))
    gain = window * F.ln("both") - window / 2.0 * (F.ln("left") + F.ln("right"))
    scored = rows.join(marks.select("rec_id", "frame"), ["rec_id", "frame"], "left_semi").groupBy("rec_id", "frame").agg(F.sum(gain).alias("gain"))
    penalty = float(np.log(window) * keep)
    changes = scored.where(F.col("gain") > penalty).groupBy("rec_id").agg(F.count("*").alias("turns"))
    return cepstrum.select("rec_id").distinct().join(changes, "rec_id", "left").select("rec_id", F.coalesce("turns", F.lit(0).cast("long")).alias("turns"))
