"""Whole-recording measures of noise, channel, distortion, spectra and the voice's harmonics.

Everything here is an aggregate over rows of a recording's bins, frames or levels. ``frames`` are ``(rec_id, frame, power
array, speech)``, ``levels`` are ``(rec_id, frame, rms, speech)``; what averages over speech takes all frames of a
recording without any.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import runs
from .spectra import EPS, Signal, cosine_basis, decibels, mel_filters, prediction_filters, spectral_measures, total, transformed


def over_speech(x: Column, f=F.avg) -> Column:
    """``f`` of ``x`` in the speech frames, or in all where there are none."""
    return F.coalesce(f(F.when(F.col("speech"), x)), f(x))


def between(x: Column, low: float, high: float) -> Column:
    """``x`` within both bounds; null stays null, which ``greatest`` alone would pass over."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def log_ratio(a: Column, b: Column) -> Column:
    return 10 * F.log10(a / b + EPS)


def bins_of(frames: DataFrame, s: Signal) -> DataFrame:
    """``rec_id, frame, speech, bin, hertz, p``."""
    return frames.select("rec_id", "frame", "speech", F.posexplode("power").alias("bin", "p")).withColumn("hertz", F.col("bin") * s.step)


def mean_bins(frames: DataFrame, s: Signal) -> DataFrame:
    """``rec_id, bin, hertz, voice, noise, whole, varies``: mean power of a bin in speech frames, in the others (null where
    there are none) and in all, and its variance over them."""
    rows = bins_of(frames, s).groupBy("rec_id", "bin", "hertz")
    return rows.agg(F.avg(F.when(F.col("speech"), F.col("p"))).alias("voice"), F.avg(F.when(~F.col("speech"), F.col("p"))).alias("noise"), F.avg("p").alias("whole"), F.var_pop("p").alias("varies"))


def spectral_quality(frames: DataFrame, s: Signal, split: float = 1000.0) -> DataFrame:
    """``rec_id, LTAS_Slope, LTAS_Tilt, SpectralFluxMean, SpectralFluxStd, SpectralRolloff, SpectralEntropy, SpectralSkewness,
    SpectralKurtosis, SpectralCrest, SpectralCentroid``: the long-term spectrum's slope in decibels a hertz, its decibels
    below ``split`` over those above, its moments and crest; and means over frames. A first frame has no flux."""
    rows = mean_bins(frames, s).withColumn("p", F.coalesce("voice", "whole"))
    whole = W.partitionBy("rec_id")
    rows = rows.withColumn("share", F.col("p") / (F.sum("p").over(whole) + EPS)).withColumn("mid", F.sum(F.col("share") * F.col("hertz")).over(whole))
    rows = rows.withColumn("wide", F.sqrt(F.sum(F.col("share") * F.pow(F.col("hertz") - F.col("mid"), F.lit(2.0))).over(whole) + EPS))
    moment = lambda k: F.sum(F.col("share") * F.pow((F.col("hertz") - F.col("mid")) / F.col("wide"), F.lit(float(k))))
    below = lambda x: F.coalesce(F.sum(F.when(x, F.col("p"))), F.lit(0.0)) + EPS
    long = rows.groupBy("rec_id").agg(
        F.coalesce(F.regr_slope(10 * F.log10(F.col("p") + EPS), "hertz"), F.lit(0.0)).alias("LTAS_Slope"), (10 * F.log10(below(F.col("hertz") < split) / below(F.col("hertz") >= split))).alias("LTAS_Tilt"),
        moment(3).alias("SpectralSkewness"), (moment(4) - 3).alias("SpectralKurtosis"), (F.max("p") / (F.avg("p") + EPS)).alias("SpectralCrest"),
    )
    m = spectral_measures(frames, s)
    # a frame's measures have 6 places, as SQL gives them to the means
    m = m.select("rec_id", "frame", "FrameSR", *[F.round(c, 6).alias(c) for c in ("FrameSFlux", "FrameSE", "Centroid")]).join(frames.select("rec_id", "frame", "speech"), ["rec_id", "frame"])
    first = F.col("frame") == F.min("frame").over(whole)
    m = m.withColumn("flux", F.when(~first, F.col("FrameSFlux")))
    none = F.lit(0.0)
    short = m.groupBy("rec_id").agg(
        F.coalesce(over_speech(F.col("flux")), none).alias("SpectralFluxMean"), F.coalesce(over_speech(F.col("flux"), F.stddev_pop), none).alias("SpectralFluxStd"),
        over_speech(F.col("FrameSR")).alias("SpectralRolloff"), over_speech(F.col("FrameSE")).alias("SpectralEntropy"), over_speech(F.col("Centroid")).alias("SpectralCentroid"),
    )
    return long.join(short, "rec_id")


def noise(levels: DataFrame) -> DataFrame:
    """``rec_id, SegmentalSNR, NoiseFloorLevel, NoiseStationarity`` of ``levels``: mean decibels of speech frames over the
    mean noise power, decibels of the noise, its deviation over its mean; frames without speech are the noise."""
    n = F.when(~F.col("speech"), F.col("rms"))
    a = levels.groupBy("rec_id").agg(
        F.coalesce(F.avg(n * n), F.lit(EPS * EPS)).alias("power"), F.coalesce(F.avg(n), F.lit(EPS)).alias("mean"), F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("sd"),
    )
    rows = levels.join(a, "rec_id").withColumn("snr", F.when(F.col("speech"), log_ratio(F.col("rms") * F.col("rms"), F.col("power") + EPS)))
    found = rows.groupBy("rec_id").agg(F.coalesce(F.avg("snr"), F.lit(0.0)).alias("SegmentalSNR"))
    return found.join(a, "rec_id").select("rec_id", "SegmentalSNR", (20 * F.log10(F.col("mean") + EPS)).alias("NoiseFloorLevel"), (F.col("sd") / (F.col("mean") + EPS)).alias("NoiseStationarity"))


def amplitude_ratio(frames: DataFrame) -> DataFrame:
    """``rec_id, WADA_SNR`` of ``frames(rec_id, frame, samples, speech)``: decibels of the deviation of samples in speech
    frames over that in the others, within -10..60, and 40 without any of these; samples count once a frame."""
    sums = frames.select("rec_id", "speech", F.size("samples").alias("n"), total(F.col("samples")).alias("x"), total(F.col("samples"), lambda v, i: v * v).alias("xx"))
    some = lambda c, k: F.sum(F.when(F.col("speech") == k, F.col(c)))
    sd = lambda k: F.sqrt(F.greatest(some("xx", k) / some("n", k) - F.pow(some("x", k) / some("n", k), F.lit(2.0)), F.lit(0.0)))
    a = sums.groupBy("rec_id").agg(F.coalesce(sd(True), F.lit(0.0)).alias("voice"), sd(False).alias("rest"))
    return a.select("rec_id", between(F.when(F.col("rest") > EPS, 20 * F.log10(F.col("voice") / (F.col("rest") + EPS) + EPS)).otherwise(40.0), -10, 60).alias("WADA_SNR"))


#: Bands of speech in hertz with their importance. Fixed values.
SII = [(250.0, 500.0, 0.12), (500.0, 1000.0, 0.20), (1000.0, 2000.0, 0.30), (2000.0, 4000.0, 0.38)]
HUM = (50.0, 60.0, 100.0, 120.0)


def noise_spectra(frames: DataFrame, s: Signal, bands: list[tuple[float, float, float]] = SII, hum: tuple[float, ...] = HUM) -> DataFrame:
    """``rec_id, NoiseBandwidth, FrequencyWeightedSNR, SII_Estimate, PowerLineHum, MusicalNoiseLevel`` of ``frames``.

    The band of 95 % of the noise, decibels of speech over noise with an A-like weight within -10..60 (30 where one of them is
    missing), the importance-weighted decibels of ``bands`` from -15..15 to 0..1, the mean power at ``hum`` over three bins on
    either side, and the share of bins that vary less than a tenth of the median of variance over mean."""
    rows = mean_bins(frames, s)
    whole = W.partitionBy("rec_id")
    rows = rows.withColumn("run", F.sum("noise").over(whole.orderBy("bin"))).withColumn("all", F.sum("noise").over(whole) + EPS)
    f2 = F.col("hertz") * F.col("hertz")
    rows = rows.withColumn("w", f2 / (f2 + 20.6**2 + EPS) * f2 / (f2 + 12194.0**2 + EPS))
    rows = rows.withColumn("w", F.col("w") / (F.max("w").over(whole) + EPS)).withColumn("ratio", F.col("varies") / (F.col("whole") + EPS))
    near = whole.orderBy("bin")
    around = [F.lag("whole", k).over(near) for k in (1, 2, 3)] + [F.lead("whole", k).over(near) for k in (1, 2, 3)]
    seen, heard = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in around), F.lit(0)), sum((F.coalesce(c, F.lit(0.0)) for c in around), F.lit(0.0))
    rows = rows.withColumn("local", F.try_divide(heard, seen) + EPS)
    at = [min(int(np.ceil(h / s.step - 0.5)), s.bins - 1) for h in hum]
    weighted = lambda c: F.sum(F.col("w") * F.col(c))
    snr = F.when(F.count("voice") * F.count("noise") > 0, log_ratio(weighted("voice"), weighted("noise") + EPS)).otherwise(30.0)
    part = lambda c, lo, hi: F.coalesce(F.avg(F.when((F.col("hertz") >= lo) & (F.col("hertz") < hi), F.col(c))), F.lit(EPS))
    inside = [(lo, hi, w) for lo, hi, w in bands if any(lo <= k * s.step < hi for k in range(s.bins))]
    sii = sum((w * (between(log_ratio(part("voice", lo, hi), part("noise", lo, hi) + EPS), -15, 15) + 15) / 30 for lo, hi, w in inside), F.lit(0.0))
    median = rows.groupBy("rec_id").agg(F.percentile("ratio", 0.5).alias("median"))  # of a recording's bins
    a = rows.join(median, "rec_id").groupBy("rec_id").agg(
        F.coalesce(F.least(F.min(F.when(F.col("run") >= 0.95 * F.col("all"), F.col("hertz"))), F.lit(s.rate / 2)), F.lit(s.rate / 2)).alias("NoiseBandwidth"), between(snr, -10, 60).alias("FrequencyWeightedSNR"), between(sii, 0, 1).alias("SII_Estimate"),
        (sum((F.max(F.when(F.col("bin") == k, F.col("whole") / F.col("local"))) for k in at), F.lit(0.0)) / len(at)).alias("PowerLineHum"),
        F.avg(F.when((F.col("median") > 0) & (F.col("ratio") < 0.1 * F.col("median")), 1.0).otherwise(0.0)).alias("MusicalNoiseLevel"),
    )
    return a


def gain_drift(levels: DataFrame, width: int = 50) -> DataFrame:
    """``rec_id, AGC_Activity`` of ``levels``: deviation over mean of the running mean of ``width`` levels, or of half as many
    as there are where this is less; 0 for ten levels or fewer."""
    order, whole = W.partitionBy("rec_id").orderBy("frame"), W.partitionBy("rec_id")
    rows = levels.select("rec_id", F.row_number().over(order).alias("r"), F.sum("rms").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("run"), F.count("*").over(whole).alias("n"))
    rows = rows.withColumn("k", F.least(F.lit(width), F.floor(F.col("n") / 2)).cast("int"))
    earlier = rows.select(F.col("rec_id").alias("e_rec"), (F.col("r") + F.col("k")).alias("e_r"), F.col("run").alias("e_run"))
    means = rows.join(earlier, (F.col("rec_id") == F.col("e_rec")) & (F.col("r") == F.col("e_r")), "left")
    mean = F.when((F.col("r") >= F.col("k")) & (F.col("k") > 1), (F.col("run") - F.coalesce("e_run", F.lit(0.0))) / F.col("k"))
    a = means.withColumn("mean", mean).groupBy("rec_id").agg(F.max("n").alias("n"), F.stddev_pop("mean").alias("sd"), F.avg("mean").alias("m"))
    return a.select("rec_id", F.when(F.col("n") > 10, F.coalesce(F.col("sd") / (F.col("m") + EPS), F.lit(0.0))).otherwise(0.0).alias("AGC_Activity"))


def sample_distortion(recordings: DataFrame, near: float = 0.95) -> DataFrame:
    """``rec_id, SaturationRatio, QuantizationNoise`` of ``recordings(rec_id, samples)``: the share of samples above ``near``,
    and one less the share of distinct steps between neighbours, in millionths, among all of them or 65,536."""
    x, n = F.col("samples"), F.size("samples")
    steps = F.zip_with(F.slice(x, 2, F.greatest(n - 1, F.lit(0))), F.slice(x, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: F.round((a - b) * 1e6).cast("long"))
    kinds = F.size(F.array_distinct(steps))
    share = F.when(n > 1, F.greatest(1 - kinds / F.least(n - 1, F.lit(65536)), F.lit(0.0))).otherwise(0.0)
    return recordings.where(n > 0).select("rec_id", (total(x, lambda v, i: F.when(F.abs(v) > near, 1.0).otherwise(0.0)) / n).alias("SaturationRatio"), share.alias("QuantizationNoise"))


def onset_strength(frames: DataFrame, s: Signal, bands: int = 128, low: float = 0.0, high: float | None = None) -> DataFrame:
    """``rec_id, OnsetStrengthMean, OnsetStrengthStd`` of ``frames``: over frames, the mean rise of the mel bands in decibels
    since the frame before, at most 80 dB below the recording's loudest; 0 for the first."""
    filters = mel_filters(s, bands, low, high or s.rate / 2)
    rows = transformed(frames.select("rec_id", "frame", "power"), "power", "mel", lambda p: p @ filters.T).select("rec_id", "frame", F.transform("mel", decibels).alias("db"))
    rows = rows.withColumn("floor", F.max(F.array_max("db")).over(W.partitionBy("rec_id")) - 80).select("rec_id", "frame", F.transform("db", lambda v: F.greatest(v, F.col("floor"))).alias("db"))
    rows = rows.withColumn("old", F.lag("db").over(W.partitionBy("rec_id").orderBy("frame")))
    rise = F.coalesce(total(F.zip_with("db", "old", lambda a, b: F.greatest(a - b, F.lit(0.0)))) / bands, F.lit(0.0))
    return rows.select("rec_id", rise.alias("x")).groupBy("rec_id").agg(F.avg("x").alias("OnsetStrengthMean"), F.stddev_pop("x").alias("OnsetStrengthStd"))


def modulation_ratio(levels: DataFrame, rate: float, block: int, voice: tuple[float, float] = (2.0, 8.0), room: tuple[float, float] = (0.5, 2.0)) -> DataFrame:
    """``rec_id, SRMR, ModulationSpectrumArea``: power of the levels' modulation spectrum from ``voice`` over that from ``room``
    (its upper end excluded), and over all of it. Levels without their mean are cut into blocks, ``rate`` frames a second;
    without a whole block they are 1 and 0."""
    rows = levels.select("rec_id", "frame", (F.col("rms") - F.avg("rms").over(W.partitionBy("rec_id"))).alias("x"))
    parts = rows.groupBy("rec_id", F.floor(F.col("frame") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", "x"))).alias("x"))
    parts = parts.where(F.size("x") == block).select("rec_id", F.transform("x", lambda v: v["x"]).alias("x"))
    bins = transformed(parts, "x", "power", lambda x: np.abs(np.fft.rfft(x, axis=1)) ** 2).select("rec_id", F.posexplode("power").alias("bin", "p")).withColumn("f", F.col("bin") * (rate / block))
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("p"))), F.lit(0.0))
    f = F.col("f")
    heard = some((f >= voice[0]) & (f <= voice[1]))
    a = bins.groupBy("rec_id").agg(((heard + EPS) / (some((f >= room[0]) & (f < room[1])) + EPS)).alias("SRMR"), (heard / (F.sum("p") + EPS)).alias("ModulationSpectrumArea"))
    return levels.select("rec_id").distinct().join(a, "rec_id", "left").fillna({"SRMR": 1.0, "ModulationSpectrumArea": 0.0})


# --- the voice's harmonics


def harmonics(frames: DataFrame, pitches: DataFrame, s: Signal, lowest: float = 60.0) -> DataFrame:
    """``rec_id, H1H2, HRF, PSP`` of ``frames`` at multiples of the pitch (``pitches(rec_id, frame, FrameF0)``) of ``lowest`` or
    more: decibels of the first harmonic over the second, power of the second to ninth over the first, and of even over odd
    ones, up to half the rate and within 0..100, as means over frames; 0 without such frames."""
    rows = frames.join(pitches.where(F.col("FrameF0") >= lowest), ["rec_id", "frame"])
    f0 = F.col("FrameF0")
    nearest = lambda h: F.least(F.ceil(h * f0 / s.step - 0.5), F.lit(s.bins - 1)).cast("int")
    power = lambda h: F.get("power", nearest(h))
    heard = lambda h: F.when(h * f0 <= s.rate / 2, power(h)).otherwise(0.0)
    add = lambda hs: sum((heard(h) for h in hs), F.lit(0.0))
    rows = rows.select(
        "rec_id", (10 * F.log10(power(1) + EPS) - 10 * F.log10(power(2) + EPS)).alias("h"), between(add(range(2, 10)) / (power(1) + EPS), 0, 100).alias("rich"),
        between(add(range(2, 10, 2)) / (add(range(1, 10, 2)) + EPS), 0, 100).alias("even"),
    )
    a = rows.groupBy("rec_id").agg(F.avg("h").alias("H1H2"), F.avg("rich").alias("HRF"), F.avg("even").alias("PSP"))
    return frames.select("rec_id").distinct().join(a, "rec_id", "left").fillna(0.0, ["H1H2", "HRF", "PSP"])


def flow(x: np.ndarray, order: int = 14) -> np.ndarray:
    """Of each row: the glottal flow's peak over that of its derivative, and how many samples are above half the peak. The
    derivative is what linear prediction leaves of the row, the flow its sum."""
    filters = prediction_filters(x * np.hamming(x.shape[1]), order)
    left = sum(filters[:, j, None] * np.pad(x, ((0, 0), (j, 0)))[:, : x.shape[1]] for j in range(order + 1))
    run = np.abs(np.cumsum(left, axis=1))
    peak = run.max(axis=1) + EPS
    return np.stack([peak / (np.abs(left).max(axis=1) + EPS), (run > 0.5 * peak[:, None]).sum(axis=1)], axis=1)


def glottal_source(frames: DataFrame, pitches: DataFrame, s: Signal, order: int = 14) -> DataFrame:
    """``rec_id, NAQ, QOQ, GCI_Rate, GOI_Regularity`` of the speech frames ``frames(rec_id, frame, samples)`` and all
    ``pitches(rec_id, frame, FrameF0)``: amplitude quotient and open quotient of the flow in periods of the mean pitch
    (150 Hz without any), closures a second where over 0.1 s are voiced, and deviation over mean of the periods."""
    f = F.when(F.col("FrameF0") > 0, F.col("FrameF0"))
    p = pitches.groupBy("rec_id").agg(F.coalesce(F.avg(f), F.lit(150.0)).alias("mean"), F.count(f).alias("n"), F.avg(1 / f).alias("period"), F.stddev_pop(1 / f).alias("sd"))
    rows = transformed(frames.select("rec_id", "frame", "samples"), "samples", "flow", lambda x: flow(x, order))
    a = rows.groupBy("rec_id").agg(F.avg(F.get("flow", 0)).alias("amplitude"), F.avg(F.get("flow", 1)).alias("open"))
    length = s.rate / F.col("mean")
    return p.join(a, "rec_id", "left").select(
        "rec_id", F.coalesce(F.col("amplitude") / length, F.lit(0.0)).alias("NAQ"), F.coalesce(between(F.col("open") / F.floor(length), 0, 1), F.lit(0.5)).alias("QOQ"),
        F.when(F.col("n") * s.hop / s.rate > 0.1, F.col("mean")).otherwise(0.0).alias("GCI_Rate"), F.when(F.col("n") > 2, F.col("sd") / F.col("period")).otherwise(0.0).alias("GOI_Regularity"),
    )


# --- group delay


def group_delay(x: np.ndarray, keep: int = 12, gamma: float = 0.9, alpha: float = 0.4) -> np.ndarray:
    """Modified group delay of each row: the delay from the transforms of x and n x, over the cepstrally smoothed spectrum to
    the power of 2 ``gamma``, compressed by ``alpha`` with its sign kept. ``keep``: cepstral coefficients of the smoothing."""
    n = x.shape[1]
    a, b = np.fft.rfft(x, axis=1), np.fft.rfft(x * np.arange(n), axis=1)
    cepstrum = np.fft.irfft(np.log(np.abs(a) + EPS), n, axis=1)
    cepstrum[:, keep : n - keep + 1] = 0
    smooth = np.exp(np.fft.rfft(cepstrum, axis=1).real)
    delay = (a.real * b.real + a.imag * b.imag) / (smooth ** (2 * gamma) + EPS)
    return np.sign(delay) * np.abs(delay) ** alpha


def phase_step(x: np.ndarray) -> np.ndarray:
    """Fall of the phase of each row's spectrum from a bin to the next, the phase in -pi..pi."""
    return -np.diff(np.angle(np.fft.rfft(x, axis=1)), axis=1)


def delay_cepstra(frames: DataFrame, s: Signal, keep: int = 13, modified: bool = False) -> DataFrame:
    """``rec_id, V_MGDCC_1..keep``: cosine transform of the mean of ``phase_step``, or of ``group_delay``, of the Hann-windowed
    speech frames ``frames(rec_id, frame, samples, speech)``, of all where there is no speech."""
    from .spectra import periodic_hann

    of = group_delay if modified else phase_step
    rows = transformed(frames.select("rec_id", "frame", "speech", "samples"), "samples", "d", lambda x: of(x * periodic_hann(s.size)))
    mean = rows.select("rec_id", "speech", F.posexplode("d").alias("bin", "v")).groupBy("rec_id", "bin").agg(over_speech(F.col("v")).alias("v"))
    whole = mean.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda p: p["v"]).alias("d"))
    basis = cosine_basis(min(keep, s.bins - (not modified)), s.bins - (not modified))
    out = transformed(whole, "d", "c", lambda d: d @ basis.T)
    return out.select("rec_id", *[F.coalesce(F.get("c", k), F.lit(0.0)).alias(f"V_MGDCC_{k + 1}") for k in range(keep)])


def cepstral_means(cepstra: DataFrame, keep: int = 14) -> DataFrame:
    """``rec_id`` and means and deviations of the cepstra in the speech frames of ``(rec_id, frame, cepstrum, speech)``:
    ``V_MFCC_Mean_1.., V_MFCC_Std_1..``, and of the energies of all coefficients but the first, in frames: ``V_LTFD_Flatness``
    (of the means), ``V_LTFD_Entropy``, ``V_LTFD_Kurtosis``, ``V_LTFD_Range``; these are 0 below three frames."""
    one = lambda k: F.get("cepstrum", k)
    energy = total(F.slice("cepstrum", 2, keep - 1), lambda v, i: v * v)
    rows = cepstra.withColumn("any", F.max("speech").over(W.partitionBy("rec_id"))).where(F.col("speech") | ~F.col("any")).withColumn("e", energy)
    rows = rows.withColumn("share", F.col("e") / (F.sum("e").over(W.partitionBy("rec_id")) + EPS))
    a = rows.groupBy("rec_id").agg(
        F.count("*").alias("n"), *[F.avg(one(k)).alias(f"V_MFCC_Mean_{k + 1}") for k in range(keep)], *[F.stddev_pop(one(k)).alias(f"V_MFCC_Std_{k + 1}") for k in range(keep)],
        (-F.sum(F.col("share") * F.ln(F.col("share") + EPS))).alias("ent"), F.coalesce(F.kurtosis("e"), F.lit(0.0)).alias("kurt"), (F.max("e") - F.min("e")).alias("range"),
    )
    sizes = [F.abs(F.col(f"V_MFCC_Mean_{k + 1}")) for k in range(1, keep)]
    flat = F.exp(sum((F.ln(v + EPS) for v in sizes), F.lit(0.0)) / len(sizes)) / (sum(sizes, F.lit(0.0)) / len(sizes) + EPS)
    some = lambda c: F.when(F.col("n") > 2, c).otherwise(0.0)
    names = [f"V_MFCC_{m}_{k + 1}" for m in ("Mean", "Std") for k in range(keep)]
    return a.select("rec_id", *names, some(flat).alias("V_LTFD_Flatness"), some(F.col("ent")).alias("V_LTFD_Entropy"), some(F.col("kurt")).alias("V_LTFD_Kurtosis"), some(F.col("range")).alias("V_LTFD_Range"))


# --- long-term distribution

LTAS = [(0.0, 500.0), (500.0, 1000.0), (1000.0, 2000.0), (2000.0, 4000.0), (4000.0, 8000.0)]


def long_term(frames: DataFrame, s: Signal, bands: list[tuple[float, float]] = LTAS) -> DataFrame:
    """``rec_id, V_LTAS_1..5, V_LTAS_LowMidRatio, V_LTAS_MidHighRatio, V_SpectralCentroid_Mean, V_SpectralCentroid_Std,
    V_SpectralBW_Mean, V_SpectralEntropy_Mean, V_SpectralEntropy_Std`` of ``frames``: mean decibels of the speech spectrum by
    band (-60 for a band without bins) and differences of the first, third and fifth; moments over speech frames of the
    power's centroid, of its width about the recording's mean centroid, and of its entropy."""
    p = F.col("power")
    rows = frames.select("rec_id", "frame", "speech", "power", (total(p) + EPS).alias("sum"), total(p, lambda v, i: v * (i * s.step)).alias("moment"), total(p, lambda v, i: v * F.pow(i * s.step, F.lit(2.0))).alias("square"))
    rows = rows.withColumn("centre", F.col("moment") / F.col("sum"))
    rows = rows.withColumn("entropy", -total(F.transform("power", lambda v: v / F.col("sum") * F.ln(v / F.col("sum") + EPS))) / float(np.log(s.bins)))
    whole = W.partitionBy("rec_id")
    rows = rows.withColumn("mean", F.coalesce(F.avg(F.when(F.col("speech"), F.col("centre"))).over(whole), F.avg("centre").over(whole)))
    # the sum of p (f - mean)^2, from sums that do not know the mean
    width = F.sqrt(F.greatest(F.col("square") - 2 * F.col("mean") * F.col("moment") + F.pow("mean", F.lit(2.0)) * (F.col("sum") - EPS), F.lit(0.0)) / F.col("sum"))
    short = rows.withColumn("width", width).groupBy("rec_id").agg(
        over_speech(F.col("centre")).alias("V_SpectralCentroid_Mean"), over_speech(F.col("centre"), F.stddev_pop).alias("V_SpectralCentroid_Std"), over_speech(F.col("width")).alias("V_SpectralBW_Mean"),
        over_speech(F.col("entropy")).alias("V_SpectralEntropy_Mean"), over_speech(F.col("entropy"), F.stddev_pop).alias("V_SpectralEntropy_Std"),
    )
    db = 10 * F.log10(F.coalesce("voice", "whole") + EPS)
    level = [F.coalesce(F.avg(F.when((F.col("hertz") >= lo) & (F.col("hertz") < hi), db)), F.lit(-60.0)).alias(f"V_LTAS_{k}") for k, (lo, hi) in enumerate(bands, 1)]
    long = mean_bins(frames, s).groupBy("rec_id").agg(*level)
    long = long.withColumn("V_LTAS_LowMidRatio", F.col("V_LTAS_1") - F.col("V_LTAS_3")).withColumn("V_LTAS_MidHighRatio", F.col("V_LTAS_3") - F.col("V_LTAS_5"))
    return long.join(short, "rec_id")


def rhythm_features(mask: DataFrame, seconds: float) -> DataFrame:
    """``rec_id, V_Rhythm_nPVI, V_Rhythm_VoicedPct, V_Rhythm_SpeechSegVar, V_Rhythm_SilenceSegVar, V_Rhythm_SpeechSilenceRatio`` of
    ``mask(rec_id, frame, speech)``, ``seconds`` a frame: mean difference of neighbouring speech runs over their mean, share of
    speech, deviations of both kinds of runs, and speech over silence up to 1000."""
    r = runs(mask, "speech").withColumn("sec", F.col("length") * seconds)
    near = F.lag("sec").over(W.partitionBy("rec_id", "speech").orderBy("first"))
    r = r.withColumn("step", F.when(F.col("speech"), F.abs(F.col("sec") - near)))
    of = lambda k: F.when(F.col("speech") == k, F.col("sec"))
    none = F.lit(0.0)
    length = lambda k: F.coalesce(F.sum(of(k)), none)
    return r.groupBy("rec_id").agg(
        F.coalesce(F.avg("step") / (F.avg(of(True)) + EPS), none).alias("V_Rhythm_nPVI"), (length(True) / F.sum("sec")).alias("V_Rhythm_VoicedPct"), F.coalesce(F.stddev_pop(of(True)), none).alias("V_Rhythm_SpeechSegVar"),
        F.coalesce(F.stddev_pop(of(False)), none).alias("V_Rhythm_SilenceSegVar"), between(length(True) / (length(False) + EPS), 0, 1000).alias("V_Rhythm_SpeechSilenceRatio"),
    )
