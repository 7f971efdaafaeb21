"""What is said of a voice by its pitch, harmonicity and perturbation: prosody, tremor, breaks, quality, composite scores.

All but the tremor are aggregates and windows over rows of frames: ``pitches(rec_id, frame, FrameF0)`` with 0 where there is
no voice, ``levels(rec_id, frame, hnr)`` in decibels, null without a period, ``mask(rec_id, frame, speech)``. The tremor is
the spectrum of a recording's voiced pitches, which are one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import between, mean_bins
from .spectra import EPS, Signal, prediction_filters, total, transformed
from .voice import harmonic_share


def pitch_features(pitches: DataFrame, mask: DataFrame, s: Signal) -> DataFrame:
    """``rec_id, V_ArticulationRate, V_F0_Mean, V_F0_Std, V_F0_Range, V_F0_Max, V_F0_Slope, V_F0_Median, MDVP_DVB,
    UnvoicedFrameRatio, Tremor_CycleVariation, SpeechSeconds``: onsets of voice a second of speech; moments, range, median and
    rise a frame of the voiced pitches; ends of voice a voiced second; the share without voice; mean step of the periods over
    their mean. 0 without voiced frames."""
    order = W.partitionBy("rec_id").orderBy("frame")
    voiced = F.col("FrameF0") > 0
    rows = pitches.select("rec_id", "frame", F.when(voiced, F.col("FrameF0")).alias("f"), voiced.cast("int").alias("v"))
    rows = rows.withColumn("turn", F.col("v") - F.lag("v").over(order)).withColumn("i", F.sum("v").over(order))
    spoken = rows.where("v = 1").withColumn("step", F.abs(1 / F.col("f") - 1 / F.lag("f").over(order)))
    a = rows.groupBy("rec_id").agg(F.count("*").alias("n"), F.sum("v").alias("k"), F.count_if(F.col("turn") == 1).alias("on"), F.count_if(F.col("turn") == -1).alias("off"))
    b = spoken.groupBy("rec_id").agg(
        F.avg("f").alias("V_F0_Mean"), F.stddev_pop("f").alias("V_F0_Std"), (F.max("f") - F.min("f")).alias("V_F0_Range"), F.max("f").alias("V_F0_Max"), F.regr_slope("f", "i").alias("V_F0_Slope"),
        F.percentile("f", 0.5).alias("V_F0_Median"), (F.avg("step") / (F.avg(1 / F.col("f")) + EPS)).alias("Tremor_CycleVariation"),
    )
    m = mask.groupBy("rec_id").agg((F.count_if("speech") * s.hop / s.rate).alias("SpeechSeconds"))
    names = [c for c in b.columns if c != "rec_id"]
    joined = a.join(b, "rec_id", "left").join(m, "rec_id", "left").fillna(0.0, [*names, "SpeechSeconds"])
    return joined.select(
        "rec_id", (F.col("on") / (F.col("SpeechSeconds") + EPS)).alias("V_ArticulationRate"), *names,
        F.when(F.col("k") > 0, F.col("off") / (F.col("k") * s.hop / s.rate + EPS)).otherwise(0.0).alias("MDVP_DVB"), (1 - F.col("k") / F.col("n")).alias("UnvoicedFrameRatio"), "SpeechSeconds",
    )


def tremor_of(f: np.ndarray, rate: float, low: float = 3.0, high: float = 12.0, least: int = 20) -> tuple[float, float, float]:
    """Strongest frequency of the pitch's movement from ``low`` to ``high`` hertz, its share of all movement, and the movement's
    correlation with itself a period of it later; zeros for fewer than ``least`` pitches."""
    if len(f) < least:
        return 0.0, 0.0, 0.0
    moved = f - f.mean()
    size, hertz = np.abs(np.fft.rfft(moved)), np.fft.rfftfreq(len(f), 1 / rate)
    inside = np.flatnonzero((hertz >= low) & (hertz <= high))
    if not len(inside):
        return 0.0, 0.0, 0.0
    best = inside[size[inside].argmax()]
    lag = int(rate / hertz[best])
    again = float(moved[lag:] @ moved[:-lag] / (moved @ moved + EPS)) if 0 < lag < len(f) else 0.0
    return float(hertz[best]), float(size[best] ** 2 / (np.square(size).sum() + EPS)), max(0.0, again)


def tremor(pitches: DataFrame, rate: float) -> DataFrame:
    """``rec_id, Tremor_Freq, Tremor_Intensity, Tremor_Regularity`` by ``tremor_of`` the voiced pitches, ``rate`` frames a second."""
    held = pitches.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.when(F.col("FrameF0") > 0, F.struct("frame", "FrameF0")))).alias("f"))
    rows = held.select("rec_id", F.transform("f", lambda x: x["FrameF0"]).alias("f"))
    names = ["Tremor_Freq", "Tremor_Intensity", "Tremor_Regularity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([tremor_of(np.array(x.as_py(), float), rate) for x in batch.column("f")]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column("rec_id"), *(pa.array(found[:, k]) for k in range(3))], ["rec_id", *names])

    return rows.mapInArrow(run, T.StructType([pitches.schema["rec_id"], *(T.StructField(n, T.DoubleType()) for n in names)]))


def harmonic_levels(frames: DataFrame, silence: float = 0.1) -> DataFrame:
    """``rec_id, frame, hnr``: decibels of ``voice.harmonicity`` without its bounds, null where it has no period or is silent."""
    rows = transformed(frames.select("rec_id", "frame", "samples"), "samples", "found", harmonic_share).select("rec_id", "frame", F.get("found", 0).alias("share"), F.get("found", 1).alias("peak"))
    loud = F.col("peak") >= silence * F.max("peak").over(W.partitionBy("rec_id"))
    return rows.select("rec_id", "frame", F.when(loud & (F.col("share") > 0), 10 * F.log10(F.col("share") / F.greatest(1 - F.col("share"), F.lit(EPS)))).alias("hnr"))


def harmonic_features(levels: DataFrame) -> DataFrame:
    """``rec_id, CPP_Mean, CPP_Std, NHR, V_ModalProportion, V_BreathyProportion`` of ``levels``: mean and deviation, noise over
    harmonics at the mean, shares above 10 and below 5 dB; 0, 0, 1, 0.5 and 0.5 without a period."""
    x = F.col("hnr")
    share = lambda c: F.coalesce(F.avg(F.when(x.isNotNull(), c.cast("double"))), F.lit(0.5))
    a = levels.groupBy("rec_id").agg(F.avg(x).alias("m"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias("CPP_Std"), share(x > 10).alias("V_ModalProportion"), share(x < 5).alias("V_BreathyProportion"))
    return a.select("rec_id", F.coalesce("m", F.lit(0.0)).alias("CPP_Mean"), "CPP_Std", F.coalesce(F.pow(F.lit(10.0), -F.col("m") / 10), F.lit(1.0)).alias("NHR"), "V_ModalProportion", "V_BreathyProportion")


#: Ends of bands in hertz: turbulence above, soft phonation (low, middle, high), low over high, alpha (low, middle, high). Fixed values.
BANDS = {"turbulence": 4000.0, "soft": (70.0, 1600.0, 4500.0), "low_high": (1500.0, 5000.0), "alpha": (50.0, 1000.0, 5000.0)}


def band_features(frames: DataFrame, s: Signal, bands: dict = BANDS) -> DataFrame:
    """``rec_id, MDVP_VTI, MDVP_SPI, LowHigh, V_AlphaRatio, V_SpectralTilt`` of ``frames(rec_id, frame, power, speech)``: shares
    and ratios of bands of the mean spectrum, both ends included, and its slope in decibels a hertz."""
    f, p = F.col("hertz"), F.col("whole")
    part = lambda lo, hi: F.coalesce(F.sum(F.when((f >= lo) & (f <= hi), p)), F.lit(0.0))
    lo, mid, hi = bands["soft"]
    a0, a1, a2 = bands["alpha"]
    return mean_bins(frames, s).groupBy("rec_id").agg(
        (F.coalesce(F.sum(F.when(f > bands["turbulence"], p)), F.lit(0.0)) / (F.sum(p) + EPS)).alias("MDVP_VTI"), ((part(lo, mid) + EPS) / (part(mid, hi) + EPS)).alias("MDVP_SPI"),
        (part(0.0, bands["low_high"][0]) / (part(*bands["low_high"]) + EPS)).alias("LowHigh"), (10 * F.log10((part(a0, a1) + EPS) / (part(a1, a2) + EPS))).alias("V_AlphaRatio"),
        F.coalesce(F.regr_slope(10 * F.log10(p + EPS), f), F.lit(0.0)).alias("V_SpectralTilt"),
    )


def composites(features: DataFrame) -> DataFrame:
    """``rec_id, AVQI, DSI, CSID`` of ``features(rec_id, CPP_Mean, Jitter, Shimmer, V_F0_Max, SpeechSeconds, LowHigh)``: linear
    composites with fixed weights, the first within 0..10, the second within -5..15."""
    c, j, s = F.col("CPP_Mean"), F.col("Jitter") * 100, F.col("Shimmer")
    return features.select(
        "rec_id", between(4.152 - 0.177 * c - 0.006 * c - 0.037 * s, 0, 10).alias("AVQI"), between(0.13 * F.col("SpeechSeconds") + 0.0053 * F.col("V_F0_Max") - 0.26 * j - 1.18 * s + 12.2, -5, 15).alias("DSI"),
        (0.5 * c + 0.3 * F.log10(F.col("LowHigh") + EPS) - 0.2 * j).alias("CSID"),
    )


def source_shape(frames: DataFrame, pitches: DataFrame, s: Signal, order: int = 14, least: float = 60.0) -> DataFrame:
    """``rec_id, V_OQ, V_CQ, V_SQ, V_Rd, V_Ra, V_Rk`` of the speech frames ``frames(rec_id, frame, samples)``: over the first
    period of each frame's flow (of the mean pitch, 150 Hz where that is below ``least``) the share above 0, the rest, and the
    time up to the peak over the time from it, within 0..5; 0.5, 0.5 and 1 without frames as long as a period."""
    f = F.when(F.col("FrameF0") > 0, F.col("FrameF0"))
    mean = F.coalesce(F.avg(f), F.lit(0.0))
    period = pitches.groupBy("rec_id").agg(F.floor(s.rate / F.when(mean < least, 150.0).otherwise(mean)).cast("int").alias("period"))

    def flows(x: np.ndarray) -> np.ndarray:
        a = prediction_filters(x * np.hamming(x.shape[1]), order)
        return np.cumsum(sum(a[:, j, None] * np.pad(x, ((0, 0), (j, 0)))[:, : x.shape[1]] for j in range(order + 1)), axis=1)

    rows = transformed(frames.select("rec_id", "frame", "samples"), "samples", "flow", flows).join(period, "rec_id").where(F.size("flow") >= F.col("period"))
    rows = rows.select("rec_id", "period", F.slice("flow", F.lit(1), F.col("period")).alias("x")).withColumn("size", F.transform("x", F.abs))
    at = F.array_position("size", F.array_max("size")) - 1
    open_ = total(F.col("x"), lambda v, i: F.when(v > 0, 1.0).otherwise(0.0)) / (F.col("period") + EPS)
    a = rows.select("rec_id", open_.alias("oq"), F.when((at > 0) & (at < F.col("period") - 1), at / (F.col("period") - at + EPS)).alias("sq")).groupBy("rec_id").agg(F.avg("oq").alias("oq"), F.avg("sq").alias("sq"))
    a = period.select("rec_id").join(a, "rec_id", "left")
    oq, sq = F.coalesce("oq", F.lit(0.5)), F.coalesce(between(F.col("sq"), 0, 5), F.lit(1.0))
    return a.select("rec_id", oq.alias("V_OQ"), (1 - oq).alias("V_CQ"), sq.alias("V_SQ"), (0.5 + oq).alias("V_Rd"), oq.alias("V_Ra"), sq.alias("V_Rk"))
