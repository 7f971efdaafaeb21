"""Voice activity and temporal features over frame rows ``(rec_id, frame, ...)``.

A recording's frames are ordered within it by windows partitioned by recording, so recordings of any number spread
evenly; runs of speech are gaps-and-islands groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.semantics import ratio

FRAME, HOP = 512, 160
FLOOR_DB, UNDER_PEAK = -60.0, 40.0


def frame_count(samples: Column) -> Column:
    """V1: frames of 512 samples every 160; none for fewer than 512."""
    return F.when(samples < FRAME, 0).otherwise(1 + F.floor((samples - FRAME) / HOP)).cast("int")


def energy_gate(frames: DataFrame, rms: str) -> DataFrame:
    """V2: frames above both -60 dB and 40 dB under the recording's peak."""
    db = 20 * F.log10(F.greatest(F.col(rms), F.lit(1e-10)))
    rows = frames.withColumn("db", db)
    gate = F.greatest(F.max("db").over(W.partitionBy("rec_id")) - UNDER_PEAK, F.lit(FLOOR_DB))
    return rows.withColumn("speech", F.col("db") > gate).drop("db")


def median_mask(frames: DataFrame, half: int = 5) -> DataFrame:
    """Centred median of 2 * half + 1 mask values; beyond its ends the mask is mirrored, edge frame included.

    A binary median is a majority: a frame's own window is a running sum, frames near an edge count the mirrored ones a
    second time.
    """
    order, whole = W.partitionBy("rec_id").orderBy("frame"), W.partitionBy("rec_id")
    x = F.col("speech").cast("int")
    rows = frames.withColumn("r", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(whole))
    own = F.sum(x).over(order.rowsBetween(-half, half))
    # mirrored positions -1-k at the start are frames k = 0..half-1-r, and likewise at the end
    ups = [F.sum(F.when(F.col("r") <= k, x)).over(whole) for k in range(half)]
    downs = [F.sum(F.when(F.col("n") - 1 - F.col("r") <= k, x)).over(whole) for k in range(half)]
    left, right = F.lit(0), F.lit(0)
    for k in range(half):
        left = F.when(F.col("r") == half - 1 - k, F.coalesce(ups[k], F.lit(0))).otherwise(left)
        right = F.when(F.col("n") - 1 - F.col("r") == half - 1 - k, F.coalesce(downs[k], F.lit(0))).otherwise(right)
    return rows.withColumn("smooth", own + left + right >= half + 1).drop("r", "n")


def runs(frames: DataFrame, mask: str) -> DataFrame:
    """``rec_id, speech, first, length`` of each run of equal mask values."""
    order = W.partitionBy("rec_id").orderBy("frame")
    rows = frames.withColumn("g", F.row_number().over(order) - F.row_number().over(W.partitionBy("rec_id", mask).orderBy("frame")))
    return rows.groupBy("rec_id", F.col(mask).alias("speech"), "g").agg(F.min("frame").alias("first"), F.count("*").alias("length")).drop("g")


def durations(frames: DataFrame, mask: str, rate: int = 16000) -> DataFrame:
    """Total and speech seconds, their ratio, frame counts."""
    n, s = F.count("*"), F.sum(F.col(mask).cast("int"))
    return frames.groupBy("rec_id").agg((n * HOP / rate).alias("total_duration_sec"), (s * HOP / rate).alias("speech_duration_sec"), ratio(s, n).alias("speech_ratio"), n.cast("int").alias("n_frames"), s.cast("int").alias("n_speech_frames"))


def duration_problems(d: DataFrame) -> DataFrame:
    """V7: rows whose durations contradict each other, with what is wrong."""
    t, s, r = F.col("total_duration_sec"), F.col("speech_duration_sec"), F.col("speech_ratio")
    found = F.array_compact(
        F.array(F.when(t.isNull() | s.isNull() | F.isnan(t) | F.isnan(s), "missing"), F.when((t < 0) | (s < 0), "negative"), F.when(r > 1.0001, "ratio"), F.when(s > t + 0.001, "longer"))
    )
    return d.withColumn("problems", found).where(F.size("problems") > 0)


def pauses(frames: DataFrame, mask: str, rate: int = 16000) -> DataFrame:
    """Temporal dynamics: mean and longest pause, pauses per second, mean speech segment, all in seconds.

    Pauses are silent runs between speech; leading and trailing silence is none.
    """
    r = runs(frames, mask)
    inside = F.coalesce(F.lag("length").over(W.partitionBy("rec_id").orderBy("first")), F.lit(0)) > 0
    later = F.lead("length").over(W.partitionBy("rec_id").orderBy("first")).isNotNull()
    r = r.withColumn("pause", ~F.col("speech") & inside & later)
    sec = F.col("length") * HOP / rate
    total = F.sum(sec)
    p = F.when(F.col("pause"), sec)
    return r.groupBy("rec_id").agg(
        F.coalesce(F.avg(p), F.lit(0.0)).alias("pause_mean"), F.coalesce(F.max(p), F.lit(0.0)).alias("pause_longest"), F.coalesce(ratio(F.count(p), total), F.lit(0.0)).alias("pause_rate"), F.coalesce(F.avg(F.when(F.col("speech"), sec)), F.lit(0.0)).alias("segment_mean")
    )


def onset_rate(frames: DataFrame, mask: str, rate: int = 16000) -> DataFrame:
    """Speech rate: onsets of voiced frames per second; below 0.1 s it is 0."""
    before = F.lag(F.col(mask).cast("int"), 1, 0).over(W.partitionBy("rec_id").orderBy("frame"))
    rows = frames.withColumn("onset", (F.col(mask) & (before == 0)).cast("int"))
    sec = F.count("*") * HOP / rate
    return rows.groupBy("rec_id").agg(F.when(sec < 0.1, 0.0).otherwise(F.sum("onset") / sec).alias("onset_rate"))


def clicks_and_dropouts(frames: DataFrame, value: str, rate: int = 16000) -> DataFrame:
    """Distortion: frames above three times both neighbours, and frames under 1 % of the median, per second."""
    w = W.partitionBy("rec_id").orderBy("frame")
    x = F.col(value)
    rows = frames.withColumn("click", ((x > 3 * F.lag(value).over(w)) & (x > 3 * F.lead(value).over(w))).cast("int"))
    med = frames.groupBy("rec_id").agg(F.percentile(value, 0.5).alias("med"))
    rows = rows.join(med, "rec_id").withColumn("drop", (x < 0.01 * F.col("med")).cast("int"))
    sec = F.count("*") * HOP / rate
    return rows.groupBy("rec_id").agg((F.coalesce(F.sum("click"), F.lit(0)) / sec).alias("click_rate"), (F.sum("drop") / sec).alias("dropout_rate"), F.count_distinct(F.round(x, 1)).alias("levels"))


def interruptions(frames: DataFrame, mask: str, least: int = 5, most: int = 50) -> DataFrame:
    """Signal integrity: gaps of ``least``..``most`` frames with speech on both sides."""
    r = runs(frames, mask)
    w = W.partitionBy("rec_id").orderBy("first")
    gap = ~F.col("speech") & F.col("length").between(least, most) & F.lag("speech").over(w) & F.lead("speech").over(w)
    return r.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("int")).groupBy("rec_id").agg(F.sum("gap").alias("gaps"))


def rhythm(frames: DataFrame, mask: str) -> DataFrame:
    """nPVI of speech run lengths: 100 * mean of |a - b| / ((a + b) / 2) over successive runs; 0 below two runs."""
    s = runs(frames, mask).where("speech")
    prev = F.lag("length").over(W.partitionBy("rec_id").orderBy("first"))
    s = s.withColumn("d", F.abs(F.col("length") - prev) / ((F.col("length") + prev) / 2.0))
    return s.groupBy("rec_id").agg(F.coalesce(100 * F.avg("d"), F.lit(0.0)).alias("npvi"), F.count("*").alias("segments"))


def level_features(frames: DataFrame, value: str) -> DataFrame:
    """Energy dynamics and noise: range and variance in dB, segmental SNR of loud over quiet frames in [-10, 60]."""
    db = 20 * F.log10(F.greatest(F.col(value), F.lit(1e-10)))
    q = F.percentile("db", F.array(F.lit(0.1), F.lit(0.9)))
    a = frames.withColumn("db", db).groupBy("rec_id").agg(F.avg("db").alias("mean_db"), (F.max("db") - F.min("db")).alias("range_db"), F.var_pop("db").alias("var_db"), q.alias("q"))
    return a.select("rec_id", "mean_db", "range_db", "var_db", F.least(F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(-10.0)), F.lit(60.0)).alias("snr_db"))


def warnings(recordings: DataFrame) -> DataFrame:
    """``rec_id, warnings`` of ``(rec_id, peak, clipped_share, total_duration_sec, speech_ratio)``."""
    w = F.array_compact(
        F.array(
            F.when(F.col("peak") < 0.001, "TooQuiet"), F.when(F.col("clipped_share") > 0.10, "Clipped"), F.when(F.col("total_duration_sec") < 1.0, "TooShort"), F.when(F.col("speech_ratio") < 0.05, "InsufficientSpeech")
        )
    )
    return recordings.select("rec_id", w.alias("warnings"))
