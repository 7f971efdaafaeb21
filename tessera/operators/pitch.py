"""Pitch of frames: candidates by the cumulative-mean-normalised difference, and the path through them.

The difference of a frame's first half from itself at a lag dips at periods. How likely each dip is follows from a prior
over thresholds: every threshold takes one of the dips below it, rather an early one; a frame's sum of these is its voiced
probability (FramePC). A Viterbi path over the recording's frames, in which a pitch moves little and voicing rarely
changes, chooses between the dips and silence and gives the pitch (FrameF0). Candidates are a function of the frame alone;
the path is a job of its own over the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .paths import best_path
from .spectra import Signal

PITCH = Signal(rate=16000, size=2048, hop=160)
#: Fixed values of the method: thresholds in hundredths with a beta prior of 2 and 18, the decay over the dips below a
#: threshold, the share that the deepest dip has of thresholds below it, tenths of semitones, octaves a second, switches.
THRESHOLDS = np.arange(1, 101) / 100
DECAY, NO_DIP, PARTS, OCTAVES, SWITCH = 2.0, 0.01, 10, 35.92, 0.01


def prior_above(x: np.ndarray) -> np.ndarray:
    """What the prior has above ``x``, in closed form."""
    return (1 - x) ** 18 * (1 + 18 * x)


PRIOR = prior_above((np.arange(1, 101) - 1) / 100) - prior_above(THRESHOLDS)


def lags(s: Signal, lowest: float, highest: float) -> tuple[int, int]:
    return int(s.rate // highest), min(int(np.ceil(s.rate / lowest)), s.size - s.size // 2 - 1)


def differences(x: np.ndarray, most: int) -> np.ndarray:
    """Of each row: squared difference of its first half from the samples ``lag`` later, over its mean at lags 1 to ``lag``,
    for lags 1 to ``most``; 1 where nothing differs."""
    half = x.shape[1] // 2
    size = 1 << int(np.ceil(np.log2(x.shape[1] + half)))
    cross = np.fft.irfft(np.conj(np.fft.rfft(x[:, :half], size)) * np.fft.rfft(x, size), size)[:, 1 : most + 1]
    run = np.pad(np.cumsum(x * x, axis=1), ((0, 0), (1, 0)))
    lag = np.arange(1, most + 1)
    apart = np.maximum(run[:, half, None] + run[:, lag + half] - run[:, lag] - 2 * cross, 0)
    apart[apart < 1e-13 * run[:, -1:]] = 0
    total = np.cumsum(apart, axis=1)
    return np.where(total > 0, apart * lag / np.where(total > 0, total, 1), 1.0)


def dips(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, column, shift of the minimum by a parabola, and probability of each dip of the rows of ``c``."""
    before = np.concatenate([np.full((len(c), 1), np.inf), c[:, :-1]], axis=1)
    after = np.concatenate([c[:, 1:], c[:, -1:]], axis=1)
    is_dip = (c < before) & (c <= after)
    is_dip[:, 0] = c[:, 0] < c[:, 1]
    row, col = np.nonzero(is_dip)
    height = c[row, col]
    inner = (col > 0) & (col < c.shape[1] - 1)
    left, right = before[row, col], after[row, col]
    bend, tilt = np.where(inner, right + left - 2 * height, 0), np.where(inner, (right - left) / 2, 0)
    shift = np.where(np.abs(tilt) < np.abs(bend), -tilt / np.where(bend == 0, 1, bend), 0.0)
    if not len(row):
        return row, col, shift, height
    # by dip and threshold: whether the dip is below it, and of how many in its row, as the how manieth
    below = height[:, None] < THRESHOLDS
    count = np.cumsum(below, axis=0)
    first = np.searchsorted(row, row)
    last = np.searchsorted(row, row, side="right") - 1
    start = count[first] - below[first]
    place, many = count - start - 1, count[last] - start
    share = np.where(below, np.exp(-DECAY * place) * (1 - np.exp(-DECAY)) / (1 - np.exp(-DECAY * np.maximum(many, 1))), 0)
    p = share @ PRIOR
    order = np.lexsort((col, height, row))
    deepest = order[np.searchsorted(row, np.unique(row))]
    p[deepest] += NO_DIP * (~below[deepest] @ PRIOR)
    return row, col, shift, p


def candidates(frames: DataFrame, s: Signal = PITCH, lowest: float = 60.0, highest: float = 500.0) -> DataFrame:
    """``rec_id, frame, tenths array<double>, chances array<double>``: the dips of ``frames(rec_id, frame, samples)`` as
    tenths of semitones above ``lowest``, within the range, and their probabilities; none in silence."""
    low, high = lags(s, lowest, highest)
    top = int(np.floor(12 * PARTS * np.log2(highest / lowest)))
    lists = lambda name: T.StructField(name, T.ArrayType(T.DoubleType()))
    schema = T.StructType([frames.schema["rec_id"], frames.schema["frame"], lists("tenths"), lists("chances")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = part.column("samples").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                row, col, shift, p = dips(differences(x, high)[:, low - 1 :])
                tenths = np.rint(12 * PARTS * np.log2(s.rate / (low + col + shift) / lowest))
                keep = (tenths >= 0) & (tenths <= top) & (p > 0)
                row, tenths, p = row[keep], tenths[keep], p[keep]
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("rec_id"), part.column("frame"), *(pa.ListArray.from_arrays(ends, pa.array(v.astype(float))) for v in (tenths, p))], schema.names)

    return frames.select("rec_id", "frame", "samples").mapInArrow(run, schema)


def moves(s: Signal) -> float:
    """How many tenths of a semitone a pitch may move from a frame to the next."""
    return float(np.rint(OCTAVES * 12 * s.hop / s.rate) * PARTS)


def joins(s: Signal):
    """Log weight of two states: falling with the distance of their pitches to nothing beyond the reach, times the chance
    that voicing stays or switches. Silence is no number and is near every pitch."""
    reach = moves(s)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        away = np.abs(a[:, None] - b[None])
        silent = np.isnan(away)
        both = np.isnan(a)[:, None] == np.isnan(b)[None]
        near = np.where(silent, 1.0, 1 - away / (reach / 2 + 1))
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(near, 1e-300)) + np.log(np.where(both, 1 - SWITCH, SWITCH))

    return joined


def tracked(found: DataFrame, s: Signal = PITCH, lowest: float = 60.0, highest: float = 500.0, block: int = 4096) -> DataFrame:
    """``rec_id, frame, FramePC, FrameF0`` of ``candidates``: voiced probability, and the path's pitch, 0 where it is silent."""
    bins = np.floor(12 * PARTS * np.log2(highest / lowest)) + 1
    voiced = F.least(F.aggregate("chances", F.lit(0.0), lambda a, v: a + v), F.lit(1.0))
    rows = found.select("rec_id", "frame", "tenths", voiced.alias("FramePC"), "chances")
    tiny = F.lit(1e-300)
    states = rows.select(
        "rec_id", "frame", F.concat("tenths", F.array(F.lit(float("nan")))).alias("values"),
        F.concat(F.transform("chances", lambda p: F.ln(F.greatest(p, tiny))), F.array(F.ln(F.greatest((1 - F.col("FramePC")) / float(bins), tiny)))).alias("scores"),
    )
    path = best_path(states, joins(s), block)
    pitch = F.get("tenths", F.col("state").cast("int"))
    return rows.join(path, ["rec_id", "frame"]).select("rec_id", "frame", "FramePC", F.coalesce(lowest * F.pow(F.lit(2.0), pitch / (12 * PARTS)), F.lit(0.0)).alias("FrameF0"))


def pitch(frames: DataFrame, s: Signal = PITCH, lowest: float = 60.0, highest: float = 500.0) -> DataFrame:
    """``tracked`` candidates of ``frames``, which are centred (``framed(..., "zero")``) and two of the longest periods long."""
    return tracked(candidates(frames, s, lowest, highest), s, lowest, highest)
