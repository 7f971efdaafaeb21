"""Best paths through the states of consecutive frames, in blocks that do not depend on each other.

A frame has a few states, each with a score; two states of neighbouring frames are joined by a score of their own. The path
of the largest sum over a recording is found in blocks of frames that share one frame with the block before: of each block
first the best sums from each of its first states to each of its last ones, then, over these small tables alone, where the
recording's best path enters and leaves every block, then the path inside each block. So a long recording is many rows, and
no task holds more than a block's frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Joined = Callable[[np.ndarray, np.ndarray], np.ndarray]


def sums(values: list, scores: list, joined: Joined, start: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best sums to the last frame's states from each row of ``start`` (sums at the first frame), and at each later frame
    the state before, by row and state."""
    best, back = start, []
    for a, b, s in zip(values, values[1:], scores[1:], strict=False):
        through = best[:, :, None] + joined(a, b)
        back.append(through.argmax(axis=1))
        best = through.max(axis=1) + s
    return best, back


def inside(values: list, scores: list, joined: Joined, start: int, end: int, first: bool) -> list[int]:
    """The states of a block's best path from its state ``start``, or from any if it is the first, to its state ``end``."""
    begin = np.array(scores[0])[None] if first else np.where(np.arange(len(values[0])) == start, 0.0, -np.inf)[None]
    at = [end]
    for back in reversed(sums(values, scores, joined, begin)[1]):
        at.append(int(back[0, at[-1]]))
    return at[::-1]


def crossed(tables: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and last state of every block on the best path; the first block's table has one row."""
    best, back = tables[0][0], []
    for t in tables[1:]:
        through = best[:, None] + t
        back.append(through.argmax(axis=0))
        best = through.max(axis=0)
    at = [int(best.argmax())]
    for b in reversed(back):
        at.append(int(b[at[-1]]))
    at.reverse()
    return [(0, at[0]), *zip(at, at[1:], strict=False)]


def _each(df: DataFrame, schema: T.StructType, rows_of: Callable[[dict], list[tuple]], limit: int = 16) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit)
                rows = [r for row in part.to_pylist() for r in rows_of(row)]
                kinds = [batch.schema.field("rec_id").type, *(pa.list_(pa.list_(pa.float64())) if isinstance(f.dataType, T.ArrayType) else pa.int64() for f in schema.fields[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], schema.names)

    return df.mapInArrow(run, schema)


def best_path(frames: DataFrame, joined: Joined, block: int = 4096) -> DataFrame:
    """``rec_id, frame, state``: the place, from 0, of the best path's state in each frame of ``frames(rec_id, frame, values
    array<double>, scores array<double>)``; a recording's frames are numbered from 0 without gaps and have a state at least."""
    own = F.floor(F.col("frame") / block)
    cut = F.when(F.col("frame") % block == block - 1, F.array(own, own + 1)).otherwise(F.array(own))
    rows = frames.select("rec_id", F.explode(cut).alias("block"), F.struct(F.col("frame").cast("long").alias("frame"), "values", "scores").alias("state"))
    blocks = rows.groupBy("rec_id", "block").agg(F.array_sort(F.collect_list("state")).alias("states"))
    # a block that has the shared frame alone adds nothing
    blocks = blocks.where((F.col("block") == 0) | (F.size("states") > 1))
    key = frames.schema["rec_id"]
    long = lambda name: T.StructField(name, T.LongType())

    def parts(row: dict) -> tuple[list, list]:
        return [np.array(s["values"]) for s in row["states"]], [np.array(s["scores"]) for s in row["states"]]

    def table(row: dict) -> list[tuple]:
        values, scores = parts(row)
        start = scores[0][None] if row["block"] == 0 else np.where(np.eye(len(values[0])) > 0, 0.0, -np.inf)
        return [(row["rec_id"], row["block"], sums(values, scores, joined, start)[0].tolist())]

    def ends(row: dict) -> list[tuple]:
        found = crossed([np.array(b["sums"]) for b in row["blocks"]])
        return [(row["rec_id"], b["block"], *f) for b, f in zip(row["blocks"], found, strict=True)]

    def walked(row: dict) -> list[tuple]:
        path = inside(*parts(row), joined, row["first"], row["last"], row["block"] == 0)
        return [(row["rec_id"], s["frame"], p) for s, p in zip(row["states"], path, strict=True) if s["frame"] // block == row["block"]]

    tables = _each(blocks, T.StructType([key, long("block"), T.StructField("sums", T.ArrayType(T.ArrayType(T.DoubleType())))]), table)
    whole = tables.groupBy("rec_id").agg(F.array_sort(F.collect_list(F.struct("block", "sums"))).alias("blocks"))
    known = _each(whole, T.StructType([key, long("block"), long("first"), long("last")]), ends)
    return _each(blocks.join(known, ["rec_id", "block"]), T.StructType([key, long("frame"), long("state")]), walked)
