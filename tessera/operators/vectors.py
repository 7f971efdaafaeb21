"""Embedding operators: centroids, leave-one-out and normalised scores, impostor and pair scores.

Dot products of many vectors run as matrix products over blocks in Arrow tasks; per-speaker values are grouped by
Spark. Cohort statistics use the cohort's mean and second moment matrix, whose size is fixed by the dimension.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import dot, norm, unit
from . import pairs
from .spectra import transformed

FLOOR = 1e-8


def valid(e: DataFrame) -> DataFrame:
    """embeddings of a norm above 1e-6; failed ones are all zero."""
    return e.where(norm(F.col("v")) > 1e-6)


def centroids(e: DataFrame, *keys: str) -> DataFrame:
    """A1: ``*keys, centroid, n``: element-wise mean of the unit vectors of a key, normalised."""
    rows = e.select(*keys, F.posexplode(unit(F.col("v"))).alias("pos", "x"))
    means = rows.groupBy(*keys, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    packed = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("a"), F.max("n").alias("n"))
    return packed.select(*keys, unit(F.transform("a", lambda s: s["m"])).alias("centroid"), "n")


def leave_one_out(e: DataFrame, c: DataFrame, *keys: str) -> DataFrame:
    """L1: each vector against the normalised rest of its key's centroid; null for a key of one vector."""
    joined = e.join(c, list(keys)).withColumn("u", unit(F.col("v")))
    rest = F.zip_with("centroid", "u", lambda m, x: (m * F.col("n") - x) / F.greatest(F.col("n") - 1, F.lit(1)))
    raw = F.when(F.col("n") > 1, dot(F.col("u"), unit(rest)))
    return joined.select("row_idx", *keys, "u", "centroid", raw.alias("genuine_raw"))


def moments(cohort: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """The mean of the cohort's unit vectors and their covariance; None of an empty cohort.

    Tasks add up outer products of centred vectors, so what is shuffled and reaches the driver is the square of the
    dimension whatever the cohort's size.
    """
    units = cohort.select(unit(F.col("v")).alias("k"))
    mean = np.array([r["m"] for r in units.select(F.posexplode("k").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).orderBy("pos").collect()])
    d = len(mean)
    if not d:
        return None

    def partial(batches):
        total, n = np.zeros((d, d)), 0
        for batch in batches:
            x = batch.column("k").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d) - mean
            total, n = total + x.T @ x, n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.reshape(-1)), pa.array(np.full(d * d, n))], names=["at", "x", "n"])

    cells = units.mapInArrow(partial, "at long, x double, n long").groupBy("at").agg((F.sum("x") / F.sum("n")).alias("c")).orderBy("at")
    return mean, np.array([r["c"] for r in cells.collect()]).reshape(d, d)


def cohort_stats(vectors: DataFrame, column: str, cohort: DataFrame | tuple | None, name: str) -> DataFrame:
    """Mean and population deviation of ``column``'s cosine with every cohort vector, as ``{name}_mu, {name}_sd``.

    ``cohort``: its vectors, or their ``moments``. The mean is the product with the mean vector, the variance the quadratic
    form of the covariance, both by matrix products over batches. An empty cohort gives nulls.
    """
    known = moments(cohort) if isinstance(cohort, DataFrame) else cohort
    if known is None:
        return vectors.withColumn(f"{name}_mu", F.lit(None).cast("double")).withColumn(f"{name}_sd", F.lit(None).cast("double"))
    mean, cov = known
    of = lambda x: np.stack([x @ mean, np.maximum(np.sqrt(np.maximum(((x @ cov) * x).sum(axis=1), 0)), FLOOR)], axis=1)
    rows = transformed(vectors, column, "cohort_stats", of)
    return rows.withColumn(f"{name}_mu", F.get("cohort_stats", 0)).withColumn(f"{name}_sd", F.get("cohort_stats", 1)).drop("cohort_stats")


def s_norm(raw, a: str, b: str):
    """L2: the mean of the score standardised on both sides."""
    return ((raw - F.col(f"{a}_mu")) / F.col(f"{a}_sd") + (raw - F.col(f"{b}_mu")) / F.col(f"{b}_sd")) / 2


def genuine_scores(e: DataFrame, cohort: DataFrame) -> DataFrame:
    """``row_idx, speaker, genuine_raw, genuine_norm``; the speaker's full centroid is normalised once per speaker."""
    known = moments(cohort)
    c = cohort_stats(centroids(e, "speaker"), "centroid", known, "spk")
    scored = leave_one_out(e, c.select("speaker", "centroid", "n"), "speaker")
    scored = cohort_stats(scored.drop("centroid"), "u", known, "utt").join(c.select("speaker", "spk_mu", "spk_sd"), "speaker")
    return scored.select("row_idx", "speaker", "genuine_raw", s_norm(F.col("genuine_raw"), "utt", "spk").alias("genuine_norm"))


def impostor_scores(e: DataFrame, cohort: DataFrame) -> DataFrame:
    """Centroids of all speakers i < j against each other, raw and normalised."""
    c = cohort_stats(centroids(e, "speaker"), "centroid", cohort, "spk").drop("n")
    both = pair_products(c, [], "speaker", "centroid").select(F.col("a").alias("spk_a"), F.col("b").alias("spk_b"), F.col("score").alias("raw"))
    for side in "ab":
        both = both.join(c.select(F.col("speaker").alias(f"spk_{side}"), F.col("spk_mu").alias(f"{side}_mu"), F.col("spk_sd").alias(f"{side}_sd")), f"spk_{side}")
    return both.select("spk_a", "spk_b", "raw", s_norm(F.col("raw"), "a", "b").alias("norm"))


def pair_products(rows: DataFrame, keys: list[str], name: str, vector: str, block: int = 256) -> DataFrame:
    """``*keys, a long, b long, score``: products of the vectors of every two rows a < b of one key, ``name`` being whole
    numbers that tell a key's rows apart.

    Rows are packed into blocks of ``block`` numbers and a task multiplies two blocks, so no key is one task. The result is
    quadratic by definition; keys of hundreds of thousands of rows send each row to its key's blocks once.
    """
    packed = rows.groupBy(*keys, F.floor(F.col(name) / block).alias("blk")).agg(F.collect_list(F.struct(F.col(name).cast("long").alias("k"), F.col(vector).alias("v"))).alias("of"))
    side = lambda s: packed.select(*keys, F.col("blk").alias(f"{s}_blk"), F.transform("of", lambda r: r["k"]).alias(f"{s}_k"), F.flatten(F.transform("of", lambda r: r["v"])).alias(f"{s}_v"))
    a, b = side("a"), side("b")
    both = (a.join(b, keys) if keys else a.crossJoin(b)).where("a_blk <= b_blk").repartition(*keys, "a_blk", "b_blk")
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                i, j, x, y = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("a_k", "b_k", "a_v", "b_v"))
                m = x.reshape(len(i), -1) @ y.reshape(len(j), -1).T
                left, right = np.broadcast_to(i[:, None], m.shape), np.broadcast_to(j[None], m.shape)
                keep = left < right if batch.column("a_blk")[r] == batch.column("b_blk")[r] else np.ones(m.shape, bool)
                names = [pa.array([batch.column(k)[r].as_py()] * int(keep.sum()), batch.schema.field(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*names, pa.array(left[keep]), pa.array(right[keep]), pa.array(m[keep])], names=schema.names)

    return both.mapInArrow(run, schema)


def mutual_best(a: DataFrame, b: DataFrame, least: float, block: int = pairs.MOST) -> DataFrame:
    """Pairs that are each other's best match of at least ``least``; ties go to the smaller key.

    ``a(key_a, u)``, ``b(key_b, u)`` with integer keys and unit vectors. A task multiplies a stripe of each, of at most about
    ``block`` rows, and hands on the best of every row on either side: each row once for every stripe of the other side.
    """
    found = pairs.best_matches(a.withColumnRenamed("key_a", "key"), b.withColumnRenamed("key_b", "key"), block)
    best = found.groupBy("side", "key").agg(F.max(F.struct("s", (-F.col("other")).alias("k"))).alias("m")).select("side", "key", (-F.col("m.k")).alias("other"), F.col("m.s").alias("s"))
    pair = best.select(F.when(F.col("side") == "a", F.col("key")).otherwise(F.col("other")).alias("key_a"), F.when(F.col("side") == "a", F.col("other")).otherwise(F.col("key")).alias("key_b"), "s")
    return pair.groupBy("key_a", "key_b").agg(F.count("*").alias("n"), F.max("s").alias("score")).where((F.col("n") == 2) & (F.col("score") >= least)).select("key_a", "key_b", "score")


def embedding_qa(e: DataFrame) -> DataFrame:
    """One row on norms and on the spread of the dimensions' means and deviations."""
    norms = e.select(norm(F.col("v")).alias("n")).agg(
        F.count("*").alias("n_rows"), F.min("n").alias("norm_min"), F.max("n").alias("norm_max"), F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"), F.count(F.when(F.col("n") <= 1e-6, 1)).alias("n_zero")
    )
    dims = e.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return norms.crossJoin(dims.agg(F.min("m").alias("dim_mean_min"), F.max("m").alias("dim_mean_max"), F.min("s").alias("dim_std_min"), F.max("s").alias("dim_std_max")))


def embed(recordings: DataFrame, load, batch: int = 32) -> DataFrame:
    """``rec_id, embedding array<float>`` of ``recordings(rec_id, samples array<float>)`` by a speaker network.

    ``load()`` runs once in a worker and returns a function from a zero-padded ``(n, longest)`` float array and the
    relative lengths to an ``(n, dim)`` array; no network ships here. Recordings are batched ``batch`` at a time; one
    without samples has a null embedding.
    """
    kind = recordings.schema["rec_id"].dataType.simpleString()

    def run(batches):
        network = load()
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                samples = [np.asarray(x if x is not None else [], np.float32) for x in part.column("samples").to_pylist()]
                own = [k for k, x in enumerate(samples) if len(x)]
                out: list = [None] * len(samples)
                if own:
                    longest = max(len(samples[k]) for k in own)
                    padded = np.stack([np.pad(samples[k], (0, longest - len(samples[k]))) for k in own])
                    for k, v in zip(own, network(padded, np.array([len(samples[k]) / longest for k in own], np.float32))):
                        out[k] = np.asarray(v, np.float32).tolist()
                yield pa.RecordBatch.from_arrays([part.column("rec_id"), pa.array(out, pa.list_(pa.float32()))], names=["rec_id", "embedding"])

    return recordings.select("rec_id", "samples").mapInArrow(run, f"rec_id {kind}, embedding array<float>")
