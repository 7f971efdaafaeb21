"""Streams of frame events: windowed histograms and quality bins with watermarks, and session summaries.

This is an extension of the batch operators H1 and L7: a frame event is ``(ts, rec_id, value)``, late events within the
watermark count, later ones are dropped by the engine. State is per window and group, so it is bounded by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream of event files below ``folder``; event time becomes a timestamp, which watermarks need."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*events*.parquet").parquet(folder)
    return raw.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("rec_id"), "event_type", "value")


def windowed_histogram(events: DataFrame, edges: list[float], width: str = "1 day", late: str = "2 days", slide: str | None = None) -> DataFrame:
    """Counts per window and histogram bin, with the mean value."""
    x = F.col("value")
    b = sum((F.when(x >= e, 1).otherwise(0) for e in edges[1:]), F.when(x >= edges[0], 1).otherwise(0))
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), b.alias("bin")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "bin", "n", "mean")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of a recording's events parted by ``gap``: frames, mean and largest value."""
    s = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "rec_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return s.select("rec_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "peak")


def run_to_end(stream: DataFrame, checkpoint: str, out: str) -> None:
    """Process all that is there and stop: each batch's new and changed rows are appended to ``out`` with its number, so
    that a batch that is repeated after a failure overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last state of each key of what ``run_to_end`` wrote."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
