"""Helpers shared by the corpus operators: shared folders, written cuts of the lineage, binary files."""

from __future__ import annotations

import contextlib
import re
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Target bytes of one binary file; each is built in one Python value, so this bounds a worker's memory.
FILE_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str, least_parts: int = 0) -> DataFrame:
    """A table of the folder. ``least_parts``: where the scan has fewer partitions, as one of a few row groups has, its
    rows are dealt out evenly to so many (one shuffle of the table); 0 leaves the partitions of the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df if not least_parts or df.rdd.getNumPartitions() >= least_parts else df.repartition(least_parts)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster shares (``spark.checkpoint.dir``).

    Where the setting is absent, one process (a local master: tests, a laptop) sets a temporary folder of its machine once
    for the session; on a cluster, whose machines would not see each other's, this raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later failures restart from these files."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a key of its rows, ``row_key long``, written once so that every later read has the same keys."""
    return cut(df.withColumn("row_key", F.monotonically_increasing_id()), name)


def discard(*written: DataFrame) -> None:
    """Delete the files of results of ``cut`` that no later plan reads: those made of them are written by now."""
    for df in written:
        jvm, context = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context.hadoopConfiguration()).delete(path, True)


def write_blobs(df: DataFrame, column: str, path: str) -> None:
    """Write each row's binary value as one file, followed by one byte 0x0A that the text sink appends.

    The text sink passes bytes through unchanged, so this reaches any Hadoop file system and keeps Spark's commit
    protocol: a lost executor's half-written files are never seen. Formats written this way end before that byte.
    """
    df.select(F.col(column).cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option(
        "compression", "none"
    ).text(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """``path string, content binary``; files are bounded by their writer, so whole contents fit a worker."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def arrow_rows(batches: Iterator[pa.RecordBatch], *names: str, step: int = 1024) -> Iterator[list[list]]:
    """Column lists of at most ``step`` rows, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield [part.column(n).to_pylist() for n in names]


def byte_slices(batches: Iterator[pa.RecordBatch], *names: str, limit: int = 4 << 20, rows: int = 1024) -> Iterator[list[list]]:
    """Column lists of at most ``rows`` rows with about ``limit`` bytes of the last column, or one value of it."""
    for batch in batches:
        sizes = [x or 0 for x in pc.binary_length(batch.column(names[-1])).to_pylist()]
        at = held = 0
        for i, s in enumerate(sizes):
            if i > at and (held + s > limit or i - at == rows):
                yield [batch.column(n).slice(at, i - at).to_pylist() for n in names]
                at, held = i, 0
            held += s
        if len(sizes) > at:
            yield [batch.column(n).slice(at).to_pylist() for n in names]


def texts_as_bytes(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns with ``text`` as UTF-8 bytes, null as empty."""
    return docs.select(*names, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


class TwoGenerations(dict):
    """A bounded memo: once ``limit`` new keys are in, they become the old generation and the former old one goes.

    Subclasses compute a missing value in ``make``. Frequent keys are promoted on every turn, so they stay. Keys longer
    than ``longest`` are computed each time, so the memo's bytes are bounded too.
    """

    longest = 64

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def make(self, key):
        raise NotImplementedError

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


_KEPT: dict = {}


@contextlib.contextmanager
def kept(key, make: Callable, seconds: float = 3.0):
    """``make()``, which the worker keeps for the next task that asks for ``key``; once none has for some seconds, it goes.

    So memos last through a stage and do not weigh on the stages after it.
    """
    value, timer = _KEPT.pop(key, (None, None))
    if timer is not None:
        timer.cancel()
    if value is None:
        value = make()
    try:
        yield value
    finally:
        timer = threading.Timer(seconds, _KEPT.pop, (key, None))
        timer.daemon = True
        _KEPT[key] = (value, timer)
        timer.start()
