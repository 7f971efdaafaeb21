"""The engine's domain tables on top of Parquet folders, and readers for the file formats that manifests come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("filename", "speaker_id", "dataset_source")])
PAIR_LIST = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("path1", T.StringType()), T.StructField("path2", T.StringType())])
#: Dimensions of the three embedding systems that share the stored 64 dimensions: first (from 1) and count.
PROVIDERS = {"P1": (1, 22), "P2": (23, 21), "P3": (44, 21)}

#: Features of ``measures`` and their columns of lineitem.
MEASURES = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """``row_idx, speaker, v array<double>``: doubles before any arithmetic, so that both engines agree."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("row_idx"), F.col("label").alias("speaker"), F.col("embedding").cast("array<double>").alias("v"))


def provider_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """``provider, row_idx, speaker, v``: the three systems stacked."""
    whole = embeddings(spark, folder)
    parts = F.array(*[F.struct(F.lit(p).alias("provider"), F.slice("v", at, n).alias("v")) for p, (at, n) in PROVIDERS.items()])
    return whole.select("row_idx", "speaker", F.explode(parts).alias("p")).select("p.provider", "row_idx", "speaker", "p.v")


def qualities(spark: SparkSession, folder: str) -> DataFrame:
    """``row_idx, q_s, q_v``: synthetic quality scores 0..100 of the embedded recordings."""
    i = F.col("vec_id")
    return table(spark, folder, "embeddings").select(i.alias("row_idx"), (i * 37 % 101).cast("int").alias("q_s"), ((i * 53 + 11) % 101).cast("int").alias("q_v"))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """``rec_id, frame, value, speech``: a recording is a user's events in time order."""
    from pyspark.sql import Window as W

    e = table(spark, folder, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("rec_id"), (F.row_number().over(order) - 1).cast("long").alias("frame"), "value", (F.col("event_type") != "error").alias("speech"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``row_idx, filename, speaker_id, dataset_source, duration``: documents seen as recordings."""
    d = table(spark, folder, "documents")
    return d.select(
        F.col("doc_id").alias("row_idx"), F.format_string("%s/%s/sp%04d/rec%d.wav", "source", "lang", F.col("doc_id") % 97, "doc_id").alias("filename"),
        F.format_string("sp%04d", F.col("doc_id") % 97).alias("speaker_id"), F.col("source").alias("dataset_source"), (F.col("n_chars") / 1000.0).alias("duration"),
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """``row_idx, dataset, label, score``: labelled samples with an integer score 0..100."""
    d, l = table(spark, folder, "documents"), table(spark, folder, "labels")
    score = (F.col("n_chars") * 7 % 101).cast("long")
    return l.join(d, "doc_id").select(F.col("doc_id").alias("row_idx"), F.col("source").alias("dataset"), F.col("quality").alias("label"), score.alias("score"), (F.col("n_chars") * 13 % 101).cast("long").alias("score_v"))


def wide_measures(spark: SparkSession, folder: str) -> DataFrame:
    """``row_idx, *MEASURES``: the numeric columns of lineitem as features. An index may occur several times."""
    l = table(spark, folder, "lineitem")
    return l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), *[F.col(c).cast("double").alias(k) for k, c in MEASURES.items()])


def measures(spark: SparkSession, folder: str) -> DataFrame:
    """``row_idx, feature, value``: ``wide_measures`` as a long feature table."""
    return wide_measures(spark, folder).unpivot(["row_idx"], list(MEASURES), "feature", "value")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A CSV manifest with a header; only the columns used are parsed."""
    return spark.read.option("header", True).schema(MANIFEST).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").schema(schema).csv(path)


def read_pair_list(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(pairs, rejected lines)`` of a text file of ``label path1 path2``."""
    lines = spark.read.text(path).select("value", F.split(F.trim("value"), r"\s+").alias("f"))
    good = (F.size("f") == 3) & F.element_at("f", 1).isin("0", "1")
    pairs = lines.where(good).select(F.element_at("f", 1).cast("int").alias("label"), F.element_at("f", 2).alias("path1"), F.element_at("f", 3).alias("path2"))
    return pairs, lines.where(~good & (F.trim("value") != "")).select("value")


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of all WAV files below ``path``, with the speaker from the path as ``speaker_id``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", "content", F.regexp_extract("path", r"(sp\d{4})", 1).alias("speaker_id"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """``done, total, rate`` of lines such as ``[120/4000] ... 2.5 files/s`` in progress logs; other lines go."""
    lines = spark.read.text(path)
    part = lambda k: F.regexp_extract("value", r"\[?(\d+)\s*/\s*(\d+)\]?.*?([\d.]+)\s*files/s", k)
    rows = lines.select(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")).where("a <> ''")
    return rows.select(F.col("a").cast("long").alias("done"), F.col("b").cast("long").alias("total"), F.col("c").cast("double").alias("rate"))


def write_report(df: DataFrame, path: str, form: str = "parquet") -> None:
    """``parquet``, ``csv`` with a header or ``json``, replacing what is there."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if form == "csv" else getattr(w, form)(path)
