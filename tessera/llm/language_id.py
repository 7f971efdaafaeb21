"""Language identification: word-first backoff to character n-grams.

Training counts, per language, the words and the character n-grams (orders 1 to ``order``, word ends marked) of a
sample of labelled documents. The sample is the documented bound of the classifier: about ``per_language`` documents
of each label, chosen by a hash of the id, whole texts; every word and n-gram of the sample is kept.

Keys are hashed to 64 bits where they are counted, so a shuffle moves numbers. Spark turns the counts into log relative
frequencies, which workers map as sorted arrays (``mapped``): neither counts nor scores pass through the driver, which
holds the labels and a total per order and label.

A known word scores the log of its relative frequency in each language. An unseen word scores the mean log frequency
of its known n-grams of the longest order that has any. The sum over a document's words gives, by softmax, the
probability of each language; the score is the largest one. Prediction is one narrow Arrow stage over the scan.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, cut, kept, shared_dir
from .mapped import Mapped, pack, written

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
FILE_ROWS = 1 << 19  #: keys in a file of the model
MEMO = 200_000  #: words whose scores a worker remembers


def words_of(text: str | None) -> list[str]:
    """Letters with the marks on them, lower-cased; digits, also those like ``½``, are no letters."""
    return LETTERS.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def hash_of(kind: int, key: str) -> int:
    """64 bits of a word (kind 0) or of an n-gram of ``kind`` characters, as a signed number."""
    return xxhash.xxh3_64_intdigest(key.encode(), kind) - (1 << 63)


@dataclass
class Model:
    """Labels in order, and the files of ``hash, scores`` that hold the log frequencies of words and n-grams."""

    languages: list[str]
    files: list[tuple[str, int, int]]
    order: int
    name: str = ""

    def open(self) -> Mapped:
        return Mapped(self.files, {"hash": "<i8", "scores": f"({len(self.languages)},)<f4"})

    def found(self, arrays: Mapped, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and the scores of those."""
        distinct, where = np.unique(hashes, return_inverse=True)
        places = arrays.find("hash", distinct)
        hit = places >= 0
        scores = np.zeros((len(distinct), len(self.languages)), np.float32)
        if hit.any():
            scores[hit] = arrays.take("scores", places[hit])
        return hit[where], scores[where]

    def rows(self, arrays: Mapped, words: list[str]) -> np.ndarray:
        """Scores of the words in each language; 0 where neither a word nor any of its n-grams is known."""
        known, out = self.found(arrays, np.array([hash_of(0, w) for w in words], np.int64))
        out = out.astype(np.float64)
        left = np.flatnonzero(~known)
        for n in range(self.order, 0, -1):
            if not len(left):
                break
            grams = [grams_of(words[i], n) for i in left.tolist()]
            owner = np.repeat(np.arange(len(left)), [len(g) for g in grams])
            hit, scores = self.found(arrays, np.array([hash_of(n, g) for gs in grams for g in gs], np.int64))
            if hit.any():
                count = np.bincount(owner[hit], minlength=len(left))
                total = np.stack([np.bincount(owner[hit], weights=scores[hit, k], minlength=len(left)) for k in range(len(self.languages))], axis=1)
                some = count > 0
                out[left[some]] = total[some] / count[some, None]
                left = left[~some]
        return out


def fit(labelled: DataFrame, per_language: int = 5000, order: int = 4, smooth: float = 0.5) -> Model:
    """Train on ``labelled(doc_id, text, lang, ...)``; rows without text or lang are left out.

    ``smooth``: count added to every key of the language with the largest total, and in proportion to theirs of the others.
    ``per_language``: expected documents sampled of each language (all of them where there are fewer); what the model
    holds is bounded by this sample. Repeated ids are sampled together, rows without id too. No rows give a model without
    languages. The driver holds the distinct labels, the classes of the model.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    labels = sizes.orderBy("lang").collect()
    languages = [r["lang"] for r in labels]
    if not languages:
        return Model([], [], order)
    share = F.create_map(*[F.lit(x) for r in labels for x in (r["lang"], min(1.0, per_language / r["n"]))])[F.col("lang")]
    sample = rows.where(F.pmod(F.col("h"), F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    number = {k: i for i, k in enumerate(languages)}

    def count(batches):
        for langs, texts in byte_slices(batches, "lang", "text"):
            words: Counter = Counter()
            for lang, text in zip(langs, texts):
                words.update((number[lang], w) for w in words_of(text))
            found: Counter = Counter()
            for (lang, word), n in words.items():
                found[hash_of(0, word), 0, lang] += n
                for k in range(1, order + 1):
                    for g in grams_of(word, k):
                        found[hash_of(k, g), k, lang] += n
            if found:
                hashes, kinds, langs_ = zip(*found)
                columns = [pa.array(hashes, pa.int64()), pa.array(kinds, pa.int8()), pa.array(langs_, pa.int32()), pa.array(list(found.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["hash", "kind", "lang", "n"])

    counts = sample.select("lang", "text").mapInArrow(count, "hash long, kind byte, lang int, n long")
    by_key = counts.groupBy("hash", "kind").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(len(languages))])
    by_key = cut(by_key, "language-counts")  # read for the totals of each order, then for the scores
    totals = {r["kind"]: r for r in by_key.groupBy("kind").agg(F.count("*").alias("keys"), *[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(languages))]).collect()}
    sums = {kind: np.array([r[f"n{k}"] for k in range(len(languages))], np.float64) for kind, r in totals.items()}
    # in proportion to a language's total, so that a key which it lacks weighs the same in every language
    added = {kind: smooth * n / max(n.max(), 1) for kind, n in sums.items()}
    base = {kind: n + added[kind] * (totals[kind]["keys"] + 1) for kind, n in sums.items()}

    def files(batches):  # one file a partition of about FILE_ROWS keys
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            hashes, kinds = table.column("hash").to_numpy(), table.column("kind").to_numpy()
            n = np.stack([table.column(f"n{k}").to_numpy() for k in range(len(languages))], axis=1).astype(np.float64)
            scores = np.zeros(n.shape, "<f4")
            for kind, below in base.items():
                scores[kinds == kind] = np.log(np.maximum(n[kinds == kind] + added[kind], 1e-9) / np.maximum(below, 1e-9))
            yield pa.RecordBatch.from_arrays([pa.array([pack(int(hashes[0]), hash=hashes, scores=scores)], pa.binary())], names=["blob"])

    parts = max(1, -(-sum(r["keys"] for r in totals.values()) // FILE_ROWS))
    blobs = by_key.repartitionByRange(parts, "hash").sortWithinPartitions("hash").mapInArrow(files, "blob binary")
    return Model(languages, written(blobs, shared_dir(spark, "language-model")), order, uuid.uuid4().hex)


class _Index(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Scorer:
    """The mapped model and the scores of words seen lately."""

    def __init__(self, model: Model):
        self.model, self.arrays, self.memo = model, model.open(), {}

    def matrix(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.memo]
        fresh = dict(zip(new, self.model.rows(self.arrays, new))) if new else {}
        out = np.stack([fresh[w] if w in fresh else self.memo[w] for w in words])
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
        self.memo.update((w, r) for w, r in fresh.items() if len(w) <= 64)
        return out

    def predicted(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text."""
        index = _Index()
        found = [np.fromiter(map(index.__getitem__, words_of(t)), np.int64) for t in texts]
        matrix = self.matrix(list(index)) if index and self.model.languages else None
        names, scores = [], []
        for ids in found:
            if matrix is None or not len(ids):
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = matrix[ids].sum(axis=0)
            best = int(total.argmax())
            names.append(self.model.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return names, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred string, score double`` for each row of ``docs(doc_id, text, ...)``; nothing else is read.

    Texts that are null or have no letter, and all texts under a model without languages, give ``und`` and 0. Ties go to
    the language that sorts first. Rows with null or repeated ids are predicted like any other.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema[0].dataType)

    def run(batches):
        with kept(("language", model.name), lambda: _Scorer(model)) as scorer:
            for keys, texts in byte_slices(batches, "doc_id", "text", rows=512):
                names, scores = scorer.predicted(texts)
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def identified(docs: DataFrame, model: Model, least: float | None = None) -> DataFrame:
    """``docs(text, ...)`` without those that language identification rejects: no letters, or a score below ``least``, by
    default 1.2 times what an even split over the model's languages gives, so that short texts are not taken for junk.

    Each row is judged alone in one narrow stage, so ids may be null or repeated, and ``docs`` keeps its columns, whatever
    their names. Null and empty texts go; a model without languages keeps nothing.
    """
    bound = 1.2 / max(2, len(model.languages)) if least is None else least

    def run(batches):
        with kept(("language", model.name), lambda: _Scorer(model)) as scorer:
            for batch in batches:
                good: list[bool] = []
                for (texts,) in byte_slices([batch], "text", rows=512):
                    good += [name != UNKNOWN and score >= bound for name, score in zip(*scorer.predicted(texts))]
                yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
