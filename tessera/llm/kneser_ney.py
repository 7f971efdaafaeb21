"""Interpolated modified Kneser-Ney language model of word bigrams, counted in Spark, memory-mapped by workers.

Words are hashed to 64 bits. The vocabulary is the sorted array of the hashes seen in training; a word's id is its
place in it, so a bigram is exactly ``context id << 32 | word id``. Files in the shared folder hold sorted arrays:

* ``vocabulary``: word hashes, counts and running counts, in ranges of the hash;
* ``bigrams``: keys and counts, in ranges of the key of about equal training mass, so a frequent context spans many;
* ``unigrams``: by id, count, continuation probability and backoff weight, ``SEGMENT`` ids a file.

Tasks pre-aggregate with numpy before each shuffle. Scoring is a narrow stage: a worker maps the files, looks the
distinct words and bigrams of a slice of documents up by binary search, and never loads a file whole; the operating
system keeps the pages in use. Nothing passes through the driver but file names, totals and counts of counts. All of
what is counted grows with the corpus: nothing is pruned.

Lookups are sorted and touch a file only where a key falls into its range; where the shared folder is not mounted on a
worker, those files are fetched one by one on first use (``mapped``). No model is sent to all workers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, byte_slices, cut, read_blobs, shared_dir, texts_as_bytes
from .mapped import Mapped, pack, unpack, written

END = b""  #: the token behind each text; no word is empty
SEGMENT = 1 << 20  #: ids in a unigram file
FILE_ROWS = 1 << 20  #: rows in a vocabulary or bigram file
HELD = 1 << 20  #: tokens that are counted together
SENT = 1 << 16  #: rows of one Arrow batch to Spark


class _Index(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z only, and the white space 0x20, 0x09-0x0D


def hashes_of(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64).view(np.int64)


VOCABULARY = {"hash": "<i8", "count": "<i8", "before": "<i8"}
BIGRAMS = {"key": "<i8", "count": "<i8"}
UNIGRAMS = {"count": "<i8", "again": "<f8", "backoff": "<f8"}


@dataclass
class Model:
    """Files (``mapped.written``) and totals; ``discounts`` are those of bigrams."""

    vocabulary: list[tuple[str, int, int]]
    bigrams: list[tuple[str, int, int]]
    unigrams: list[tuple[str, int, int]]
    tokens: int
    words: int
    texts: int
    discounts: tuple[float, float, float]
    unseen: float  # continuation probability of a word outside the vocabulary

    def open(self) -> tuple[Mapped, Mapped, Mapped]:
        return Mapped(self.vocabulary, VOCABULARY), Mapped(self.bigrams, BIGRAMS), Mapped(self.unigrams, UNIGRAMS)


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """Discounts for counts of 1, 2 and 3 or more, from how many n-grams have counts 1, 2, 3 and 4.

    Where a count of counts is 0 the formula says nothing; half the count is used. Values stay within (0, count]."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else k / 2 for k in (1, 2, 3)]
    return tuple(min(max(d, 0.05), float(k)) for k, d in enumerate(raw, 1))


def slices(batches, keys: list[str]):
    """For slices of documents: the key columns, distinct words, the documents' token numbers (the last is the end), and
    the numbers of tokens of each."""
    for *columns, texts in byte_slices(batches, *keys, "text"):
        index = _Index()
        ids = [np.fromiter(map(index.__getitem__, [*words_of(t), END]), np.int64) for t in texts]
        yield columns, list(index), np.concatenate(ids), np.array([len(i) for i in ids], np.int64)


def _ids(vocabulary: Mapped, words: list[bytes]) -> np.ndarray:
    """Ids of distinct words, -1 for unknown ones."""
    hashes = hashes_of(words)
    order = np.argsort(hashes)
    out = np.empty(len(words), np.int64)
    out[order] = vocabulary.find("hash", hashes[order])
    return out


def _contexts(ids: np.ndarray, lengths: np.ndarray, begin: int) -> np.ndarray:
    """The id before each token; ``begin`` before the first of a text."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(lengths) - lengths] = begin
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """``hash long, n long`` of the tokens of ``texts(text)``."""

    def run(batches):
        hashes, counts, held = [], [], 0
        for _, words, tokens, _ in slices(batches, []):
            hashes.append(hashes_of(words))
            counts.append(np.bincount(tokens, minlength=len(words)))
            held += len(words)
            if held >= HELD:
                yield from sent(_summed(np.concatenate(hashes), np.concatenate(counts), "hash"))
                hashes, counts, held = [], [], 0
        if hashes:
            yield from sent(_summed(np.concatenate(hashes), np.concatenate(counts), "hash"))

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def _summed(keys: np.ndarray, counts: np.ndarray, name: str) -> pa.RecordBatch:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return pa.RecordBatch.from_arrays([pa.array(keys[head]), pa.array(np.add.reduceat(counts, head))], names=[name, "n"])


def sent(batch: pa.RecordBatch):
    """``batch`` in parts, so that the JVM holds few of its bytes at a time."""
    for at in range(0, batch.num_rows, SENT):
        yield batch.slice(at, SENT)


def _sorted_runs(batches, name: str):
    """Sorted distinct keys with summed counts from batches sorted by key, at most about ``FILE_ROWS`` together."""
    keys, counts, held = [], [], 0

    def close(whole: bool):
        k, n = np.concatenate(keys), np.concatenate(counts)
        head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        k, n = k[head], np.add.reduceat(n, head)
        return (k, n) if whole else (k[:-1], n[:-1], k[-1:], n[-1:])  # the last key may go on

    for batch in batches:
        if batch.num_rows:
            keys.append(batch.column(name).to_numpy())
            counts.append(batch.column("n").to_numpy())
            held += batch.num_rows
            if held >= FILE_ROWS:
                k, n, last, rest = close(False)
                if len(k):
                    yield k, n
                keys, counts, held = [last], [rest], 1
    if keys:
        yield close(True)


def fit(docs: DataFrame) -> Model:
    """Train on the texts of ``docs(text, ...)``: null as empty, every row counts. No rows give an empty model."""
    spark = docs.sparkSession
    texts = texts_as_bytes(docs)

    words = cut(count_words(texts), "lm-words")
    totals = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()
    v, tokens = totals["v"], totals["n"]
    if v >= 1 << 31:
        raise ValueError("word ids need more than 31 bits")
    path = shared_dir(spark, "lm-vocabulary")

    def vocabulary_files(batches):
        for k, n in _sorted_runs(batches, "hash"):
            yield pa.RecordBatch.from_arrays([pa.array([pack(int(k[0]), hash=k, count=n, before=np.cumsum(n) - n)], pa.binary())], names=["blob"])

    names = written(words.repartitionByRange("hash").sortWithinPartitions("hash").mapInArrow(vocabulary_files, "blob binary"), path)

    # bigrams, dealt by their place in the training mass
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = words.where(F.col("hash") == int(hashes_of([END])[0])).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head()["n"]

    def bigram_counts(batches):
        vocabulary = Mapped(names, VOCABULARY)
        mass = np.concatenate([[0], np.cumsum([int(p["before"][-1] + p["count"][-1]) for p in map(vocabulary.part, range(len(names)))])])
        held, n = [], 0

        def close():
            key = np.concatenate(held)
            held.clear()
            key.sort()
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            counts, key = np.diff(np.append(head, len(key))), key[head]
            context, word = key >> 32, key & 0xFFFFFFFF
            known = context < v
            at, many = np.full(len(key), float(tokens)), np.full(len(key), float(ends))
            place = context[known]
            part = np.searchsorted(vocabulary.starts, place, side="right") - 1
            at[known] = vocabulary.take("before", place) + mass[part]
            many[known] = vocabulary.take("count", place)
            dealt = np.minimum((at + many * (word / v)) * (parts / (tokens + ends)), parts - 1).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(dealt), pa.array(key), pa.array(counts)], names=["part", "key", "n"])

        for _, found, token, lengths in slices(batches, []):
            ids = _ids(vocabulary, found)[token]
            held.append(_contexts(ids, lengths, v) << 32 | ids)
            n += len(ids)
            if n >= HELD:
                yield from sent(close())
                n = 0
        if n:
            yield from sent(close())

    def bigram_files(batches):
        for k, n in _sorted_runs(batches, "key"):
            yield pa.RecordBatch.from_arrays([pa.array([pack(int(k[0]), key=k, count=n.astype("<i8"))], pa.binary())], names=["blob"])

    path2 = shared_dir(spark, "lm-bigrams")
    dealt = texts.mapInArrow(bigram_counts, "part int, key long, n long").repartitionById(parts, "part")
    bigram_names = written(dealt.sortWithinPartitions("key").select("key", "n").mapInArrow(bigram_files, "blob binary"), path2)

    def contents(batches):
        for (blobs,) in arrow_rows(batches, "content", step=1):
            yield unpack(blobs[0], BIGRAMS).values()

    def continuations(batches):
        for key, _ in contents(batches):
            word, n = np.unique(key & 0xFFFFFFFF, return_counts=True)
            yield from sent(pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["id", "n"]))

    def contexts(batches):
        for key, count in contents(batches):
            context = key >> 32
            head = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            sums = [np.add.reduceat((count == k if k < 5 else count > 2).astype(np.int64), head) for k in (1, 2, 5, 3, 4)]
            yield from sent(pa.RecordBatch.from_arrays([pa.array(context[head]), *map(pa.array, sums)], names=["id", "n1", "n2", "more", "n3", "n4"]))

    files = read_blobs(spark, path2).select("content")
    again = cut(files.mapInArrow(continuations, "id long, n long").groupBy("id").agg(F.sum("n").alias("again")), "lm-again")
    after = files.mapInArrow(contexts, "id long, n1 long, n2 long, more long, n3 long, n4 long").groupBy("id")
    after = cut(after.agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "more", "n3", "n4")]), "lm-after")
    seen = after.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4")]).head()
    d1, d2, d3 = discounts_of([seen["n1"], seen["n2"], seen["n3"], seen["n4"]])
    kinds = again.agg(F.coalesce(F.sum("again"), F.lit(0)).alias("all"), *[F.count(F.when(F.col("again") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count(F.when(F.col("again") > 2, 1)).alias("more")).head()
    e1, e2, e3 = discounts_of([kinds[f"n{k}"] for k in (1, 2, 3, 4)])
    everything = kinds["all"]
    unseen = (e1 * kinds["n1"] + e2 * kinds["n2"] + e3 * kinds["more"]) / everything / (v + 1) if everything else 1.0 / (v + 1)

    numbered = _numbered(spark, names)
    begin = spark.range(v, v + (1 if ends else 0)).select("id", F.lit(ends).cast("long").alias("count"))
    rows = numbered.unionAll(begin).join(again, "id", "left").join(after, "id", "left")
    backoff = (d1 * F.coalesce("n1", F.lit(0)) + d2 * F.coalesce("n2", F.lit(0)) + d3 * F.coalesce("more", F.lit(0))) / F.col("count")
    less = F.when(F.col("again") == 1, e1).when(F.col("again") == 2, e2).otherwise(e3)
    probability = F.coalesce((F.col("again") - less) / F.lit(float(everything or 1)) + F.lit(unseen), F.lit(0.0))
    rows = rows.select("id", "count", probability.alias("again"), backoff.alias("backoff"), (F.col("id") / SEGMENT).cast("int").alias("part"))

    def unigram_files(batches):
        table = [b for b in batches if b.num_rows]
        if table:
            column = lambda c: np.concatenate([b.column(c).to_numpy() for b in table])
            yield pa.RecordBatch.from_arrays([pa.array([pack(int(column("id")[0]), count=column("count"), again=column("again"), backoff=column("backoff"))], pa.binary())], names=["blob"])

    path3 = shared_dir(spark, "lm-unigrams")
    segments = max(1, -(-(v + 1) // SEGMENT))
    unigram_names = written(rows.repartitionById(segments, "part").sortWithinPartitions("id").mapInArrow(unigram_files, "blob binary"), path3)
    return Model(names, bigram_names, unigram_names, tokens, v, ends, (d1, d2, d3), unseen)


def _numbered(spark: SparkSession, names: list[tuple[str, int, int]]) -> DataFrame:
    """``id long, count long`` from the vocabulary's files, a task for each file."""
    if not names:
        return spark.createDataFrame([], "id long, count long")

    def run(batches):
        files = Mapped(names, VOCABULARY)
        for (places,) in arrow_rows(batches, "file"):
            for k in places:
                for at in range(0, int(files.sizes[k]), 100_000):
                    n = np.array(files.part(k)["count"][at : at + 100_000])
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)) + at + files.starts[k]), pa.array(n)], names=["id", "count"])

    return spark.range(0, len(names), 1, len(names)).select(F.col("id").alias("file")).mapInArrow(run, "id long, count long")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double``.

    A row per row of ``docs(doc_id, text, ...)``; null and empty texts are the end token alone. Scores are log10
    probabilities of the whole text; ``base_score`` is that of additively smoothed unigrams. A word outside the vocabulary
    has the share of one unseen word; after such a word, or one never followed by anything, the continuation probability
    is used. Null ids, repeated rows and very long texts are scored like any other.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T._parse_datatype_string("n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double").fields])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema[0].dataType)
    v, n = model.words, model.tokens

    def run(batches):
        vocabulary, bigrams, unigrams = model.open()
        d = np.array([0.0, *model.discounts])
        for (keys,), found, token, lengths in slices(batches, ["doc_id"]):
            own = _ids(vocabulary, found)
            known = own >= 0
            at = np.where(known, own, 0)
            count = np.where(known, unigrams.take("count", at), 0) if v else np.zeros(len(own), np.int64)
            again = np.where(known, unigrams.take("again", at), model.unseen) if v else np.full(len(own), model.unseen)
            backoff = np.where(known, unigrams.take("backoff", at), 1.0) if v else np.ones(len(own))
            ids = own[token]
            starts = np.cumsum(lengths) - lengths
            base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))[token]
            before = _contexts(ids, lengths, v)
            weight = np.ones(len(token))
            weight[1:] = backoff[token[:-1]]
            total = np.zeros(len(token), np.int64)
            total[1:] = count[token[:-1]]
            first = np.zeros(len(token), bool)
            first[starts] = True
            if v:
                begin = unigrams.take("backoff", np.array([v]))[0]
                weight[first], total[first] = begin, model.texts
            probability = weight * again[token]
            both = np.flatnonzero((before >= 0) & (ids >= 0) & (total > 0))
            if len(both):
                distinct, where = np.unique(before[both] << 32 | ids[both], return_inverse=True)
                place = bigrams.find("key", distinct)
                hit = place >= 0
                c = np.zeros(len(distinct))
                if hit.any():
                    c[hit] = bigrams.take("count", place[hit])
                less = c - d[np.minimum(c, 3).astype(int)]
                probability[both] += less[where] / total[both]
            logs = np.log10(probability)
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)
            s = add(logs)
            columns = [
                pa.array(keys, kind), pa.array(lengths), pa.array(add(known[token].astype(np.int64))), pa.array(np.full(len(lengths), n)),
                pa.array(add(base)), pa.array(s), pa.array(10 ** (-s / lengths)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return texts_as_bytes(docs, "doc_id").mapInArrow(run, schema)
