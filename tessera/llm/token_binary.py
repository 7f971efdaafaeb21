"""Token ids in binary files: frequency-ranked ids, byte-aligned variable-length coding, separate control bytes.

A file holds the ids of consecutive documents in ascending ``doc_id`` order and can be decoded alone. Its ids are
replaced by their frequency rank within the file (rank 0 the most frequent, ties by id), so that most take one byte.
Four ranks share one control byte whose two-bit fields, lowest first, give the number of data bytes less one; the data
bytes follow in a stream of their own. Decoding looks control bytes up in a 256 x 4 table of lengths, so it is all numpy.

Layout, little-endian: ``MAGIC, u32 partition, u32 sequence, u32 documents, u32 distinct ids, u64 ids, u64 data bytes``,
then ``i64 doc_id``, ``u8 doc_id is null`` and ``u32 ids`` for each document, ``u32`` id of each rank, control bytes,
data bytes.

One range shuffle of the texts orders the documents; tokenising, ranking and coding happen behind it in the tasks that
write, and at most ``file_tokens`` ids (or one document) are held for a file. Reading is one pass over the files; only
a row per document and one per file are left for the prefix sums.
"""

from __future__ import annotations

import functools
import json
import os
import string
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import TwoGenerations, arrow_rows, byte_slices, cut, kept, read_blobs, shared_dir, write_blobs
from .token_counts import PRETOKEN, byte_symbols, checked

MAGIC = b"TKV1"
HEAD = struct.Struct("<4sIIIIQQ")
#: LENGTHS[c] are the data byte counts of the four ranks under control byte c.
LENGTHS = ((np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3).astype(np.uint8) + 1


def rank_by_frequency(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ranks of ids, id of each rank)``; the most frequent id has rank 0, ties go to the smaller id."""
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    names = distinct[np.argsort(-counts[distinct], kind="stable")]
    rank = np.zeros(len(counts), np.uint32)
    rank[names] = np.arange(len(names), dtype=np.uint32)
    return rank[ids], names.astype("<u4")


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    used = np.ones((len(values), width), bool)
    code = np.zeros((-(-len(values) // 4), 4), np.uint8)
    for k in range(1, width):
        used[:, k] = values >= 1 << (8 * k)
        code.reshape(-1)[: len(values)] += used[:, k]
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = values.view(np.uint8).reshape(-1, 4)[:, :width][used]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values behind control bytes and data bytes (both ``uint8``)."""
    size = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    starts = ends - size
    padded = np.concatenate([data, np.zeros(4, np.uint8)])
    out = padded[starts].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if len(longer):
            out[longer] |= padded[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_file(partition: int, sequence: int, doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    ranks, names = rank_by_frequency(ids)
    control, data = pack(ranks)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    head = HEAD.pack(MAGIC, partition, sequence, len(keys), len(names), len(ids), len(data))
    return b"".join([head, keys.tobytes(), nulls.tobytes(), np.array(counts, "<u4").tobytes(), names.tobytes(), control, data])


def read_file(content: bytes) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """``(partition, sequence, doc_ids, ids of each document, all ids as <u4)``; bytes behind the last stream are ignored."""
    magic, partition, sequence, n_docs, n_names, n_ids, n_data = HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, n, at)
        at += out.nbytes
        return out

    keys, nulls, counts, names = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs), take("<u4", n_names)
    control, data = take("u1", -(-n_ids // 4)), take("u1", n_data)
    doc_ids = [None if z else int(k) for k, z in zip(keys, nulls)]
    return partition, sequence, doc_ids, counts, names[unpack(control, data, n_ids)] if n_ids else np.empty(0, "<u4")


#: Up to here a letter is a letter in every edition of Unicode.
LATIN = "\u024f"


class _Pieces(TwoGenerations):
    """Memo from a pre-token to the ids that the library's model gives it."""

    def __init__(self, tokenizer, limit: int):
        super().__init__(limit)
        self.model, self.symbols = tokenizer.model, dict(enumerate(byte_symbols()))

    def make(self, piece: str) -> bytes:
        return self.ids(piece.encode().decode("latin-1").translate(self.symbols))

    def ids(self, symbols: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()


class _Chunks(TwoGenerations):
    """Memo from what stands between two spaces to the ids of it with the space before it; 0 where white space at its
    edges would join the spaces around it."""

    def __init__(self, tokenizer, limit: int):
        super().__init__(limit)
        self.pieces, self.find = _Pieces(tokenizer, 20_000), regex.compile(PRETOKEN).findall
        self.space = self.pieces.symbols[32]

    def make(self, chunk: str) -> bytes | int:
        if (ids := self.word(chunk, self.space)) is not None:
            return ids
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return 0
        line, parted, rest = chunk.partition("\n")
        if parted and rest and not rest[0].isspace() and line and not line[-1].isspace():  # a lone line end is a pre-token
            ids, more = self.word(line, self.space), self.word(rest, "")
            if ids is not None and more is not None:
                return ids + self.pieces["\n"] + more
        first, *rest = self.find(" " + chunk)
        return self.pieces.make(first) + b"".join(map(self.pieces.__getitem__, rest))

    def word(self, text: str, lead: str) -> bytes | None:
        """Ids of Latin letters, behind ``lead``, and what punctuation follows them: a pre-token each. None of other texts."""
        if text.isalpha():
            if text.isascii():
                return self.pieces.ids(lead + text)
            return self.pieces.ids(lead + text.encode().decode("latin-1").translate(self.pieces.symbols)) if max(text) <= LATIN else None
        letters = text.rstrip(string.punctuation)
        if not letters.isalpha() or not letters.isascii() and max(letters) > LATIN:
            return None
        return (self if lead else self.pieces)[letters] + self.pieces[text[len(letters) :]]


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encoder(path: str, memo: int = 600_000):
    """A function from a text to its ids as little-endian 32-bit bytes, as the library encodes the whole text.

    A pre-token of byte-level BPE holds a space as its first character only, unless white space touches that space, and
    the model encodes pre-tokens alone. So the chunks between spaces are encoded and memoised one by one, first and last
    chunk apart. Texts where white space touches a space inside, or with one of the file's special strings, go to the
    library whole.
    """
    tokenizer = _tokenizer(path)
    checked(json.loads(tokenizer.to_str()))
    chunks = _Chunks(tokenizer, memo)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    ids = lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or first[-1:].isspace() or rest[-1][:1].isspace() or not rest[-1] or any(s in text for s in special):
            return ids(text)
        last = ids(" " + rest.pop()) if rest[-1][-1:].isspace() else b""  # white space that ends the text stays apart
        try:
            return ids(first) + b"".join(map(chunks.__getitem__, rest)) + last
        except TypeError:  # a 0 among the chunks
            return ids(text)

    return encode


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 0, file_tokens: int = 4 << 20) -> None:
    """Write all texts of ``docs(doc_id, text, ...)`` to ``path``, each document's ids followed by ``end_id`` if given.

    ``doc_id`` is an integer. Null texts are empty. Null ids come first; rows of one id are ordered by a hash of the text and the text, so
    reruns over the same rows give the same stream. Other columns are not read; an empty table writes no token file.
    """
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        with kept(("encoder", tokenizer_path), lambda: encoder(tokenizer_path)) as encode:
            yield from files(batches, TaskContext.get().partitionId(), encode)

    def files(batches, partition, encode):
        sequence = 0
        keys, counts, parts, held = [], [], [], 0

        def flush():
            nonlocal sequence, keys, counts, parts, held
            blob = write_file(partition, sequence, keys, counts, np.frombuffer(b"".join(parts), "<u4"))
            sequence, keys, counts, parts, held = sequence + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["blob"])

        for doc_ids, texts in byte_slices(batches, "doc_id", "text", rows=256):
            for doc_id, text in zip(doc_ids, texts):
                ids = encode(text or "") + end
                if held and held + len(ids) // 4 > file_tokens:
                    yield flush()
                keys.append(doc_id)
                counts.append(len(ids) // 4)
                parts.append(ids)
                held += len(ids) // 4
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = "doc_id", F.xxhash64("text"), "text"  # the hash parts a hot id over several ranges
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    write_blobs(ordered.mapInArrow(run, "blob binary"), "blob", path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row per document from the files: ``doc_id, start long, n_tokens long, ids_crc32 long`` (and ``ids array<int>``).

    ``start`` counts the ids of all documents before it: totals of files are summed within a partition, totals of
    partitions (a row each) by one window.
    """
    columns = "part long, seq long, doc_id long, within long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        for (contents,) in arrow_rows(batches, "content", step=1):
            part, seq, doc_ids, counts, ids = read_file(contents[0])
            n, bounds = len(doc_ids), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            raw = memoryview(ids.tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])]
            for at in range(0, n, 2000):
                to = min(n, at + 2000)
                cols = [
                    pa.array([part] * (to - at), pa.int64()), pa.array([seq] * (to - at), pa.int64()), pa.array(doc_ids[at:to], pa.int64()),
                    pa.array(bounds[at:to]), pa.array(np.diff(bounds[at : to + 1])), pa.array(crcs[at:to], pa.int64()),
                ]
                if with_ids:
                    flat = pa.array(ids[bounds[at] : bounds[to]].astype(np.int32))
                    cols.append(pa.ListArray.from_arrays(pa.array((bounds[at : to + 1] - bounds[at]).astype(np.int32)), flat))
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in columns.split(", ")])

    rows = cut(read_blobs(spark, path).select("content").mapInArrow(run, columns), "token-rows")
    files = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    before = lambda order: F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select(F.col("part").alias("p_part"), before(W.orderBy("part")).alias("part_start"))
    files = files.withColumn("inside", before(W.partitionBy("part").orderBy("seq"))).join(parts, F.col("part") == F.col("p_part"))
    starts = files.select(F.col("part").alias("f_part"), F.col("seq").alias("f_seq"), (F.col("part_start") + F.col("inside")).alias("file_start"))
    joined = rows.join(starts, (F.col("part") == F.col("f_part")) & (F.col("seq") == F.col("f_seq")))
    return joined.select("doc_id", (F.col("file_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, file_tokens: int = 4 << 20) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and return the rows read back from them."""
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    write_token_files(docs, path, tokenizer_path, end_id, file_tokens)
    return read_token_files(spark, path)
