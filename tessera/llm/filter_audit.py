"""Audit of how five document filters interact, over all orders in which they can be applied.

A task scans the Arrow buffer of its texts: every byte has a class by table lookup, prefix sums of the classes taken at
the documents' ends count words, capitals, symbols and code points, and the words of each document are hashed, sorted by
document and hash, and compared byte by byte with their neighbours of equal hash, so the number of distinct words is
exact. Each document leaves the scan as a mask of the filters that it fails, a digest of its text, and its part; the
texts themselves are never shuffled.

Whether a smaller ``doc_id`` has the same text is asked of the digests (SHA-256): the smallest id of each digest is
aggregated, and a document that is not that one fails. The joins have one row for each document id on their right side,
and documents are reduced to counts per part and mask before the orders are formed.

Defined results: a null text is an empty one, which fails A (no words) and may be a copy of another empty text; a null
``lang`` is the part ``''``; a row with null ``doc_id`` has no labels and no smaller id, so it never fails E; of rows that
share id and text none fails E for the other; a document without a label row, or with nulls in it, is neither good nor
toxic, and of several label rows of one id any may say so. Other columns are ignored. Without documents there are no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

FILTERS = "ABCDE"
BIT = {f: 1 << k for k, f in enumerate(FILTERS)}

#: Classes of bytes: part of a word, A-Z, a symbol, the first byte of a code point.
WORD, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8
CLASS = np.array(
    [
        WORD * (b != 0x20 and not 0x09 <= b <= 0x0D) + CAPITAL * (0x41 <= b <= 0x5A) + SYMBOL * (b in b"#$%&*|") + POINT * (b & 0xC0 != 0x80)
        for b in range(256)
    ],
    np.uint8,
)

#: Bytes of one scan; a longer text is one scan of its own. Words up to ``LONG`` bytes are hashed in eights, all at once.
SCAN_BYTES, LONG = 4 << 20, 256


def _eights(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes of ``data`` from each ``at`` as one number, those beyond ``left`` cleared; ``data`` has 8 bytes to spare."""
    windows = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
    return windows[at] & keep


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each word; equal words have equal ones, and whether equal hashes are equal words is asked afterwards."""
    h = size.astype(np.uint64)
    live = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        if at:
            live = live[size[live] > at]
        if not len(live):
            break
        x = (h[live] ^ _eights(data, start[live] + at, size[live] - at)) * np.uint64(0x9E3779B97F4A7C15)
        h[live] = x ^ (x >> np.uint64(29))
    for k in np.flatnonzero(size > LONG):
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : start[k] + size[k]], digest_size=8).digest(), "little")
    return h


def _all_equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which pairs of words of the same size, at ``a`` and ``b``, have the same bytes."""
    same = np.ones(len(a), bool)
    live = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        left = size[live] - at
        same[live] &= _eights(data, a[live] + at, left) == _eights(data, b[live] + at, left)
    for k in np.flatnonzero(size > LONG):
        same[k] = np.array_equal(data[a[k] : a[k] + size[k]], data[b[k] : b[k] + size[k]])
    return same


def distinct_words(data: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, n_docs: int, hashes=_hashes) -> np.ndarray:
    """Distinct words of each document. Words lie at ``start`` with ``size`` bytes, ``doc`` ascending; ``data`` has 8 bytes
    to spare. A document in which two words share a hash is counted word by word."""
    h = hashes(data, start, size)
    order = np.lexsort((h, doc))
    a, b = order[:-1], order[1:]
    twin = (doc[a] == doc[b]) & (h[a] == h[b])
    out = np.bincount(doc, minlength=n_docs) - np.bincount(doc[b[twin]], minlength=n_docs)
    a, b = a[twin], b[twin]
    same = size[a] == size[b]
    same[same] = _all_equal(data, start[a[same]], start[b[same]], size[a[same]])
    for d in np.unique(doc[a[~same]]):
        out[d] = len({bytes(data[s : s + n]) for s, n in zip(start[doc == d], size[doc == d], strict=True)})
    return out


def measured(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of the texts that end at ``ends`` in ``data`` (bytes, with
    8 to spare), the first of which begins at 0."""
    total, begins = int(ends[-1]) if len(ends) else 0, np.concatenate([[0], ends[:-1]]).astype(np.int64)
    kinds = CLASS[data[:total]]
    out = {}
    for name, kind in (("capitals", CAPITAL), ("symbols", SYMBOL), ("points", POINT)):
        sums = np.concatenate([[0], np.cumsum(kinds & kind != 0, dtype=np.int64 if total >> 31 else np.int32)])
        out[name] = (sums[ends] - sums[begins]).astype(np.int64)
    word = kinds & WORD != 0
    # where a byte's state differs from that of the byte before it, or a text begins between two bytes of words
    edge = np.ones(total + 1, bool)
    edge[1:total] = word[1:] != word[:-1]
    edge[begins] = True
    at = np.flatnonzero(edge)
    at, until = at[:-1], at[1:]
    is_word = word[at]
    start, size = at[is_word], (until - at)[is_word]
    doc = np.searchsorted(ends, start, side="right")
    out["words"] = np.bincount(doc, minlength=len(ends))
    out["distinct"] = distinct_words(data, start, size, doc, len(ends))
    return out


def masks(found: dict[str, np.ndarray]) -> np.ndarray:
    """The filters A to D that each text fails."""
    return (
        BIT["A"] * (found["words"] < 200) + BIT["B"] * (100 * found["distinct"] < 50 * found["words"])
        + BIT["C"] * (100 * found["capitals"] > 3 * found["points"]) + BIT["D"] * (found["symbols"] > 0)
    ).astype(np.int32)


def _scans(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows ``i`` to ``j`` of a binary array, their bytes with 8 to spare, and the ends of the texts among these."""
    wide = pa.types.is_large_binary(texts.type)
    _, offsets, content = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    content = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SCAN_BYTES, side="right")) - 1)
        data = np.zeros(offsets[j] - offsets[i] + 8, np.uint8)
        data[:-8] = content[offsets[i] : offsets[j]]
        yield i, j, data, offsets[i + 1 : j + 1] - offsets[i]
        i = j


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask int, digest binary`` of every document, the mask without E."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, ends in _scans(batch.column("text")):
                begins, view = np.concatenate([[0], ends[:-1]]), memoryview(data)
                digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), batch.column("part").slice(i, j - i), pa.array(masks(measured(data, ends))), pa.array(digests, pa.binary())],
                    ["doc_id", "part", "mask", "digest"],
                )

    return rows.mapInArrow(scan, f"doc_id {kind}, part string, mask int, digest binary")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, part, mask int, good boolean, toxic boolean`` of every document, the mask with all five filters."""
    rows = cut(scanned(docs), "filter-masks")
    named, unnamed = rows.where(F.col("doc_id").isNotNull()), rows.where(F.col("doc_id").isNull())
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(one("quality"), one("toxic"))
    joined = named.join(firsts, ["doc_id", "digest"], "left").join(known, "doc_id", "left")
    is_not = F.lit(False)
    full = joined.select(
        "doc_id", "part", (F.col("mask") + F.when(F.col("first"), 0).otherwise(BIT["E"])).alias("mask"),
        F.coalesce("quality", is_not).alias("good"), F.coalesce("toxic", is_not).alias("toxic"),
    )
    return full.unionByName(unnamed.select("doc_id", "part", "mask", is_not.alias("good"), is_not.alias("toxic")))


def counted(failed: DataFrame) -> DataFrame:
    """Documents by part and mask: ``part, mask, n, n_good, n_toxic``, 32 rows a part at most."""
    return failed.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic")
    )


ORDERS = ["".join(p) for p in permutations(FILTERS)]
_BITS = np.array([[BIT[f] for f in order] for order in ORDERS])
_BEFORE = np.cumsum(_BITS, axis=1) - _BITS
NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audited(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Of documents counted by mask (32 numbers each), the columns ``NAMES`` for each of ``ORDERS`` and step."""
    mask = np.arange(1 << len(FILTERS))
    fails, earlier = mask & _BITS[..., None] != 0, mask & _BEFORE[..., None] != 0
    here = fails & ~earlier
    removed = here @ n
    shares = {f: int(removed[_BITS == BIT[f]].sum()) for f in FILTERS}
    return {
        "kept": ~(fails | earlier) @ n,
        "removed": removed,
        "redundant": (fails & earlier) @ n,
        "unique_fails": n[_BITS],
        "good_lost": here @ good,
        "toxic_lost": here @ toxic,
        "shapley": np.array([[shares[f] for f in order] for order in ORDERS]),
    }


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and ``NAMES`` for every part of ``docs``, order of the filters and step of it.

    ``docs`` needs ``doc_id, text, lang``; ``labels`` needs ``doc_id, quality, toxic``.
    """
    by_part = counted(failures(docs, labels)).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "n_good", "n_toxic")).alias("counts"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                table = np.zeros((3, 1 << len(FILTERS)), np.int64)
                for c in counts:
                    table[:, c["mask"]] = c["n"], c["n_good"], c["n_toxic"]
                found = audited(*table)
                columns = [pa.array([part] * len(names), pa.string()), pa.array(names.tolist(), pa.string()), pa.array(steps)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(found[k].ravel()) for k in NAMES], ["part", "filter_order", "step", *NAMES])

    return by_part.mapInArrow(spread, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in NAMES))
