"""Substring deduplication by hashing lines and paragraphs, and passages inside them.

Units are normalised (lower-cased words) and hashed to 128 bits: every line, and every paragraph (lines up to an empty
one), of ``least`` words or more. Lines are never cut, so one goes as a whole or stays as a whole.

A passage that begins and ends inside lines is no unit. With ``passage`` set, fragments of ``k = (passage + 1) // 2``
words are hashed as well, on the text's stream of words whatever its lines: of each ``passage - k + 1`` neighbouring
fragments the one of the smallest rolling hash. Which fragment that is depends on these words only, and every run of
``passage`` words holds such a group, so no repeated passage of that length is missed, while a fragment is hashed for
every seventh or so of a line's words. What a document shares in fewer than ``k`` words beyond whole units stays.

Digests are grouped globally with map-side minima; of equal ones that of the smallest doc_id stays, within a document
the first. Only digests of more than one document are joined back, and Spark splits the join of a hot digest, so no
group of equal units meets in one task. Spans are gathered per document and joined to the texts once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, byte_slices, cut, discard

WORD = re.compile(r"\S+")
KEYS = ["doc_id", "text_key"]
UNITS = "doc_id long, text_key long, start int, end int, half long, rest long, again boolean"


class _Hashes(TwoGenerations):
    def make(self, word):
        return xxhash.xxh3_64_intdigest(word)


def lines_of(text: str, least: int) -> list[tuple[int, int, str]]:
    """``(start, end, lower-cased words)`` of the lines and of the paragraphs of several lines, with ``least`` words or
    more. Spans of lines go to behind their newline, so nothing is left of a line that goes."""
    out, at, first, held, count = [], 0, 0, [], 0

    def close(end: int) -> None:
        if len(held) > 1 and count >= least:
            out.append((first, end, "\n".join(held)))

    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        words = line.lower().split()
        if words:
            first = first if held else at
            held.append(" ".join(words))
            count += len(words)
            if len(words) >= least:
                out.append((at, end, held[-1]))
        elif held:
            close(at)
            held, count = [], 0
        at = end
    close(at)
    return out


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of each ``size`` neighbours."""
    width = 1
    while width < size:
        step = min(width, size - width)
        values = np.minimum(values[:-step], values[step:])
        width += step
    return values


def fragments_of(words: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray]:
    """First words, ascending, of the chosen fragments among the words' hashes, and the fragments' rolling hashes."""
    k = (passage + 1) // 2
    group = passage - k + 1
    n = len(words) - k + 1
    if n < group:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # the hash of k words from those of 1, 2, 4, ... words: a polynomial modulo 2**64
    base, grams, width = np.uint64(0x9E3779B97F4A7C15), None, 0
    power, block, size = base, words, 1
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            grams = block.copy() if grams is None else grams[: len(block) - width] * power + block[width:]
            width += size
        block = block[: len(block) - size] * power + block[size:]
        power, size = power * power, size * 2
    grams = (grams[:n] ^ (grams[:n] >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    least = sliding_least(grams, group)
    edge = np.zeros(group - 1, np.uint64)
    highest = np.concatenate([edge, least, edge])
    at = ~sliding_least(~highest, group) == grams  # the smallest of some group that it is in
    places = np.flatnonzero(at)
    return places, grams[places]


def units(docs: DataFrame, least: int, passage: int | None) -> DataFrame:
    """``UNITS`` of the texts of ``docs(doc_id, text_key, text)``. ``again`` marks units that the document has had before;
    of fragments those that overlap the first one like them are left out, for else nothing of it might stay."""

    def run(batches):
        hashes = _Hashes(1 << 18)
        with np.errstate(over="ignore"):
            for keys, marks, texts in byte_slices(batches, *KEYS, "text", rows=256):
                rows, digests = [], []
                for key, mark, text in zip(keys, marks, texts):
                    seen: dict[bytes, int] = {}
                    parts = [(a, b, xxhash.xxh3_128_digest(w)) for a, b, w in lines_of(text or "", least)]
                    if passage:
                        spots = [m.span() for m in WORD.finditer(text or "")]
                        if len(spots) >= passage:
                            words = np.fromiter(map(hashes.__getitem__, text.lower().split()), np.uint64, len(spots))
                            k = (passage + 1) // 2
                            places, grams = fragments_of(words, passage)
                            raw = words.tobytes()
                            second = [xxhash.xxh3_64_digest(raw[8 * p : 8 * (p + k)]) for p in places.tolist()]
                            parts += [(spots[p][0], spots[p + k - 1][1], g + s) for p, g, s in zip(places.tolist(), map(bytes, grams.view("V8")), second)]
                    for start, end, digest in parts:
                        upto = seen.setdefault(digest, end)
                        if upto == end or start >= upto:
                            rows.append((key, mark, start, end, upto != end))
                            digests.append(digest)
                if rows:
                    ids, marks_, starts, ends, again = zip(*rows)
                    halves = np.frombuffer(b"".join(digests), np.int64)
                    columns = [pa.array(ids, pa.int64()), pa.array(marks_, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(halves[::2]), pa.array(halves[1::2]), pa.array(again, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, names=[*KEYS, "start", "end", "half", "rest", "again"])

    return docs.mapInArrow(run, UNITS)


def repeats(found: DataFrame) -> DataFrame:
    """Of the written ``found`` (``UNITS``) those that go: ``doc_id, text_key, start int, end int, first_doc long``, the
    smallest document with one like it (null if no such document has an id)."""
    fresh = found.where("not again").drop("again")
    key = F.when(F.col("doc_id").isNull(), F.col("text_key"))
    groups = fresh.groupBy("half", "rest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.min(key).alias("first_key"))
    groups = groups.where("n > 1").select(F.col("half").alias("g_half"), F.col("rest").alias("g_rest"), "first_doc", "first_key")
    later = F.when(F.col("first_doc").isNotNull(), ~F.col("doc_id").eqNullSafe(F.col("first_doc"))).otherwise(F.col("text_key") != F.col("first_key"))
    gone = fresh.join(groups.hint("merge"), (F.col("half") == F.col("g_half")) & (F.col("rest") == F.col("g_rest"))).where(later)
    names = "doc_id", "text_key", "start", "end"
    return gone.select(*names, "first_doc").unionAll(found.where("again").select(*names, F.col("doc_id").alias("first_doc")))


def joined_spans(gone: list[dict]) -> list[dict]:
    """Ascending spans without overlap of ``gone``, ascending; those that meet and have the same first document are one."""
    out, at = [], 0
    for g in gone:
        start, end = max(at, g["start"]), g["end"]
        if start < end:
            if out and out[-1]["end"] == start and out[-1]["first_doc"] == g["first_doc"]:
                out[-1]["end"] = end
            else:
                out.append({"start": start, "end": end, "first_doc": g["first_doc"]})
            at = end
    return out


def deduplicated(docs: DataFrame, least: int = 8, passage: int | None = None) -> DataFrame:
    """``doc_id, changed boolean, n_removed long, removed_words long, spans, text`` for each row of ``docs(doc_id, text, ...)``.

    ``spans array<struct<start, end, first_doc>>`` are what is removed, in characters of the original text, ascending and
    without overlap, each with the earliest document that has it; ``text`` is what is left. Without ``passage`` only whole
    lines and paragraphs go; with it, of every repeated run of so many words or more at least half of ``passage`` goes,
    and all but less than that at either end. Null texts stay null and empty ones empty, without spans. Rows of one id are
    one document: units that it keeps stay in each of its rows. Rows without id rank behind all others, among themselves by
    a hash of the text; those of equal text are one document. Other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    found = cut(units(rows, least, passage), "substring-units")
    gone = cut(repeats(found), "substring-repeats")
    discard(found)
    gone = gone.groupBy(F.col("doc_id").alias("g_doc"), F.col("text_key").alias("g_key")).agg(F.array_sort(F.collect_set(F.struct("start", "end", "first_doc"))).alias("gone"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("g_doc")) & (F.col("text_key") == F.col("g_key")), "left")

    def run(batches):
        for batch in batches:
            out, spans, removed = [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone")):
                text, at, parts, n, held = text.as_py(), 0, [], 0, []
                if text is not None and gone.is_valid:
                    held = joined_spans(gone.as_py())
                    for g in held:
                        parts.append(text[at : g["start"]])
                        at = g["end"]
                        n += len(text[g["start"] : at].split())
                    text = "".join(parts) + text[at:]
                out.append(text)
                spans.append(held)
                removed.append(n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(removed, pa.int64()), pa.array(spans, batch.schema.field("gone").type), pa.array(out, pa.string())], names=["doc_id", "removed_words", "spans", "text"])

    schema = "doc_id long, removed_words long, spans array<struct<start: int, end: int, first_doc: long>>, text string"
    done = joined.select("doc_id", "gone", "text").mapInArrow(run, schema)
    size = F.size("spans").cast("long")
    return done.select("doc_id", (size > 0).alias("changed"), size.alias("n_removed"), "removed_words", "spans", "text")
