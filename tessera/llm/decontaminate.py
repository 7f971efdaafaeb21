"""Benchmark decontamination with suffix arrays over the training words.

Every task gathers its documents into shards of about ``shard_words`` words and sorts the suffixes of a shard by prefix
doubling (numpy sorts; later rounds only touch suffixes that are still tied). Every suffix of every benchmark item is
then searched at once by narrowing its interval word by word with binary searches, which gives its longest verbatim
match and, at the depth of a window, all places where the window occurs. Words outside the benchmark's vocabulary are
one symbol that matches nothing, so suffixes that start with it are left out of the array; that loses no match.

Documents are never shuffled. The benchmark reaches the tasks in blocks of at most about ``block_bytes`` of text, one
broadcast at a time; with more than one block the documents' hit spans are united by a shuffle of the spans.

A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_slices, cut, texts_as_bytes

#: A-Z become lower case, digits, a-z and all bytes of non-ASCII characters stay, all other bytes separate words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class Benchmark:
    """Items as one array of word numbers (from 1) with a 0 behind each. Items of equal words are one, with all their ids,
    so what they share is found once; ``ids`` has the ids of each, those of one id ascending and null left out."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        same: dict[tuple, list] = {}
        for i, text in sorted(items, key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0)):
            same.setdefault(tuple(words_of(text)), []).append(i)
        parsed = [([i for i in ids if i is not None], words) for words, ids in same.items() if words]
        self.number: dict[bytes, int] = {}
        flat: list[int] = []
        owner: list[int] = []
        for k, (_, words) in enumerate(parsed):
            flat += [self.number.setdefault(w, len(self.number) + 1) for w in words] + [0]
            owner += [k] * (len(words) + 1)
        self.ids = [i for i, _ in parsed]
        self.words = np.array(flat, np.int32)
        self.owner = np.array(owner, np.int32)
        starts = np.concatenate([[0], np.cumsum([len(w) + 1 for _, w in parsed])])[:-1].astype(np.int64)
        self.left = np.concatenate([np.arange(len(w), -1, -1) for _, w in parsed]) if parsed else np.zeros(0, np.int64)
        first = np.zeros(len(self.words), bool)
        first[starts] = True
        # words a window has that starts here, 0 where none starts
        self.window = np.where(self.left >= window, window, np.where(first, self.left, 0))
        self.longest = int(self.left.max(initial=0))


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of all suffixes that start with a word above 0, sorted by at least their first ``depth`` words, as far as
    the first 0 among them."""
    at = np.flatnonzero(words)
    if not len(at):
        return at
    size = len(words)
    rank = np.zeros(size + 1, np.int64)
    rank[:size] = words
    order = np.argsort(words[at], kind="stable")
    array = at[order]
    key = words[array]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(head, np.diff(np.append(head, len(array))))
    rank[array] = group + 1
    tied = np.flatnonzero(np.repeat(np.diff(np.append(head, len(array))) > 1, np.diff(np.append(head, len(array)))))
    step = 1
    while step < depth and len(tied):
        places = array[tied]
        follow = rank[np.minimum(places + step, size)]
        key = group[tied] * np.int64(size + 2) + follow
        order = np.argsort(key)
        key = key[order]
        array[tied] = places[order]
        start = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.flatnonzero(start)
        lengths = np.diff(np.append(heads, len(tied)))
        group[tied] = np.repeat(tied[heads], lengths)
        rank[array[tied]] = group[tied] + 1
        tied = tied[np.repeat(lengths > 1, lengths)]
        step *= 2
    return array


def _bounds(words: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, want: np.ndarray) -> np.ndarray:
    """First index in ``[lo, hi)`` of the array whose word at ``depth`` is at least ``want``; one search per row."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        less = words[np.minimum(array[mid] + depth, len(words) - 1)] < want[open_]
        lo[open_] = np.where(less, mid + 1, lo[open_])
        hi[open_] = np.where(less, hi[open_], mid)
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def search(words: np.ndarray, array: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(longest, where, lo, hi)`` for each benchmark position: words of its longest match, one place of it, and the
    interval of the suffix array that holds all occurrences of the window that starts there (empty if none)."""
    n = len(bench.words)
    longest, where = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    win_lo, win_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    live = np.flatnonzero(bench.words) if len(array) else np.zeros(0, np.int64)
    lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(array), np.int64)
    depth = 0
    while len(live):
        want = bench.words[live + depth]
        a = _bounds(words, array, lo, hi, depth, want)
        b = _bounds(words, array, a, hi, depth, want + 1)
        keep = (a < b) & (want > 0)
        live, lo, hi, depth = live[keep], a[keep], b[keep], depth + 1
        longest[live], where[live] = depth, array[lo]
        whole = bench.window[live] == depth
        win_lo[live[whole]], win_hi[live[whole]] = lo[whole], hi[whole]
    return longest, where, win_lo, win_hi


def shard_hits(docs: list[np.ndarray], bench: Benchmark) -> list[tuple[list[tuple[int, int]], list[int], tuple[int, int, int] | None]]:
    """For each document's word numbers: hit spans, indices of the items with occurring windows, and the longest match
    as (words, item index, first word in the document)."""
    sizes = np.array([len(d) for d in docs], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    words = np.zeros(starts[-1] + 1, np.int32)
    for d, s in zip(docs, starts):
        words[s : s + len(d)] = d
    array = suffix_array(words, bench.longest)
    longest, where, lo, hi = search(words, array, bench)
    out: list = [([], [], None)] * len(docs)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return out
    # occurrences: (place in the shard, place in the benchmark)
    counts = (hi - lo)[found]
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    place = array[np.repeat(lo[found], counts) + inner]
    item_at = np.repeat(found, counts)
    long = bench.window[item_at]
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + long, -1)
    hit = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
    turn = np.flatnonzero(np.diff(hit))
    span_doc = np.searchsorted(starts, turn[::2], side="right") - 1
    # maximal matches: runs of occurrences on one diagonal
    order = np.lexsort((place, place - item_at))
    p, q, w = place[order], item_at[order], long[order]
    fresh = np.concatenate([[True], (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1) | (bench.owner[q[1:]] != bench.owner[q[:-1]])])
    run = np.flatnonzero(fresh)
    last = np.append(run[1:], len(p)) - 1
    run_words, run_place, run_item = p[last] - p[run] + w[last], p[run], bench.owner[q[run]]
    run_doc = np.searchsorted(starts, run_place, side="right") - 1
    best: dict[int, tuple[int, int, int]] = {}
    for k in np.lexsort((run_place, run_item, -run_words, run_doc)):
        best.setdefault(int(run_doc[k]), (int(run_words[k]), int(run_item[k]), int(run_place[k] - starts[run_doc[k]])))
    spans: dict[int, list] = {}
    for d, a, b in zip(span_doc.tolist(), turn[::2].tolist(), turn[1::2].tolist()):
        spans.setdefault(d, []).append((a - int(starts[d]), b - int(starts[d])))
    pairs = np.unique(run_doc * np.int64(len(bench.ids)) + run_item)
    items: dict[int, list] = {}
    for d, i in zip((pairs // len(bench.ids)).tolist(), (pairs % len(bench.ids)).tolist()):
        items.setdefault(d, []).append(i)
    for d in spans:
        out[d] = (spans[d], items[d], best[d])
    return out


_SPANS = "array<struct<start: int, end: int>>"


def _block_hits(docs: DataFrame, bench: Benchmark, shard_words: int, kind: T.DataType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bench)
    keys = [c for c in docs.columns if c != "text"]
    result = T._parse_datatype_string(f"n_words long, spans {_SPANS}, longest_words int, longest_at int")
    n_words, spans, words, at = result.fields
    schema = T.StructType([*(docs.schema[c] for c in keys), n_words, spans, T.StructField("item_ids", T.ArrayType(kind)), words, T.StructField("longest_item", kind), at])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        bench = shared.value
        number, held, rows, total = bench.number.get, [], [], 0

        def flush():
            out = []
            for key, words, (spans, items, best) in zip(rows, held, shard_hits(held, bench)):
                ids = sorted({k for i in items for k in bench.ids[i]})
                longest = (best[0], (bench.ids[best[1]] or [None])[0], best[2]) if best else (0, None, None)
                out.append((*key, len(words), [{"start": a, "end": b} for a, b in spans], ids, *longest))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], names=arrow.names)

        for *found, texts in byte_slices(batches, *keys, "text", rows=256):
            for *key, text in zip(*found, texts):
                words = words_of(text)
                ids = np.fromiter(map(number, words, repeat(0)), np.int32, len(words))
                if held and total + len(ids) > shard_words:
                    yield flush()
                    held, rows, total = [], [], 0
                held.append(ids)
                rows.append(key)
                total += len(ids)
        if held:
            yield flush()

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_words: int = 1 << 20, block_bytes: int = 8 << 20) -> DataFrame:
    """A row for each row of ``docs(doc_id, text, ...)``, from ``benchmark(item_id, text, ...)``:

    ``doc_id, n_words long, spans array<struct<start, end>>`` (word ranges inside any occurrence of a window),
    ``item_ids`` (items with occurring windows, ascending, in an array of the type of ``item_id``, a number or a string),
    ``longest_words, longest_item, longest_at`` (the longest verbatim match of a window or more: its words, item and first
    word in the document; on ties the smallest item, items without id last, then the first place).

    Null and empty texts have no words and no hits, on either side. Items without id mark words and are not listed;
    repeated items count once. Repeated rows and null ids of ``docs`` give a row each. Empty tables are no hits at all.
    """
    kind = benchmark.schema["item_id"].dataType
    items = benchmark.select("item_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).head()["n"]
    blocks = max(1, -(-size // block_bytes))

    def block(k: int) -> Benchmark:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").collect()
        return Benchmark([(r["item_id"], bytes(r["text"])) for r in rows], window)

    if blocks == 1:
        return _block_hits(texts_as_bytes(docs, "doc_id"), block(0), shard_words, kind)
    rows = cut(texts_as_bytes(docs, "doc_id").withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    parts = [cut(_block_hits(rows, block(k), shard_words, kind), "decontaminate-block") for k in range(blocks)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    best = F.min(F.struct((-F.col("longest_words")).alias("less"), F.col("longest_item").isNull().alias("nameless"), F.col("longest_item").alias("item"), F.col("longest_at").alias("at")))
    merged = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), best.alias("b"),
    )
    union = F.expr(
        f"aggregate(s, cast(array() as {_SPANS}), (acc, x) -> case when size(acc) > 0 and element_at(acc, -1).end >= x.start then "
        "concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end)))) "
        "else concat(acc, array(x)) end)"
    )
    return merged.select("doc_id", "n_words", union.alias("spans"), "item_ids", (-F.col("b.less")).alias("longest_words"), F.col("b.item").alias("longest_item"), F.col("b.at").alias("longest_at"))


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """``found`` with ``n_hit long`` and ``contaminated boolean``: some word is hit, and at least one of ``share``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without contaminated documents; rows that share a contaminated row's ``key`` go too, rows without it stay
    unless a row without it is contaminated. So each row is judged alone under a key of rows, as ``common.numbered`` gives.
    ``docs`` keeps its columns, whatever their names."""
    keyed = docs.select(F.col(key).alias("doc_id"), "text")
    bad = judged(contamination(keyed, benchmark, **options)).where("contaminated").select(F.col("doc_id").alias("bad_id"))
    return docs.join(bad, docs[key].eqNullSafe(bad["bad_id"]), "left_anti")
