"""Token counts of byte-level BPE vocabularies, without producing token ids.

Each pre-token starts as one symbol per UTF-8 byte. A heap holds the mergeable adjacent pairs by (rank, position); the
symbols form a doubly linked list. The lowest pair is popped and merged, its two new neighbours are pushed, until the
heap is empty. The count is the number of initial symbols less the number of merges, so nothing but ranks is looked up.
Long pre-tokens cost n log n. A bounded memo keeps the counts of frequent pre-tokens.

There is no shuffle: one narrow Arrow stage over the scan.
"""

from __future__ import annotations

import functools
import heapq
import json

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TwoGenerations

# The pre-tokenisation pattern of the byte-level vocabularies.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else the next from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def checked(spec: dict) -> dict:
    """``spec`` of a tokenizer file, if it is what these operators take for granted: byte-level BPE with the pattern
    above, no prefix space, no normaliser, merges that are not ignored."""
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    right = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    right = right and not spec.get("normalizer") and model.get("type", "BPE") == "BPE"
    right = right and not any(model.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    if not right:
        raise ValueError("not a plain byte-level BPE tokenizer")
    return spec


class MergeTable:
    """Merge ranks of a tokenizer file: ``pair[left * size + right] -> rank`` and the symbol that a rank makes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        names: dict[str, int] = {}
        number = lambda s: names.setdefault(s, len(names))
        self.first = [number(s) for s in byte_symbols()]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        triples = [(number(a), number(b), number(a + b)) for a, b in merges]
        self.size = len(names)
        self.pair: dict[int, int] = {}
        self.made = [c for _, _, c in triples]
        for rank, (a, b, _) in enumerate(triples):
            self.pair.setdefault(a * self.size + b, rank)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]

    def count(self, word: bytes) -> int:
        """Symbols left of ``word`` after all merges."""
        n = len(word)
        if n < 2:
            return n
        pair, size, made, first = self.pair, self.size, self.made, self.first
        symbol = [first[b] for b in word]
        get = pair.get
        heap = []
        left = symbol[0]
        for i in range(1, n):
            right = symbol[i]
            rank = get(left * size + right)
            if rank is not None:
                heap.append(rank * n + i - 1)
            left = right
        if not heap:
            return n
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges, pop, push = 0, heapq.heappop, heapq.heappush
        while heap:
            rank, i = divmod(pop(heap), n)
            j = after[i]
            if symbol[i] < 0 or j >= n or get(symbol[i] * size + symbol[j]) != rank:
                continue  # one of the two has since been merged away
            merges += 1
            symbol[i] = new = made[rank]
            symbol[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = get(new * size + symbol[k])
                if rank is not None:
                    push(heap, rank * n + i)
            h = before[i]
            if h >= 0:
                rank = get(symbol[h] * size + new)
                if rank is not None:
                    push(heap, rank * n + h)
        return n - merges


@functools.lru_cache(maxsize=2)
def merge_table(path: str) -> MergeTable:
    return MergeTable(path)


class _Counts(TwoGenerations):
    def __init__(self, merges: MergeTable, limit: int):
        super().__init__(limit)
        self.merges = merges

    def make(self, word: str) -> int:
        return self.merges.count(word.encode())


def counter(path: str, memo: int = 500_000):
    """A function from text to its number of tokens; special strings of the file count as one token each."""
    merges = merge_table(path)
    counts, find = _Counts(merges, memo), regex.compile(PRETOKEN).findall
    special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def tokens(text: str | None) -> int:
        if not text:
            return 0
        if special is None or special.search(text) is None:
            return sum(map(counts.__getitem__, find(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(counts.__getitem__, find(p))) for p in parts)

    return tokens


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024, memo: int = 500_000) -> DataFrame:
    """``doc_id, n_bytes long, n_tokens long, over_limit boolean`` for each row of ``docs(doc_id, text, ...)``.

    Null and empty texts have 0 bytes and 0 tokens and are not over the limit. Null ids and repeated rows pass through,
    one result row per input row. Other columns are not read. An empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        tokens = counter(tokenizer_path, memo)
        for batch in batches:
            text = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pc.cast(pc.fill_null(pc.binary_length(text), 0), pa.int64()),
                    pa.array((tokens(x.as_py()) for x in text), pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    out = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
