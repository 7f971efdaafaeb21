"""Secrets in texts: three stated patterns, and strings whose characters look drawn at random.

A candidate is a maximal run of the characters of a class (``CLASSES``). A window of the class's length slides over it;
Shannon's entropy of the window follows from the counts of its characters, of which each step takes one down and one up.
It is kept as the whole number ``sum of WEIGHT[count]``, with ``WEIGHT[n]`` the rounded ``n log2 n`` in units of 2^-20, so
that no error gathers however long the run and any engine that sums the same numbers decides alike. Windows at or above
the class's bits, and that mix the kinds of characters that the class asks for, are joined where they touch or overlap.

The allow-list (``ALLOWED``) takes back what the windows found, never the patterns' spans: runs that hold a placeholder,
UUIDs, runs along the alphabet or the digits, and paths or dotted names of words.

Defined results: a null or empty text has no spans; ids may be null or repeated, each row stands alone; other columns are
ignored. Spans count code points, ends are exclusive. A text is read whole, by one task, in one pass a pattern; a long run
costs one step a character.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices

#: The stated patterns in their order: kind, pattern, group whose length counts, least length. Fixed values; of all runs
#: of ``[0-9a-f]`` those of 16 or more are the ones that remain.
PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
]
BASE = [kind for kind, *_ in PATTERNS]
#: No text without one of these holds an assignment; looking for them is quicker than the pattern.
NAMED = "passw", "secret", "token", "apikey", "api_key"

#: Kind, characters of the class, window, bits of entropy that a window needs, kinds of characters (small letters, capitals,
#: digits) that it needs. A random window of 24 hex digits has 3.5 bits on average, one of 24 of 64 characters 4.3; words,
#: numbers and names of one case stay below or lack the kinds.
CLASSES = [
    ("hexrun", "0123456789abcdefABCDEF", 24, 3.0, 2),
    ("random", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 4.0, 3),
]
UNIT = 1 << 20
WEIGHT = [0] + [round(n * float(np.log2(n)) * UNIT) for n in range(1, 65)]

#: What windows find and no secret is, searched in the whole run.
ALLOWED = re.compile(
    "|".join(
        [
            r"(?i:example|placeholder|changeme|dummy|sample|xxxx)",
            r"\A[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\Z",
            r"(?i:abcdefghij|0123456789)",
            r"\A(?:[A-Z]?[a-z]*[0-9]{0,4}[/_+-])*[A-Z]?[a-z]*[0-9]{0,4}\Z",
        ]
    )
)


def windows(run: str, size: int, bits: float, kinds: int) -> list[tuple[int, int]]:
    """Spans of ``run`` covered by windows of ``size`` characters with ``bits`` of entropy and ``kinds`` of characters."""
    # entropy is log2(size) - sum / size, in units of UNIT
    most = WEIGHT[size] - round(bits * size * UNIT)
    counts, held, mixed = dict.fromkeys(run, 0), 0, [0, 0, 0, 0]
    kind = {c: 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 for c in counts}
    out: list[tuple[int, int]] = []
    for i, c in enumerate(run):
        n = counts[c]
        held += WEIGHT[n + 1] - WEIGHT[n]
        counts[c] = n + 1
        mixed[kind[c]] += 1
        if i >= size:
            c = run[i - size]
            n = counts[c]
            held -= WEIGHT[n] - WEIGHT[n - 1]
            counts[c] = n - 1
            mixed[kind[c]] -= 1
        if i >= size - 1 and held <= most and (mixed[0] > 0) + (mixed[1] > 0) + (mixed[2] > 0) >= kinds:
            start = i + 1 - size
            if out and out[-1][1] >= start:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


#: Runs as long as the window at least.
_RUNS = [(kind, re.compile(f"[{re.escape(chars)}]{{{size},}}"), size, bits, kinds) for kind, chars, size, bits, kinds in CLASSES]
KINDS = BASE + [kind for kind, *_ in CLASSES]


def spans(text: str) -> list[tuple[int, str, int]]:
    """``start, kind, end`` of all secrets of ``text``, by start, then kind in the order of ``KINDS``."""
    out, low = [], text.lower()
    for k, (kind, pattern, group, least) in enumerate(PATTERNS):
        if kind == "assign" and not any(name in low for name in NAMED):
            continue
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    for k, (_, pattern, size, bits, kinds) in enumerate(_RUNS, len(BASE)):
        for m in pattern.finditer(text):
            if not ALLOWED.search(m[0]):
                out += [(m.start() + a, k, m.start() + b) for a, b in windows(m[0], size, bits, kinds)]
    return [(a, KINDS[k], b) for a, k, b in sorted(out)]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, spans array<struct<kind, start long, end long>>`` of every document, the spans by start and kind."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in byte_slices([batch], "doc_id", "text"):
                found = [[{"kind": k, "start": a, "end": b} for a, k, b in spans(t)] if t else [] for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("doc_id").type), pa.array(found, pa.list_(fields))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: long, end: long>>")
