"""Near-duplicate documents: MinHash with banding, signature verification, exact confirmation, connected components.

Documents are first folded into classes of equal shingle sets. A class has ``bands * rows`` minima of universal hashes
(multiply-add over 32-bit shingle hashes); the signature keeps 16 bits of each. Classes that agree in all rows of a band
share a bucket. With 32 bands of 4 rows a pair of similarity 0.75 shares none with probability 5e-6.

Within a bucket only stars are compared at first: every member with the smallest. Pairs whose signatures say 0.5 or
more (0.75 less six standard errors) are confirmed on the full sets, and the confirmed links are joined into
components. Links that the stars cannot have seen lie between members of one bucket in different components; those
buckets are then compared across components, in blocks, and of the links in a block only those leave a task that join
components which the block has not joined yet. So every component of texts that share buckets is found whole, and no group
is expanded into all its pairs.

Joins with texts and sets are merge joins at every size: their sides grow with the corpus.

Buckets, classes and hubs may be huge: they are aggregated map-side to their smallest member and joined back, and
Spark splits skewed join sides. Components come from alternating large-star and small-star over the links; each round
is written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import TwoGenerations, byte_slices, cut, discard, texts_as_bytes

BLOCK = 512  #: members of a bucket on one side of a block comparison
BLOCK_BYTES = 8 << 20  #: and about the bytes of their sets


class _WordHashes(TwoGenerations):
    def make(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: bytes, size: int, hashes: TwoGenerations) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of ``text``; of all words as one, where there are fewer."""
    words = text.lower().split()  # of bytes: A-Z only, and the white space 0x20, 0x09-0x0D
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(size, n)
    h = mixed(w[: n - k + 1] + np.uint64(k))
    for i in range(1, k):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[i : n - k + 1 + i])
    return np.unique(h)


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 31, bands * rows, dtype=np.int64) * 2 + 1).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, bands * rows, dtype=np.int64).astype(np.uint32)[:, None]

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """16 bits of the minimum of each hash."""
        x = (shingles >> np.uint64(16)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 4096):
            h = self.a * x[None, at : at + 4096]
            h += self.b
            np.minimum(least, h.min(axis=1), out=least)
        return least.astype("<u2")


def features(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id long, n_shingles long, set_key binary, signature binary`` of each row."""

    def run(batches):
        hashes, minhash = _WordHashes(300_000), MinHash(bands, rows)
        for keys, texts in byte_slices(batches, "doc_id", "text", rows=512):
            sets = [shingle_set(t, size, hashes) for t in texts]
            columns = [
                pa.array(keys, pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([minhash.signature(s).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, signature binary")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``node long, shingles binary``: the sorted 64-bit hashes of each row's set."""

    def run(batches):
        hashes = _WordHashes(300_000)
        for keys, texts in byte_slices(batches, "doc_id", "text", rows=128):
            sets = [shingle_set(t, size, hashes).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles binary")


def likely(pairs: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree in at least ``least`` of their minima."""
    a = signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    b = signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb"))

    def run(batches):
        for batch in batches:
            sa, sb = ([np.frombuffer(x, "<u2") for x in batch.column(k).to_pylist()] for k in ("sa", "sb"))
            if sa:
                keep = pa.array((np.stack(sa) == np.stack(sb)).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)

    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` for which 100 * intersection >= percent * union of their full sets."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def run(batches):
        for us, vs, sa, sb in byte_slices(batches, "a", "b", "sa", "sb", rows=256):
            keep = []
            for x, y in zip(sa, sb):
                n, m = len(x) // 8, len(y) // 8
                both = n + m - len(np.unique(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])))
                keep.append(n > 0 and m > 0 and 100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, component``: the smallest node reachable over ``links(a, b)``, for each node that has a link to another.

    Alternates large-star (neighbours above a node point to its smallest neighbour) and small-star (a node and its
    neighbours below it do), until a round changes nothing. A round is two aggregations with map-side minima, each
    joined back to its edges.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def state(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()

    before = state(edges)
    while before["n"]:
        ways = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        least = below.groupBy("u").agg(F.min("v").alias("m"))
        small = below.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(last)
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def across(members: DataFrame, sets: DataFrame, bands: int, percent: int, least: float, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links ``a, b`` that join components inside buckets of ``members(bucket, band, node, component, size)`` that hold several.

    Members outside the bucket's largest component are compared with all members of other components: by signature, then
    on the full sets of ``sets(node, signature, shingles)``. A pair is compared in the first band that it shares. Both
    sides are cut into blocks of about ``block`` members and ``block_bytes`` of sets, and a block of one side meets a block
    of the other in a task of its own, which emits fewer links than it has members.
    """
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("size").alias("mass"))
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.count("*").alias("kinds"), F.max(F.struct("n", "component", "mass")).alias("top")).where("kinds > 1")
    cells = lambda n, mass: F.greatest(F.ceil(n / block), F.ceil(8 * mass / block_bytes)).cast("int")
    buckets = buckets.select(
        "bucket", F.col("top.component").alias("top"), cells(F.col("n"), F.col("mass")).alias("wide"), cells(F.col("n") - F.col("top.n"), F.col("mass") - F.col("top.mass")).alias("high")
    )
    rows = members.join(buckets, "bucket").join(sets.hint("merge"), "node")
    cell = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    names = "bucket", "band", "node", "component", "signature", "shingles"
    few = rows.where("component <> top").select(*names, cell("high").alias("y"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("x"), F.lit(True).alias("few"))
    all_ = rows.select(*names, F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("y"), cell("wide").alias("x"), F.lit(False).alias("few"))

    def compare(table):
        few = np.array(table.column("few").to_pylist(), bool)
        node, part, band = table.column("node").to_numpy(), table.column("component").to_numpy(), table.column("band")[0].as_py()
        signature = np.stack([np.frombuffer(x, "<u2") for x in table.column("signature").to_pylist()])
        shingles = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        rest, a, b = np.flatnonzero(~few), [], []
        names, own_part = np.unique(part, return_inverse=True)
        root = np.arange(len(names))  # of the components that the block has joined, the smallest one

        for i in np.flatnonzero(few):
            equal = signature[rest] == signature[i]
            near = np.flatnonzero((root[own_part[rest]] != root[own_part[i]]) & (equal.mean(axis=1) >= least))
            near = rest[near[equal[near].reshape(len(near), bands, signature.shape[1] // bands).all(axis=2).argmax(axis=1) == band]]
            own = shingles[i]
            for k in near.tolist():
                p, q = root[own_part[i]], root[own_part[k]]
                if p == q:
                    continue
                both = np.count_nonzero(own[np.minimum(np.searchsorted(own, shingles[k]), len(own) - 1)] == shingles[k])
                if 100 * both >= percent * (len(own) + len(shingles[k]) - both):
                    a.append(min(node[i], node[k]))
                    b.append(max(node[i], node[k]))
                    root[root == max(p, q)] = min(p, q)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return few.unionAll(all_).groupBy("bucket", "y", "x").applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """``doc_id, n_shingles long, component_id long, kept boolean`` for each row of ``docs(doc_id, text, ...)``.

    Words are lower-cased (A-Z); sets with 100 * intersection >= ``percent`` * union are linked. ``component_id`` is the
    smallest doc_id reachable over links, ``kept`` says that the row has that id. Null, empty and blank texts have
    empty sets and link with nothing. Rows of one id count as one document. Rows without id follow rows with the same
    set: they get those rows' component (null if no such row has an id) and are kept only if it is null. Other columns
    are not read; an empty table gives an empty result.
    """
    texts = texts_as_bytes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    found = cut(features(texts, size, bands, rows), "near-features")
    classes = found.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size"))
    classes = cut(classes, "near-classes")
    signatures = classes.where("node is not null").select("node", "signature", "size")
    width = 2 * rows
    keys = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("signature", i * width + 1, width)).alias("bucket")) for i in range(bands)])
    placed = signatures.select("node", "size", F.explode(keys).alias("k")).select("node", "size", "k.band", "k.bucket")
    shared = placed.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("bucket", "hub")
    members = cut(placed.join(shared.hint("merge"), "bucket").select("bucket", "band", "node", "size", "hub"), "near-members")
    needed = members.select("node").distinct()
    sets = shingle_sets(texts.join(needed.hint("merge"), texts["doc_id"] == needed["node"], "left_semi"), size)
    sets = cut(sets.join(signatures.select("node", "signature").hint("merge"), "node"), "near-sets")

    error = (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5
    least = percent / 100 - 6 * error
    pairs = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = cut(confirmed(likely(pairs, sets, least), sets, percent), "near-links")
    parts = components(links)
    labelled = members.join(parts, "node", "left").select("bucket", "band", "node", "size", F.coalesce("component", "node").alias("component"))
    more = cut(across(labelled, sets, bands, percent, least), "near-across")
    if more.head(1):
        parts = components(links.unionAll(more))
    discard(members, sets, links, more)
    ids = classes.join(parts, "node", "left").select(F.col("set_key").alias("class_key"), F.coalesce("component", "node").alias("component_id"))
    out = found.join(ids, (F.col("set_key") == F.col("class_key")) & (F.col("n_shingles") > 0), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicated(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One document of each component of ``found``: the rows of ``docs`` whose id names their component, one row per id
    (of several the one with the smallest text). Rows without id have no name to be kept or dropped by, so they stay.
    ``docs`` keeps its columns, whatever their names.
    """
    kept = found.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.where(docs["doc_id"].isNotNull())
    named = named.join(kept, named["doc_id"] == kept["kept_id"], "left_semi")
    place = F.row_number().over(W.partitionBy(named["doc_id"]).orderBy(named["text"]))
    mark = "_".join([*docs.columns, "place"])  # a name that no column has
    one = named.withColumn(mark, place).where(F.col(f"`{mark}`") == 1).drop(mark)
    return one.unionAll(docs.where(docs["doc_id"].isNull()))
