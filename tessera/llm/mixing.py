"""Mixing sources to target weights: output shards draw sources multinomially, and slots take blocks by permutations.

The words of a source's documents, in ascending ``doc_id``, form one stream that is cut into blocks of ``block_words``. A
source's target is so many slots, and these shares of all slots are what output shards of ``shard_blocks`` blocks draw by:
a shard takes the whole part of its share of every source, and the rest of its blocks multinomially over the fractional
parts, by a generator seeded with the shard's number, so any shard can be drawn anywhere and reruns agree. What a source
gets is the sum of its draws: its expectation is the target, from which it strays by about the square root of the number of
shards in blocks (drawing all blocks multinomially would stray by the square root of the source's own slots, a tenth of a
small source). Only what would be a fourth pass over a source is not filled.

A source's slots are numbered through the shards in a keyed order. Slot k of a source takes block ``p(k mod blocks)``, where
``p`` is a pseudorandom permutation (a Feistel network) keyed by seed, source and pass over the source. Blocks are joined
with the documents by index; what is taken is counted from the rows of the shards.

Positions in a source's stream are prefix sums over a range partitioning by (source, doc_id, hash of the text): sums within
a partition by one window, sums of partitions by another over a row per partition and source. So neither a hot source nor
a hot id meets in one task. A shard's draw is a row of counts, at most ``shard_blocks`` slots each; the join key is
(source, block), which is even. One row per source is the only thing that meets in one task and in the draws' tasks.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_rows, byte_slices, cut, discard

RUN = 256  #: shards that a task draws at once
WORD = r"[^\x20\x09-\x0D]+"
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
REPEATS = 3  #: most times that a source is taken


def permuted(index: np.ndarray, n: int, key: tuple[int, ...]) -> np.ndarray:
    """A keyed permutation of 0..n-1 at ``index``: a balanced Feistel network over the next even power of two, walked
    until the value is below ``n``."""
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    mask = np.uint64((1 << half) - 1)
    rounds = np.random.SeedSequence(key).generate_state(4, np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in rounds:
            h = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = once(out[far])
    return out.astype(np.int64)


def sources_of(sizes: DataFrame, block_words: int) -> DataFrame:
    """A row per source of ``sizes(source, size)``: ``source, source_no, source_size, target, blocks, slots``.

    The i-th source by code point, null last, weighs 1, 2, 3 in turn. ``level * weight`` is the target before the stop
    at ``REPEATS`` times the source's size. With the sources in order of cap / weight, the level for "the first k are
    at their caps" is what is left of the total per weight left; the right level is the largest of these.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("source_no", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1).withColumn("weight", F.col("source_no") % 3 + 1)
    cap = REPEATS * F.col("source_size")
    order = W.orderBy(cap / F.col("weight"), "source_no")
    capped = F.coalesce(F.sum(cap).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by = by.withColumn("level", (F.sum("source_size").over(everything) - capped) / weights)
    by = by.withColumn("target", F.least(cap.cast("double"), F.max("level").over(everything) * F.col("weight")))
    by = by.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    return by.select("source", "source_no", "source_size", "target", "blocks", F.least(slots, REPEATS * F.col("blocks")).alias("slots"))


def draw(shard: int, size: int, slots: np.ndarray, seed: int) -> np.ndarray:
    """How many of its ``size`` blocks a shard takes of each source: the whole part of its share, and the blocks that are
    left multinomially by the fractional parts."""
    share = size * (slots / slots.sum())
    whole = np.floor(share).astype(np.int64)
    rest, parts = size - int(whole.sum()), share - whole
    return whole + (np.random.default_rng([seed, shard]).multinomial(rest, parts / parts.sum()) if rest else 0)


def draws_of(sources: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """``source_no int, shard long, first long, n long, blocks long``: the slots ``first`` to ``first + n - 1`` of a source
    are in that shard, as its draw says."""
    some = sources.where("slots > 0").select("source_no", F.col("slots").alias("s"))
    row = some.agg(F.array_sort(F.collect_list(F.struct("source_no", "s"))).alias("of"), F.sum("s").alias("total")).where("total > 0")
    runs = row.select("of", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / shard_blocks), F.lit(RUN).cast("long"))).alias("at"))

    def run(batches):
        for of, totals, ats in arrow_rows(batches, "of", "total", "at", step=1):
            number, slots = (np.array([x[k] for x in of[0]], np.int64) for k in ("source_no", "s"))
            for shard in range(ats[0], min(ats[0] + RUN, -(-totals[0] // shard_blocks))):
                n = draw(shard, min(shard_blocks, totals[0] - shard * shard_blocks), slots, seed)
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(number[k].astype(np.int32)), pa.array(np.full(len(k), shard)), pa.array(n[k])], names=["source_no", "shard", "n"])

    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = runs.repartition(parts, "at").mapInArrow(run, "source_no int, shard long, n long")
    order = W.partitionBy("source_no").orderBy(F.xxhash64("source_no", "shard", F.lit(seed)), "shard").rowsBetween(W.unboundedPreceding, -1)
    drawn = drawn.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    of = sources.select(F.col("source_no").alias("d_source"), "blocks")
    placed = drawn.join(of, F.col("source_no") == F.col("d_source"))
    fits = F.least("n", F.greatest(REPEATS * F.col("blocks") - F.col("first"), F.lit(0).cast("long")))
    return placed.withColumn("n", fits).where("n > 0").select("source_no", "shard", "first", "n", "blocks")


def slots_of(sources: DataFrame, shard_blocks: int, seed: int) -> DataFrame:
    """``source_no int, slot long, shard long, block long`` for every slot that the shards have drawn."""
    chunk = 1 << 16
    chunks = draws_of(sources, shard_blocks, seed).withColumn("at", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1, F.lit(chunk).cast("long"))))

    def run(batches):
        for columns in arrow_rows(batches, "source_no", "shard", "blocks", "at", "end"):
            for source, shard, blocks, first, end in zip(*columns):
                slot = np.arange(first, min(first + chunk, end))
                turn, index, block = slot // blocks, slot % blocks, np.empty(len(slot), np.int64)
                for t in np.unique(turn).tolist():
                    block[turn == t] = permuted(index[turn == t], blocks, (seed, source, t))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), source, np.int32)), pa.array(slot), pa.array(np.full(len(slot), shard)), pa.array(block)], names=["source_no", "slot", "shard", "block"])

    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.select("source_no", "shard", "blocks", "at", (F.col("first") + F.col("n")).alias("end"))
    return rows.repartition(parts, "source_no", "shard", "at").mapInArrow(run, "source_no int, slot long, shard long, block long")


def pieces(keys: list[str], sources: DataFrame, rows: DataFrame, block_words: int) -> DataFrame:
    """The words of each block: a row per document and block that it reaches into.

    ``rows(*keys, m_doc, m_mark, source, size)``. Returns ``keys, m_doc, source_no, start, size, source_size, target, block,
    word long`` (first word of the piece in the document), ``words long``. Documents without words have one row of block -1.
    """
    numbered = rows.join(sources.select(F.col("source").alias("s_source"), "source_no", "source_size", "target"), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    within = ["m_doc", "m_mark", "size", *keys]
    ordered = cut(numbered.repartitionByRange("source_no", *within).withColumn("part", F.spark_partition_id()), "mix-ordered")
    inside = W.partitionBy("part", "source_no").orderBy(*within).rowsBetween(W.unboundedPreceding, -1)
    parts = ordered.groupBy("part", "source_no").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source_no").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("part").alias("p_part"), F.col("source_no").alias("p_source"), before.alias("before"))
    placed = ordered.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(parts, (F.col("part") == F.col("p_part")) & (F.col("source_no") == F.col("p_source")))
    placed = placed.withColumn("start", F.col("before") + F.col("within")).withColumn("end", F.col("start") + F.col("size"))
    touched = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))).otherwise(F.array(F.lit(-1).cast("long")))
    cuts = placed.withColumn("block", F.explode(touched))
    low, high = F.greatest("start", F.col("block") * block_words), F.least("end", (F.col("block") + 1) * block_words)
    some = F.col("size") > 0
    return cuts.select(
        *keys, "m_doc", "source", "source_no", "start", "size", "source_size", "target", "block",
        F.when(some, low - F.col("start")).otherwise(0).alias("word"), F.when(some, high - low).otherwise(0).alias("words"),
    )


def planned(docs: DataFrame, keys: list[str], block_words: int, shard_blocks: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``pieces`` of ``docs(doc_id, source, text, *keys)``, and ``slots_of`` its sources."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(*keys, F.col("doc_id").alias("m_doc"), F.xxhash64("text").alias("m_mark"), F.col("source").cast("string").alias("source"), size.alias("size"))
    rows = cut(rows, "mix-sizes")
    sources = cut(sources_of(rows, block_words), "mix-sources")
    cuts = pieces(keys, sources, rows, block_words)
    discard(rows)  # all that is needed of them has been written in order
    return cuts, slots_of(sources, shard_blocks, seed)


def counted(cuts: DataFrame, slots: DataFrame) -> DataFrame:
    """``pieces`` with ``times long``: in how many slots of the shards their block stands."""
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("n")).select(F.col("source_no").alias("t_source"), F.col("block").alias("t_block"), "n")
    # both sides grow with the corpus: never a broadcast, however well they compress
    joined = cuts.hint("merge").join(times, (F.col("source_no") == F.col("t_source")) & (F.col("block") == F.col("t_block")), "left")
    return joined.drop("t_source", "t_block").withColumn("times", F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def mix(docs: DataFrame, block_words: int = 64, shard_blocks: int = 1 << 14, seed: int = 1) -> DataFrame:
    """``doc_id, size long, source_size long, target double, taken long`` for each row of ``docs(doc_id, source, text, ...)``.

    Sources weigh 1, 2, 3 in turn of their code point order (null last) and share the total size; targets stop at three
    times the source's size and the excess is shared again by weight. A source's taken words are what the shards have drawn
    of it, its target but for about the square root of the number of shards in blocks; a document is taken at most three
    times. Null texts have no words, null sources are a source of
    their own; rows of no words are returned with 0 taken; repeated rows are rows of their own, and of rows of equal id
    and text any may stand for the other; an empty table gives an empty result. Other columns are not read.
    """
    found = counted(*planned(docs, [], block_words, shard_blocks, seed))
    key = ["source_no", "start", "m_doc", "size", "source_size", "target"]
    some = found.where("size > 0").groupBy(*key).agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    none = found.where("size = 0").select("m_doc", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return some.select("m_doc", "size", "source_size", "target", "taken").unionAll(none).withColumnRenamed("m_doc", "doc_id")


def _spans(text: str | None) -> tuple[bytes, list[tuple[int, int]]]:
    raw = (text or "").encode()
    return raw, [m.span() for m in WORD_BYTES.finditer(raw)]


def mixed_shards(docs: DataFrame, block_words: int = 64, shard_blocks: int = 1 << 14, seed: int = 1) -> DataFrame:
    """The mixed corpus itself: ``shard long, place long, source string, block long, text string``, a row per slot.

    ``place`` numbers a shard's blocks in a keyed order from 0. A block's text is its documents'
    pieces behind each other, parted by newlines; white space inside pieces stays. No words give no rows.
    """
    rows = cut(docs.select(F.monotonically_increasing_id().alias("mix_row"), "doc_id", "source", F.col("text").cast("string").alias("text")), "mix-rows")
    cuts, slots = planned(rows, ["mix_row"], block_words, shard_blocks, seed)
    plan = cuts.where("words > 0").groupBy("mix_row").agg(F.first("source").alias("p_source"), F.first("source_no").alias("p_number"), F.array_sort(F.collect_list(F.struct("block", "start", "word", "words"))).alias("p_plan"))
    joined = rows.select("mix_row", "text").join(plan, "mix_row").select("p_source", "p_number", "p_plan", "text")

    def run(batches):
        for sources, numbers, plans, texts in byte_slices(batches, "p_source", "p_number", "p_plan", "text"):
            out = []
            for source, number, plan, text in zip(sources, numbers, plans, texts):
                raw, spans = _spans(text)
                out += [(source, number, p["block"], p["start"], raw[spans[p["word"]][0] : spans[p["word"] + p["words"] - 1][1]].decode()) for p in plan]
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["source", "b_source", "b_block", "start", "piece"])

    parts = joined.mapInArrow(run, "source string, b_source int, b_block long, start long, piece string")
    # at most block_words pieces each
    blocks = parts.groupBy("source", "b_source", "b_block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "\n").alias("text"))
    filled = slots.hint("merge").join(blocks, (F.col("source_no") == F.col("b_source")) & (F.col("block") == F.col("b_block")))
    place = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("shard", "source_no", "slot", F.lit(seed)), "source_no", "slot")) - 1
    return filled.select("shard", place.cast("long").alias("place"), "source", "block", "text")


def mixed_documents(docs: DataFrame, block_words: int = 64, shard_blocks: int = 1 << 14, seed: int = 1) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` with each text replaced by the words that the mix takes of it.

    Pieces follow each other in the document's order, a piece taken n times stands n times, pieces are parted by a
    newline; white space inside pieces stays. Documents of which nothing is taken go. ``n_chars``, where ``docs`` has
    it, counts the new text. Other columns stay as they are, whatever their names.
    """
    schema, names = docs.schema, docs.columns
    rows = cut(docs.select(F.monotonically_increasing_id().alias("mix_row"), F.struct(*[docs[f"`{c}`"] for c in names]).alias("row")), "mix-rows")
    cuts, slots = planned(rows.select("mix_row", "row.doc_id", "row.source", "row.text"), ["mix_row"], block_words, shard_blocks, seed)
    found = counted(cuts.where("words > 0"), slots).where("times > 0")
    plan = found.groupBy("mix_row").agg(F.array_sort(F.collect_list(F.struct("word", "words", "times"))).alias("plan"))
    joined = rows.join(plan, "mix_row").select("row", "plan", F.col("row.text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            row, out = batch.column("row"), []
            for text, plan in zip(batch.column("text"), batch.column("plan")):
                raw, spans = _spans(text.as_py())
                out.append(b"\n".join(raw[spans[p["word"]][0] : spans[p["word"] + p["words"] - 1][1]] for p in plan.as_py() for _ in range(p["times"])).decode())
            columns = {n: row.field(k) for k, n in enumerate(names)} | {"text": pa.array(out, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in out], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return joined.mapInArrow(run, schema)
