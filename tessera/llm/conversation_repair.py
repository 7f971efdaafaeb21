"""Repair of conversations: the cheapest edits that make their roles an optional system turn and user/assistant pairs.

Edits are Keep (0, or 3 for a truncated turn), Rerole to user or assistant (3, likewise), Delete (4; blank and repeated
turns have no other edit) and Insert of an empty turn (3). The grammar has four states: nothing yet, after the system
turn, after a user turn, after an assistant turn; in each of them one role can be inserted or given. A backward pass over
the turns computes the cost to go from each state, and with it the ASCII-least edit among those that are tight, one for
each state, which are a turn's policy. A forward walk then follows the policies and rebuilds the turns.

* Equal rows of a turn are one row with a number of copies, aggregated before any row moves. Turns are placed by ranges of
  ``conv_id, turn, role, text``, so a long conversation lies in many partitions, and a row's place is a unique number.
* Of each role and text of a conversation the first place is aggregated. Blank and repeated turns can only be deleted and
  deleting is the least letter, so they leave costs to go as they are and the backward pass has the other turns only.
* The backward pass goes over blocks of ``BLOCK`` places. Of each block it first finds the costs from each state before it
  to each state behind it; of these 16 numbers a block, joined from the last to the first, follow the costs behind every
  block, so blocks of one conversation are independent of each other.
* The walk reads the turns of a conversation in order and keeps nothing but its state, a hash and the audit. A hash of the
  whole repaired text, and one string of all its edits, are asked for, so one task has to see a conversation from its
  beginning to its end; it never holds its texts. A string has less than 2^31 characters, so a conversation has at most
  2^31 edits and 2^15 blocks.

Defined results: null roles and texts are one space; a role that begins with no ``s``, ``u`` or ``a``, or is empty, has no
legal place and is reroled or deleted; null turns come first and are in no gap; rows of one turn go by role and text; a
null ``conv_id`` is a conversation. A conversation of which no row is left has zeros, no edits and the empty text's hash.
Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, cut, discard

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: Places of a conversation that one step of the backward pass goes over.
BLOCK = 1 << 16

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: The state behind a kept role, from the state before it, and the state behind the one role that can be given there.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
GIVEN = (2, 2, 3, 2)
ROLES = ("user", "user", "assistant", "user")
LETTERS = "DIKR"
#: Costs to go behind the last turn: the inserts that complete a pair.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40


def _above(cost: int, least: int) -> int:
    """What ``cost`` is above ``least``; from ``FAR`` no turn or insert leads anywhere."""
    return FAR if cost > FAR // 2 else cost - least


@functools.lru_cache(maxsize=4096)
def back(kind: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], int, int]:
    """Costs to go before a turn from those behind it, as their least and what each is above it, and the turn's policy.

    ``kind`` is the role's first letter, upper case for a truncated turn. A policy has two bits of ``LETTERS`` a state.
    Only differences of ``after`` matter, so few of them occur and the results are remembered.
    """
    low, cut_cost = kind.lower(), CUT * (not kind.islower())
    drop = [DELETE + v for v in after]
    keep = [cut_cost + KEEP + after[KEPT[low][s]] if s in KEPT.get(low, ()) else FAR for s in range(4)]
    give = [cut_cost + REROLE + after[GIVEN[s]] for s in range(4)]
    cost = [min(drop[s], keep[s], give[s], FAR) for s in range(4)]
    cost[2], cost[3] = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    cost[0], cost[1] = min(cost[0], INSERT + cost[2]), min(cost[1], INSERT + cost[2])
    policy = 0
    for s in range(4):
        tight = [c == cost[s] for c in (drop[s], INSERT + cost[GIVEN[s]], keep[s], give[s])]
        policy |= (tight.index(True) if True in tight else 0) << 2 * s
    least = min(cost)
    return tuple(map(_above, cost, [least] * 4)), least, policy


def through(kinds: Iterable[str]) -> list[int]:
    """Of a block's turns, the last first: the costs from each state before it to each state behind it, 4 x 4."""
    columns = [(tuple(0 if s == j else FAR for s in range(4)), 0) for j in range(4)]
    for k in kinds:
        stepped = [back(k, v) for v, _ in columns]
        columns = [(v, total + least) for (v, least, _), (_, total) in zip(stepped, columns, strict=True)]
    return [FAR if v[s] == FAR else v[s] + total for s in range(4) for v, total in columns]


def before(block: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    cost = [min(block[4 * s + j] + after[j] for j in range(4)) for s in range(4)]
    return tuple(map(_above, cost, [min(cost)] * 4))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies long``: the rows with their faults put in, by the checksum of ``conv_id:turn``."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), fault.alias("fault"))
    return rows.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies, kind, at``: different rows in order, ``at`` ascending in each conversation.

    ``kind`` is ``x`` for a blank turn, else the role's first letter or ``o``, in upper case where the text is cut off."""
    order = ["conv_id", "turn", "role", "text"]
    merged = rows.groupBy(*order).agg(F.sum("copies").alias("copies"))
    text, initial = F.rtrim("text", F.lit(SPACES)), F.substring("role", 1, 1)
    role = F.when(initial.isin(*KEPT), initial).otherwise("o")
    kind = F.when(text == "", "x").when(F.right(text, F.lit(1)).isin(".", "!", "?"), role).otherwise(F.upper(role))
    return merged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("kind", kind).withColumn("at", F.monotonically_increasing_id())


def _spread(df: DataFrame, rows_of: Callable[[object, dict], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that ``rows_of`` gives for each ``conv_id`` and row, in batches of some ten thousand."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.int32() if "policy" in names else pa.list_(pa.int64())]
            held: list[tuple] = []
            out = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)  # noqa: B023, E731
            for row in chain.from_iterable(b.to_pylist() for b in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64))):
                held.extend(rows_of(row["conv_id"], row))
                if len(held) >= 10_000:
                    yield out()
                    held.clear()
            if held:
                yield out()

    return df.mapInArrow(run, schema)


def policies(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, at, policy int`` of the turns that are neither blank nor repeated."""
    key = turns.schema["conv_id"].dataType.simpleString()
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    firsts = turns.where("kind <> 'x'").select("conv_id", said.alias("said"), F.struct("at", "kind").alias("first")).groupBy("conv_id", "said").agg(F.min("first").alias("first"))
    number = F.floor(F.col("first.at") / block).alias("block")
    blocks = cut(firsts.groupBy("conv_id", number).agg(F.array_sort(F.collect_list("first")).alias("turns")), "conversation-blocks")

    def pass_through(conv: object, row: dict) -> Iterator[tuple]:
        yield conv, row["block"], through(t["kind"] for t in reversed(row["turns"]))

    def ends(conv: object, row: dict) -> Iterator[tuple]:
        after = END
        for b in reversed(row["blocks"]):
            yield conv, b["block"], list(after)
            after = before(b["costs"], after)

    def decide(conv: object, row: dict) -> Iterator[tuple]:
        after = tuple(row["after"])
        for t in reversed(row["turns"]):
            after, _, policy = back(t["kind"], after)
            yield conv, t["at"], policy

    crossed = _spread(blocks, pass_through, f"conv_id {key}, block long, costs array<long>")
    behind = _spread(crossed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "costs"))).alias("blocks")), ends, f"conv_id {key}, block long, after array<long>")
    b, e = blocks.alias("b"), behind.alias("e")
    joined = b.join(e, F.col("b.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("b.block") == F.col("e.block"))).select("b.conv_id", "b.turns", "e.after")
    chosen = cut(_spread(joined, decide, f"conv_id {key}, at long, policy int"), "conversation-policies")
    discard(blocks)
    return chosen


class Walk:
    """One conversation, turn after turn."""

    def __init__(self, conv: object):
        self.conv, self.state, self.cost, self.audit = conv, 0, 0, []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.high = self.last = None
        self.turns, self.hash, self.join, self.role = 0, hashlib.sha256(), b"", None

    def write(self, role: str, text: str) -> None:
        self.hash.update(self.join + role.encode() + b":")
        self.hash.update(text.encode())
        self.join = b"\n"

    def insert(self) -> None:
        self.write(ROLES[self.state], "")
        self.state, self.cost = GIVEN[self.state], self.cost + INSERT
        self.audit.append("I")

    def take(self, turn: int | None, role: str, kind: str, copies: int, policy: int | None, text: str) -> None:
        if turn is not None and turn != self.last:
            self.low, self.high, self.last, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        initial = role[:1]
        self.illegal += (self.role is not None and self.role + initial not in ("su", "ua", "au")) + copies - 1
        self.role = initial
        if kind == "x":
            self.blank += copies
        else:
            self.duplicate += copies - (policy is not None)
        if policy is not None:
            copies -= 1
            while (edit := LETTERS[policy >> 2 * self.state & 3]) == "I":
                self.insert()
            is_cut = not kind.islower()
            self.truncated += is_cut
            if edit == "D":
                self.cost += DELETE
            else:
                kept = edit == "K"
                self.write(role if kept else ROLES[self.state], text)
                self.cost += (KEEP if kept else REROLE) + CUT * is_cut
                self.state = KEPT[kind.lower()][self.state] if kept else GIVEN[self.state]
            self.audit.append(edit)
        self.cost += DELETE * copies
        self.audit.append("D" * copies)

    def ended(self) -> tuple:
        while self.state in (1, 2):
            self.insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(rows: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of ``ids``.

    ``rows`` needs ``conv_id, turn, role, text, copies``, the copies of a row being adjacent; ``ids`` needs ``conv_id``, in
    which every conversation of ``rows`` occurs."""
    key = rows.schema["conv_id"].dataType.simpleString()
    turns = cut(placed(rows), "conversation-turns")
    chosen = policies(turns, block)
    # one shuffle brings a conversation's id, policies and turns together, a policy before its turn
    read = turns.unionByName(chosen, allowMissingColumns=True).unionByName(ids.select("conv_id").distinct(), allowMissingColumns=True)
    columns = ["conv_id", "at", "turn", "role", "kind", "copies", "policy", "text"]
    ordered = read.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "at", F.col("policy").isNull())

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, policy, kind_of_id = None, None, pa.null()
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            conv, *counts, audits, hashes = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(conv, kind_of_id), *[pa.array(c, pa.int64()) for c in counts], pa.array(audits), pa.array(hashes)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            kind_of_id = batch.schema.field("conv_id").type
            for part in byte_slices([batch], *columns):
                for conv, at, turn, role, kind, copies, chosen, text in zip(*part, strict=True):
                    if now is None or conv != now.conv:
                        if now is not None:
                            done.append(now.ended())
                        now = Walk(conv)
                    if chosen is not None:
                        policy = chosen
                    elif at is not None:
                        now.take(turn, role, kind, copies, policy, text)
                        policy = None
                if len(done) >= 1024:
                    yield out()
                    done.clear()
        if now is not None:
            done.append(now.ended())
            yield out()

    return ordered.mapInArrow(walk, f"conv_id {key}, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")
