"""Best-fit packing of token pieces into sequences by exact-complement hashing.

How many pieces there are of each length decides a packing, and there are at most ``capacity``
lengths. So the plan is made on the driver from that histogram: an index of the available lengths,
of their pair sums and, through these, of triple sums gives combinations that fill a gap exactly;
each is consumed as often as its counts allow, and what no combination fills takes the best-fitting
(largest) lengths. The plan lists, for ranges of ranks within a length, a sequence and an offset.
Ranks are given out without gathering a length anywhere: each task numbers its own pieces of each
length, and the counts of earlier tasks are added.

Defined results: null text is empty and still has its end id; a text whose ids fit is never cut;
repeated rows are packed each for itself; an empty table packs into nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import batch, prepare
from lodestone.llm.tokens import encode_batches
from lodestone.session import materialize

CAPACITY = 2048


class LengthIndex:
    """Counts of the lengths that are left, and which sums single, pair and triple lengths have."""

    def __init__(self, counts: np.ndarray):
        self.n = counts.astype(np.int64).copy()
        self.size = len(counts)
        self.pairs = np.zeros(2 * self.size, np.int64)  # of each sum: unordered pairs of available lengths
        for a in np.flatnonzero(self.n):
            partners = np.flatnonzero(self.n[: a + 1])
            partners = partners[(partners < a) | (self.n[a] > 1)]
            self.pairs[a + partners] += 1

    def use(self, length: int, times: int) -> None:
        before = self.n[length]
        after = before - times
        if before > 1 >= after:
            self.pairs[2 * length] -= 1
        if after == 0:
            others = np.flatnonzero(self.n)
            self.pairs[length + others[others != length]] -= 1
        self.n[length] = after

    def largest(self, most: int) -> int:
        found = np.flatnonzero(self.n[: most + 1])
        return int(found[-1]) if len(found) else 0

    def pair(self, total: int) -> tuple[int, int] | None:
        if total < 2 or not self.pairs[total]:
            return None
        high = np.arange(min(total - 1, self.size - 1), (total + 1) // 2 - 1, -1)
        ok = (self.n[high] > 0) & (self.n[total - high] > 0) & ((2 * high != total) | (self.n[high] > 1))
        at = np.flatnonzero(ok)
        return (int(high[at[0]]), int(total - high[at[0]])) if len(at) else None

    def exact(self, gap: int) -> tuple[int, ...] | None:
        """Up to three available lengths that sum to ``gap``, the largest first."""
        if gap < self.size and self.n[gap] > 0:
            return (gap,)
        if found := self.pair(gap):
            return found
        first = np.flatnonzero(self.n[: max(gap - 1, 0)])[::-1]
        for a in first[self.pairs[gap - first] > 0].tolist():
            self.n[a] -= 1
            rest = self.pair(gap - a)
            self.n[a] += 1
            if rest:
                return (a, *rest)
        return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) from the number of pieces of each length."""
    index, out = LengthIndex(counts), []
    for length in range(capacity, 0, -1):
        while index.n[length] > 0:
            held, gap = [length], capacity - length
            index.use(length, 1)
            while gap > 0:
                more = index.exact(gap) or ((best,) if (best := index.largest(gap)) else ())
                if not more:
                    break
                for x in more:
                    index.use(x, 1)
                    held.append(x)
                    gap -= x
            kinds = {x: held.count(x) for x in held}
            again = min(index.n[x] // k for x, k in kinds.items())
            for x, k in kinds.items():
                if again:
                    index.use(x, int(again * k))
            out.append((tuple(held), int(again) + 1))
    return out


def _ranges(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length << 40 | first rank, first sequence, offset) of each slot of each pattern, sorted."""
    at: dict[int, int] = {}
    key, sequence, offset, base = [], [], [], 0
    for lengths, times in patterns:
        place = 0
        for x in lengths:
            key.append((x << 40) + at.get(x, 0))
            at[x] = at.get(x, 0) + times
            sequence.append(base)
            offset.append(place)
            place += x
        base += times
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return np.array(key, np.int64)[order], np.array(sequence, np.int64)[order], np.array(offset, np.int64)[order]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with an int column ``length``, 1 to ``capacity``) and ``sequence_id``, ``offset``."""
    spark = pieces.sparkSession
    prepare(spark)
    names = pieces.columns

    def rank(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(length, kind="stable")
            own = length[order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
            inside = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
            nth = np.empty(len(own), np.int64)
            nth[order] = inside + seen[own]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(own), task, np.int32)), pa.array(nth)], names=[*names, "_task", "_nth"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    ranked = materialize(pieces.mapInArrow(rank, f"{kinds}, _task int, _nth long"), "pieces")
    per_task = ranked.groupBy("_task", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    held = spark.sparkContext.broadcast(_ranges(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, sequence, offset = held.value
        want = (length.to_numpy(np.int64) << 40) + rank.to_numpy(np.int64)
        at = np.searchsorted(key, want, "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + want - key[at], "offset": offset[at]})

    placed = ranked.join(bases, ["_task", "length"]).withColumn("_at", place("length", F.col("_nth") + F.col("_base")))
    return placed.select(*names, "_at.sequence_id", "_at.offset")


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of the pieces of each text's ids with ``end_id``.

    A text of more than ``capacity`` ids has full pieces but for its first.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def pieces(batches):
        for part, ids, offs in encode_batches(batches, path, True, end_id):
            total = np.diff(offs)
            n = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            head = total - (n - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            at = offs[row] + start
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield batch(schema, doc_id=part.column("doc_id").take(pa.array(row)), piece=piece.astype(np.int32), start=start, length=length, ids_crc32=crc)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")


def query(docs: DataFrame, path: str) -> DataFrame:
    """The contract's digest: all pieces of all texts, packed."""
    return pack(cut(docs, path))
