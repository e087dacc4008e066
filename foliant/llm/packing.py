"""Best-fit packing of token sequences by exact-complement hashing (operator 10).

Documents are encoded (an end id added) and cut into pieces of at most
``capacity`` ids. How pieces share sequences depends on their lengths alone, so
the plan is made from the histogram of lengths: at most ``capacity`` counts,
however large the corpus. Lengths are opened longest first. For the gap left,
the plan looks up an exact filling: a single length, a pair from the index of
pair sums, a triple (a length and a pair for the rest), each under the counts
still available; the combination found is used as often as its counts allow.
Where none fills the gap, the largest length that fits goes in (best fit) and
the look-up is repeated for what is left. Every step uses up some length's
count, so the plan has a few thousand patterns at most.

Pieces are then numbered within their length. The numbering is two-level
(ranks within a bucket of documents, and sums over buckets), so a length that a
third of all pieces have doesn't meet in one task. A piece's number and length
give its sequence and offset by binary search in the plan.

Defined results: null text is empty (one piece with the end id alone); repeated
rows are pieces of their own, numbered by checksum; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import materialise, text_of
from foliant.llm.tokens import encode, vocabulary
from foliant.llm.words import texts_of

CAPACITY = 2048


def pieces(docs: DataFrame, path: str | None = None, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece."""
    file = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts_of(batch), file, end), strict=True):
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if k == 1 else pa.int64()) for k, x in enumerate(columns)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Available:
    """Counts of lengths and the look-up of sums under them."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def enough(self, combination: tuple[int, ...]) -> int:
        """How often a combination can be used."""
        return min(int(self.counts[x]) // combination.count(x) for x in set(combination))

    def pair(self, total: int, most: int | None = None) -> tuple[int, int] | None:
        """Two lengths with this sum, the longer one as long as can be (at most ``most``)."""
        top = min(total - 1, total if most is None else most)
        low = -(-total // 2)
        if top < low:
            return None
        a = np.arange(top, low - 1, -1)
        there = (self.counts[a] > 0) & (self.counts[total - a] > 0)
        if total % 2 == 0 and self.counts[low] < 2:
            there[-1] = False
        at = int(there.argmax())
        return (int(a[at]), total - int(a[at])) if there[at] else None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that fill a gap exactly."""
        if self.counts[gap]:
            return (gap,)
        if two := self.pair(gap):
            return two
        for a in np.flatnonzero(self.counts[: gap - 1])[::-1].tolist():
            if 3 * a < gap:
                break
            self.counts[a] -= 1
            two = self.pair(gap - a, a)
            self.counts[a] += 1
            if two:
                return (a, *two)
        return None

    def largest(self, gap: int) -> int:
        """The longest length that fits; 0 if none does."""
        there = np.flatnonzero(self.counts[: gap + 1])
        return int(there[-1]) if len(there) else 0


def plan_of(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) and how many sequences each has.

    ``counts[x]`` pieces have length x; the last index is the capacity.
    """
    capacity = len(counts) - 1
    free = _Available(counts.astype(np.int64).copy())
    plan: list[tuple[tuple[int, ...], int]] = []
    for longest in range(capacity, 0, -1):
        while free.counts[longest]:
            pattern, gap = (longest,), capacity - longest
            free.counts[longest] -= 1  # so that a pattern's own pieces don't count as available
            taken = [longest]
            while gap:
                found = free.fill(gap)
                if not found:
                    best = free.largest(gap)
                    found = (best,) if best else None
                if not found:
                    break
                for x in found:
                    free.counts[x] -= 1
                    taken.append(x)
                gap -= sum(found)
            for x in taken:
                free.counts[x] += 1
            pattern = tuple(taken)
            times = free.enough(pattern)
            for x in pattern:
                free.counts[x] -= times
            plan.append((pattern, times))
    return plan


def slots_of(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, np.ndarray]:
    """Per length: rows (first number, first sequence, offset) for runs of its pieces."""
    used = [0] * (capacity + 1)
    slots: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for x in pattern:
            slots.setdefault(x, []).append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return {x: np.array(rows, dtype=np.int64) for x, rows in slots.items()}


def pack(docs: DataFrame, path: str | None = None, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all documents with sequence_id and offset."""
    spark = docs.sparkSession
    rows = materialise(pieces(docs, path, end, capacity), "packing-pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    slots = slots_of(plan_of(counts), capacity)

    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "bucket", "first")
    inner = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = dealt.withColumn("rank", F.row_number().over(inner) - 1).join(firsts, ["length", "bucket"]).withColumn("number", F.col("first") + F.col("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
            for x in np.unique(length).tolist():
                mine = np.flatnonzero(length == x)
                table = slots[x]
                at = np.searchsorted(table[:, 0], number[mine], side="right") - 1
                sequence[mine] = table[at, 1] + number[mine] - table[at, 0]
                offset[mine] = table[at, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
