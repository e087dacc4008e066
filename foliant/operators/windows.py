"""Computations along the order of lines, pages and occurrences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.rolling import bitmap, has_bits, window_hashes
from foliant.functions.text import normalized


def page_ranges(rows: DataFrame, by: list[str], start: str, end: Column) -> DataFrame:
    """Last page of each unit: the next one's first page less one, the end for the last."""
    w = Window.partitionBy(*by).orderBy(start)
    return rows.withColumn("last_page", F.coalesce(F.lead(start).over(w), end) - 1)


def sequence_ids(rows: DataFrame, by: list[str], order: list[str], prefix: str = "CH-") -> DataFrame:
    """Ids with two digits or more in order."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("string")
    return rows.withColumn("id", F.concat(F.lit(prefix), F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)))


def occurrence_numbers(rows: DataFrame, by: list[str], order: list[str], name: str = "occurrence") -> DataFrame:
    """Which one of its equals each row is, from 0."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def extents(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Where a section ends: where the next starts, or at the text's end."""
    return rows.withColumn("stop", F.coalesce(F.lead(start).over(Window.partitionBy(*by).orderBy(start)), F.col(end)))


def outline_extents(rows: DataFrame, by: list[str], pos: str, level: str, end: str, levels: int = 6) -> DataFrame:
    """Where an outline's section ends: at the next heading of its level or above.

    One window pass per level (there are few), instead of a join of ranges.
    """
    after = Window.partitionBy(*by).orderBy(pos).rowsBetween(1, Window.unboundedFollowing)
    nexts = [F.first(F.when(F.col(level) <= k, F.col(pos)), ignorenulls=True).over(after) for k in range(1, levels + 1)]
    return rows.withColumn("stop", F.coalesce(F.element_at(F.array(*nexts), F.least(F.col(level), F.lit(levels)).cast("int")), F.col(end)))


def fence_parity(rows: DataFrame, by: list[str], pos: str, is_fence: Column) -> DataFrame:
    """Whether a line is within a fenced block (fence lines count as outside)."""
    seen = F.sum(is_fence.cast("int")).over(Window.partitionBy(*by).orderBy(pos))
    return rows.withColumn("fenced", (seen % 2 == 1) & ~is_fence)


def neighbours(rows: DataFrame, by: list[str], pos: str, value: str, skip: Column) -> DataFrame:
    """The nearest value before and after each row that isn't skipped."""
    kept = F.when(~skip, F.col(value))
    w = Window.partitionBy(*by).orderBy(pos)
    return rows.withColumn("before", F.last(kept, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(kept, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def nearby(rows: DataFrame, by: list[str], pos: str, value: Column, distance: int = 9) -> Column:
    """The first value that isn't null in this row and the next ones, ``distance`` in all."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(pos).rowsBetween(0, distance - 1))


def broken_ordinals(rows: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """Rows whose ordinal isn't their place from 0."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(ordinal)) - 1
    return rows.withColumn("place", place).where(F.col("place") != F.col(ordinal))


def overlaps(spans: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Spans that are empty or start before the one ahead of them ends."""
    before = F.max(end).over(Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("before", F.coalesce(before, F.lit(0))).where((F.col(start) < F.col("before")) | (F.col(end) <= F.col(start)))


def after_largest_gap(rows: DataFrame, by: list[str], pos: str) -> DataFrame:
    """Of several candidate places of each key, the one behind the largest gap (the first of equals)."""
    w = Window.partitionBy(*by).orderBy(pos)
    gap = rows.withColumn("gap", F.col(pos) - F.coalesce(F.lag(pos).over(w), F.lit(0)))
    return gap.groupBy(*by).agg(F.max_by(pos, F.struct("gap", -F.col(pos))).alias(pos))


def rising(rows: DataFrame, by: list[str], order: str, pos: str, apart: int = 32) -> DataFrame:
    """Rows whose place is at least ``apart`` behind every place before."""
    before = F.max(pos).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_b", before).where(F.col("_b").isNull() | (F.col(pos) - F.col("_b") >= apart)).drop("_b")


#: Bits of the bitmap that documents' windows pass before they are joined.
COPY_BITS = 22
#: Shares that one window's documents are dealt to, so that a passage that very many hold isn't one task's.
COPY_SALTS = 32


def _windows(rows: DataFrame, key: str, text: str, width: int, step: int, least: int, bits: np.ndarray | None) -> DataFrame:
    """key, h and w of each window of normalised texts of ``least`` characters or more, every ``step`` characters; only those on the bitmap, if there is one."""
    held = rows.sparkSession.sparkContext.broadcast(bits) if bits is not None else None
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, h long, w string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hashes, windows = [], [], []
            for k, value in enumerate(batch.column(1).to_pylist()):
                norm = normalized(value or "")
                if len(norm) < least:
                    continue
                h = window_hashes(norm, width)[::step]
                places = np.arange(len(h)) * step
                if held is not None:
                    hit = has_bits(held.value, (h >> np.uint64(64 - COPY_BITS)).astype(np.int64))
                    h, places = h[hit], places[hit]
                h, first = np.unique(h, return_index=True)
                at += [k] * len(h)
                hashes.append(h)
                windows += [norm[p : p + width] for p in places[first].tolist()]
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(flat.view(np.int64)), pa.array(windows, pa.string())], [key, "h", "w"])

    return rows.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def copy_pairs(docs: DataFrame, sources: DataFrame, doc_id: str, source_id: str, text: str = "text", limit: int = 160) -> DataFrame:
    """Pairs whose normalised texts share a window of a source: sampled every half limit there, every place in documents.

    A copy of ``limit`` characters or more holds a whole sampled window, so none
    is missed. Documents' windows are hashed in place (no row per character) and
    pass a bitmap of fixed size made of the sources' hashes; what is left is joined
    by hash and compared. A window that very many documents hold is dealt to
    ``COPY_SALTS`` shares.
    """
    if limit < 64:
        raise ValueError("a limit has 64 characters or more")
    width = limit // 2
    theirs = _windows(sources, source_id, text, width, width, width, None)
    bits = bitmap(theirs, F.shiftrightunsigned("h", 64 - COPY_BITS), COPY_BITS)
    mine = _windows(docs, doc_id, text, width, 1, limit, bits).withColumn("salt", F.pmod(F.xxhash64(doc_id), F.lit(COPY_SALTS)))
    salted = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(COPY_SALTS - 1).cast("long"))))
    return mine.join(salted, ["h", "w", "salt"]).select(doc_id, source_id).distinct()


def labelled(rows: DataFrame, by: list[str], pos: str, label: Column, value: Column) -> DataFrame:
    """The least value (``found``) that stands on the line right behind a label line, per key that has one."""
    behind = F.lead("labelled_value").over(Window.partitionBy(*by).orderBy(pos))
    marked = rows.select(*by, pos, label.alias("is_label"), value.alias("labelled_value")).withColumn("behind", behind)
    return marked.where(F.col("is_label") & F.col("behind").isNotNull()).groupBy(*by).agg(F.min("behind").alias("found"))
