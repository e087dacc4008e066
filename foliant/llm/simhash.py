"""SimHash near-duplicates by bit-sliced comparison (operator 8).

Fingerprint: lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, 3-word shingles with
repeats (fewer words: the whole sequence; none: fingerprint zero), XXH64 with
seed 42 of the space-joined shingle; a bit is 1 if it is set in over half of
the hashes. Two fingerprints link at ``radius`` (2) or fewer differing bits.

Links are searched over *distinct* fingerprints, so exact copies cost nothing.
With radius 2, two linked fingerprints agree on one of three blocks of bits;
each fingerprint goes to its three blocks' buckets. In a bucket the bit planes
are stored vertically, 64 fingerprints to a machine word: the distance of one
fingerprint to 64 others is updated by two carry-save bitwise operations a
plane, and a block of columns is abandoned once all its distances exceed the
radius. A bucket over ``bucket_rows`` isn't compared: its rows take a second
key, the remaining bits cut in three again (still exact, by the same argument),
and where that is too full as well, the rows are joined on their one-bit flips
(two fingerprints at two or fewer bits share one; at most 65 rows share a flip).
No pair is lost at any size, and no task holds more than one bounded bucket.

A bucket emits each linked fingerprint with the smallest one it reaches there, not
pairs. Components are then found in one task where the edges fit in it (at most
``TASK_EDGES``), else by minimum labels with pointer jumping over written tables:
a round is a dozen jobs, and each leaves threads and memory in the driver.

Defined results: null text counts as empty (fingerprint zero); documents with a
repeated doc_id each get a row; one without a doc_id gets its group's smallest, null if there is none; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import HOT_SHARE, discard, hot_keys, materialise, spare_name, spread_join, tasks_for, text_of, write
from foliant.llm.words import Words, chunks, texts_of

#: Bits of the three blocks, most significant first.
BLOCKS = (22, 21, 21)
#: Bytes of text whose shingles are hashed at once: each takes some hundred bytes of memory.
CHUNK = 1 << 18
#: The most fingerprints that are compared in one bucket.
BUCKET_ROWS = 4096
#: The most edges (16 bytes each) whose components are found in one task.
TASK_EDGES = 1 << 18
RADIUS = 2


def fingerprints_of(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints of the texts."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for first, last in chunks(texts, CHUNK):
        part = texts[first:last]
        words = Words(part, lower=True)
        digests: list[bytes] = []
        sizes = np.zeros(len(part), dtype=np.int64)
        digest = xxhash.xxh64_digest
        for k, n in enumerate(words.counts.tolist()):
            if not n:
                continue
            at = int(words.first[k])
            lengths = words.ends[at : at + n] - words.starts[at : at + n]
            ends = np.cumsum(lengths + 1) - 1
            starts = ends - lengths
            joined = b" ".join(words.data[words.starts[at] : words.ends[at + n - 1]].split())
            sizes[k] = max(1, n - shingle + 1)
            digests += [digest(joined[s:e], 42) for s, e in zip(starts[: sizes[k]].tolist(), ends[min(shingle, n) - 1 :].tolist(), strict=True)]
        full = np.flatnonzero(sizes)
        if not len(full):
            continue
        bits = np.unpackbits(np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 8), axis=1)
        offsets = np.concatenate([[0], np.cumsum(sizes[full])])
        ones = np.stack([bits[a:b].sum(axis=0, dtype=np.int64) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
        majority = (2 * ones > sizes[full][:, None]).astype(np.uint8)
        out[first + full] = np.packbits(majority, axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(texts_of(batch), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return text_of(docs).mapInArrow(run, "doc_id long, fp long")


def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 rows, one a bit; in each, 64 fingerprints to a word."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    short = -len(values) % 64
    bits = np.pad(bits, ((0, short), (0, 0)))
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def pairs_within(planes: np.ndarray, values: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, other) at two or fewer bits, a query's index at most the other's.

    An item is a query against one word of 64 columns. ``one`` and ``two`` are a
    two-bit carry-save counter of its 64 distances at once, ``over`` marks
    those beyond two; items whose lanes are all over are abandoned every eight
    planes. Planes on which all values agree are left out.
    """
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    asked = values[queries]
    differ = np.bitwise_or.reduce(values ^ values[0])
    words = planes.shape[1]
    q = np.repeat(queries, words - queries // 64)
    w = np.concatenate([np.arange(k // 64, words) for k in queries.tolist()])
    value = np.repeat(asked, words - queries // 64)
    one = np.zeros(len(q), dtype=np.uint64)
    two, over = one.copy(), one.copy()
    used = [k for k in range(64) if int(differ) >> (63 - k) & 1]
    for k, plane in enumerate(used):
        # 0 - bit is a word of 64 equal bits: the query's bit in every lane.
        x = planes[plane, w] ^ (np.uint64(0) - (value >> np.uint64(63 - plane) & np.uint64(1)))
        carry = one & x
        one ^= x
        over |= two & carry
        two |= carry
        over |= two & one
        if k % 8 == 7:
            keep = over != full
            if not keep.all():
                q, w, value, one, two, over = (part[keep] for part in (q, w, value, one, two, over))
    for first in range(0, len(q), 16_384):
        lanes = np.unpackbits((~over[first : first + 16_384]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        item, lane = np.nonzero(lanes)
        other = w[first + item] * 64 + lane
        mine = q[first + item]
        fits = (other < len(values)) & (other > mine)
        yield mine[fits], other[fits]


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The roots once the edges (a, b) of indices are added; a root is its component's first index."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def bucket_roots(values: np.ndarray) -> np.ndarray:
    """For each of some distinct fingerprints, the index of its component's first one."""
    n = len(values)
    planes, root = bit_planes(values), np.arange(n)
    step = max(1, 65_536 // planes.shape[1])
    for first in range(0, n, step):
        for a, b in pairs_within(planes, values, np.arange(first, min(n, first + step))):
            root = _unite(root, a, b)
    return root


def _bucket_edges(buckets: DataFrame) -> DataFrame:
    """(bucket, fp) to edges (a, b): each fingerprint that links to a smaller one there.

    A partition is sorted by bucket and read in batches; a task holds one batch
    and the bucket that runs on into the next.
    """

    def edges_of(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        out: list[np.ndarray] = []
        for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if last - first > 1:
                values = np.unique(fp[first:last])
                root = bucket_roots(values)
                linked = root != np.arange(len(values))
                if linked.any():
                    out.append(np.stack([values[linked], values[root[linked]]]))
        found = np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for batch in batches:
            bucket = np.concatenate([bucket, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(bucket == bucket[-1], True)) if len(bucket) else 0
            yield edges_of(bucket[:cut], fp[:cut])
            bucket, fp = bucket[cut:], fp[cut:]
        yield edges_of(bucket, fp)

    tasks = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    return buckets.select("bucket", "fp").repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


def _key(block: int, sub: int | None, blocks: tuple[int, ...] = BLOCKS) -> Column:
    """A bucket's key: which block (and which third of the other bits) and its
    value, hashed. Buckets whose keys collide are compared together, which
    changes no link."""
    low = 64 - sum(blocks[: block + 1])
    mask = ((1 << blocks[block]) - 1) << low
    if sub is not None:
        others = [k for k in range(63, -1, -1) if not mask >> k & 1]
        mask |= sum(1 << k for k in others[sub * len(others) // 3 : (sub + 1) * len(others) // 3])
    signed = mask - (1 << 64) if mask >> 63 else mask
    return F.xxhash64(F.lit(3 * block + (sub or 0) + (0 if sub is None else 9)), F.col("fp").bitwiseAND(F.lit(signed)))


def links(distinct: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) that join the fingerprints of each component; ``distinct`` has a column fp."""
    number = distinct.count()
    size = lambda rows: rows.groupBy("bucket").agg(F.count("*").alias("n"))

    def split(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
        """Rows of buckets with two or more and with too many fingerprints; None where no bucket has too many."""
        counted = size(rows).where("n > 1")
        full = materialise(counted, name, rows=3 * number)
        few = rows.join(full.where(F.col("n") <= bucket_rows).select("bucket"), "bucket")
        crowded = full.where(F.col("n") > bucket_rows).select("bucket")
        return few, None if crowded.isEmpty() else rows.join(crowded, "bucket")

    first = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("block"), _key(k, None).alias("bucket")) for k in range(3)])).alias("x")).select("fp", "x.block", "x.bucket")
    if number <= bucket_rows:  # no bucket can have too many
        return _bucket_edges(first).distinct()
    few, many = split(first, "simhash-buckets")
    if many is None:
        return _bucket_edges(few).distinct()
    second = many.select("fp", F.explode(F.array(*[F.when(F.col("block") == b, _key(b, s)) for b in range(3) for s in range(3)])).alias("bucket")).where("bucket IS NOT NULL")
    few2, many2 = split(second, "simhash-subbuckets")
    within = _bucket_edges(few.select("bucket", "fp").union(few2.select("bucket", "fp")))
    if many2 is None:
        return within.distinct()
    flips = many2.select("fp").distinct().select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)))).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("near"))
    least = flips.groupBy("near").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("near", "b")
    by_flip = flips.join(least, "near").where("fp > b").select(F.col("fp").alias("a"), "b")
    return within.unionByName(by_flip).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node it reaches) of every node of the edges (a, b).

    Up to ``TASK_EDGES`` edges are one task's work. Beyond, in each round every node
    takes the smallest label next to it, then its label's label. The tables of a
    round are written to the shared folder. A hub's label goes to its neighbours
    by broadcast, and they meet in a partial minimum.
    """
    spark = edges.sparkSession
    found = materialise(edges.select("a", "b"), "components-found")
    most = 2 * found.count()
    if most <= 2 * TASK_EDGES:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.stack([c.to_numpy() for c in batch.columns]) for batch in batches]
            nodes, ends = np.unique(np.concatenate([np.zeros((2, 0), dtype=np.int64), *held], axis=1), return_inverse=True)
            a, b = ends.reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[_unite(np.arange(len(nodes)), a, b)])], ["node", "root"])

        return materialise(found.coalesce(1).mapInArrow(run, "node long, root long"), "components-labels", rows=most)
    both = materialise(found.union(found.select("b", "a")).distinct(), "components-edges", rows=most)
    path = write(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "components-labels", rows=most)
    hubs = hot_keys(both, "b")
    while True:
        labels = spark.read.parquet(path).select("node", "root")
        seen = spread_join(both, labels.withColumnRenamed("node", "b"), "b", hubs).groupBy("a").agg(F.min("root").alias("seen"))
        near = labels.join(seen, labels["node"] == seen["a"], "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("seen", "root")).alias("near"))
        # A root's own label is its label, so that every label has one; a large component's root is a hot one.
        up = labels.select(F.col("node").alias("near"), F.col("root").alias("far"))
        new = write(spread_join(near, up, "near", hot_keys(labels, "root")).select("node", "old", F.least("near", "far").alias("root")), "components-labels", rows=most)
        discard(spark, path)
        path = new
        labels = spark.read.parquet(path)
        if labels.where("root <> old").isEmpty():
            return labels.select("node", "root")


def near_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fp, fingerprint (hex) and component_id (the smallest doc_id reachable) per document.

    Documents get their component by their fingerprint. Fingerprints with over
    a thousandth of all documents, of which there are under a thousand, are
    broadcast; the others are joined by shuffle, without a hot key.
    """
    fps = materialise(fingerprints(docs), "simhash-fps")
    number = fps.count()
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "simhash-distinct", rows=number)
    roots = components(links(distinct.select("fp"), bucket_rows))
    member = distinct.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least_id")
    linked = member.join(member.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id")
    whole = materialise(distinct.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "least_id").alias("component_id")), "simhash-components", rows=number)
    # Fewer than HOT_SHARE; documents that fit in a bucket fit in a task too, whatever they share.
    hot = [r["fp"] for r in whole.where(F.col("n") * HOT_SHARE > number).select("fp").collect()] if number > bucket_rows else []
    joined = spread_join(fps, whole.select("fp", "component_id"), "fp", hot)
    return joined.coalesce(tasks_for(number)).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The documents of which no linked one has a smaller doc_id; all columns stay.

    ``groups`` has the doc_id of each that stays; where it isn't given, the
    fingerprints' links decide.

    Rows that repeat a doc_id are one document: a single row stays, the first
    by its other columns. Rows without a doc_id can't be told apart and stay.
    """
    if groups is None:
        groups = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    # The key has a name of its own: ids of any type are compared as longs, and other columns may have any name.
    key, row = spare_name(docs, "kept_id"), spare_name(docs, "row_of_id")
    kept = docs.join(groups.select(F.col("doc_id").alias(key)).hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col(key), "left_semi")
    order = [F.col(f"`{c}`").asc_nulls_last() for c in docs.columns if c != "doc_id"]
    one = Window.partitionBy("doc_id").orderBy(*order)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.withColumn(row, F.row_number().over(one)).where(F.col(row) == 1).select(*columns).unionByName(docs.where("doc_id IS NULL").select(*columns))
