"""Near copies by the exact similarity of their word shingles (the pipeline's near-dedup stage).

Two documents are near copies if the sets of their 5-word shingles have a
Jaccard similarity of ``SIMILARITY`` or more (lower-case A-Z, words
``[^\\x20\\x09-\\x0D]+``; fewer words: the whole sequence is one shingle; none:
all such texts are equal). Operator 8's fingerprints can't tell these: at that
similarity they differ by up to a dozen bits, far beyond what blocks of bits find.

The search is a set join that misses no pair. In any fixed order of shingles,
two sets that are similar enough share one of their first n - ceil(0.8 n) + 1,
so these alone are joined by hash. Shingles that many documents of a sample
hold come last in the order, so passages held by many unrelated texts are
seldom among the first; the order changes the work, never the pairs.

1. documents with the same set are one set from here on;
2. in each shingle's group, every set is compared with the smallest one, its
   centre: by sketches that bound what two sets share, then by the whole sets;
3. groups that still hold sets of different components are put together by
   centre (a family of copies shares many shingles and few centres), and a task
   compares a bucket's sets all at once: first their sketches, which leaves those
   that may be similar to one of another component, then the whole sets of
   these, what two share being a product of the matrix of sets and shingles with
   itself. It returns links between components, never pairs. A bucket of more than
   ``BLOCK_SETS`` sets is cut into blocks, and a task compares two blocks: no task
   holds more, and no pair is left out.

Shingles count as equal if their 64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import fresh_path, hot_keys, materialise, spread_join, temporary, text_of
from foliant.llm.simhash import components
from foliant.llm.words import NO_ID, Words, chunks, ids_of, mix, ngram_hashes, texts_of

SHINGLE = 5
#: The least similarity of near copies, as a fraction.
SIMILARITY = (4, 5)
#: Documents of the sample that tells frequent shingles, how many of them must hold one, and the most that are kept.
SAMPLE_ROWS = 16_384
SAMPLE_COUNT = 4
FREQUENT = 200_000
#: Up to so many first shingles of all sets, no key is hot: the rows of any are few for a task, and need no plans of their own.
FEW_ROWS = 1 << 18
#: Sets, and shingles of sets, of a block that is compared with another one in a task.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, last in chunks(texts):
        words = Words(texts[first:last], lower=True)
        hashes = words.hashes()
        grams = ngram_hashes(hashes, shingle)
        for at, n in zip(words.first.tolist(), words.counts.tolist(), strict=False):
            if n >= shingle:
                yield np.unique(grams[at : at + n - shingle + 1])
            else:
                yield ngram_hashes(hashes[at : at + n], n) if n else np.zeros(1, dtype=np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """One number for a whole set, as a signed long."""
    total = np.add.reduce(mix(shingles ^ np.uint64(0xA54FF53A5F1D36F1)), dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(shingles))], dtype=np.uint64)).view(np.int64)[0])


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each of 2^k buckets, some two to a bucket; empty where a byte can't hold a count."""
    size = max(16, 1 << (len(shingles) // 2).bit_length())
    counts = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def may_be_similar(x: bytes, y: bytes, n: int, m: int) -> bool:
    """False if two sets of n and m shingles can't be similar enough: what their sketches share is no less than what they do."""
    if not x or not y:
        return True
    a, b = (np.frombuffer(z, dtype=np.uint8).astype(np.int64) for z in (x, y))
    while len(a) > len(b):
        a = a.reshape(2, -1).sum(axis=0)
    while len(b) > len(a):
        b = b.reshape(2, -1).sum(axis=0)
    most = int(np.minimum(a, b).sum())
    return SIMILARITY[1] * most >= SIMILARITY[0] * (n + m - most)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts of a chunk at a time, which bounds what a task holds."""
    for batch in batches:
        ids, texts = ids_of(batch), texts_of(batch)
        for a, b in chunks(texts):
            yield ids[a:b], texts[a:b]


def _frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents of a sample hold, sorted, and their ranks, rare ones first."""
    share = max(1, docs.count() // SAMPLE_ROWS)
    sample = text_of(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _parts(batches):
            # Counted where they are read: what a chunk holds once is one row, not one a document.
            each = {set_key(x): x for x in shingle_sets(texts)}
            kinds, n = np.unique(np.concatenate(list(each.values())), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], ["h", "n"])

    held = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_COUNT)
    rows = held.orderBy(F.col("n").desc(), "h").limit(FREQUENT).toPandas()  # at most FREQUENT rows
    kinds = rows["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(kinds)
    return kinds[order], (len(kinds) - order).astype(np.int64)


def _first_shingles(docs: DataFrame) -> DataFrame:
    """least_id, s (the set's key), n (its size), its first shingles and sketch of each distinct set."""
    held = docs.sparkSession.sparkContext.broadcast(_frequent(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, rank = held.value
        for ids, texts in _parts(batches):
            keys, sizes, firsts, sketches = [], [], [], []
            for x in shingle_sets(texts):
                n = len(x)
                most = n - -(-SIMILARITY[0] * n // SIMILARITY[1]) + 1
                if len(kinds):
                    at = np.minimum(np.searchsorted(kinds, x), len(kinds) - 1)
                    late = np.where(kinds[at] == x, rank[at], 0)
                    first = x[np.argsort(late, kind="stable")[:most]]
                else:
                    first = x[:most]
                keys.append(set_key(x))
                sizes.append(n)
                firsts.append(first.view(np.int64))
                sketches.append(sketch(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["id", "s", "n", "first", "sketch"])

    rows = text_of(docs).mapInArrow(run, "id long, s long, n long, first array<long>, sketch binary")
    known = F.nullif("id", F.lit(int(NO_ID)))
    return materialise(rows.groupBy("s").agg(F.min(known).alias("least_id"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("sketch").alias("sketch")), "copies-sets")


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """s and all shingles of the wanted sets (s and least_id), read from their documents again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _parts(batches):
            sets = list(shingle_sets(texts))
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["s", "shingles"])

    ids = wanted.select(F.coalesce("least_id", F.lit(int(NO_ID))).alias("id")).distinct()
    texts = text_of(docs).withColumn("id", F.coalesce("doc_id", F.lit(int(NO_ID)))).join(ids.hint("shuffle_hash"), "id", "left_semi").select("doc_id", "text")
    read = texts.mapInArrow(run, "s long, shingles array<long>")
    return materialise(read.join(wanted.select("s"), "s", "left_semi").dropDuplicates(["s"]), "copies-shingles")


def _similar(docs: DataFrame, sets: DataFrame, pairs: DataFrame, rows: int, hot: list[int]) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: by sketch, and those that pass by their whole sets. ``rows`` bounds their number; ``hot`` are values of a that very many have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [may_be_similar(*x) for x in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(fits, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    known = lambda name, k: sets.select(F.col("s").alias(name), F.col("sketch").alias(f"x{k}"), F.col("n").alias(f"n{k}"))
    sketched = spread_join(pairs, known("a", 1), "a", hot).join(known("b", 2), "b").select("a", "b", "x1", "x2", "n1", "n2")
    left = materialise(sketched.mapInArrow(run, "a long, b long"), "copies-pairs", rows=rows)
    ends = left.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    whole = _whole_sets(docs, sets.select("s", "least_id").join(ends, "s"))
    both = spread_join(left, whole.select(F.col("s").alias("a"), F.col("shingles").alias("x")), "a", hot).join(whole.select(F.col("s").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    union = F.size("x") + F.size("y") - common
    return materialise(both.where(SIMILARITY[1] * common >= SIMILARITY[0] * union).select("a", "b"), "copies-links", rows=rows)


def _fits(n: str, m: str) -> F.Column:
    """Sizes of sets that can be similar enough."""
    return SIMILARITY[1] * F.least(n, m) >= SIMILARITY[0] * F.greatest(n, m)


def links_between(sets: list[np.ndarray], roots: np.ndarray) -> np.ndarray:
    """For each of some sets the smallest root that it reaches over similar sets of other components.

    ``roots`` numbers the components that the sets are of.
    """
    sizes = np.array([len(x) for x in sets])
    who = np.repeat(np.arange(len(sets)), sizes)
    kinds, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(often > 1) - 1
    shared = np.flatnonzero(often[at] > 1)
    order = shared[np.argsort(column[at[shared]], kind="stable")]
    row, place = who[order], column[at[order]]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    width = max(1, (1 << 22) // len(sets))
    for first in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [first, first + width])
        held = np.zeros((len(sets), width), dtype=np.float32)
        held[row[a:b], place[a:b] - first] = 1
        common += held @ held.T
    linked = SIMILARITY[1] * common >= SIMILARITY[0] * (sizes[:, None] + sizes[None, :] - common)
    linked &= roots[:, None] != roots[None, :]
    found = roots.copy()
    while True:
        least = np.where(linked, found[None, :], found[:, None]).min(axis=1)
        # Sets of one component have one label.
        by_root = np.full(int(roots.max()) + 1, len(sets) + int(roots.max()))
        np.minimum.at(by_root, roots, np.minimum(found, least))
        new = by_root[roots]
        if (new == found).all():
            return found
        found = new


def may_link(sketches: list[bytes], sizes: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Which of some sets may be similar enough to one of another component, by what their sketches can share at most."""
    found = np.array([not x for x in sketches], dtype=bool)  # without a sketch anything may be
    if found.any():
        return np.ones(len(sketches), dtype=bool)
    lengths = np.array([len(x) for x in sketches])
    for size in np.unique(lengths).tolist():
        # Sets that can be similar have sketches of the same size, or one of twice the other's.
        mine = np.flatnonzero(lengths == size)
        wide = np.flatnonzero(lengths == 2 * size)
        both = np.concatenate([mine, wide])
        held = np.stack([np.frombuffer(sketches[k], dtype=np.uint8).astype(np.uint16) for k in mine.tolist()])
        if len(wide):
            folded = np.stack([np.frombuffer(sketches[k], dtype=np.uint8).astype(np.uint16) for k in wide.tolist()]).reshape(len(wide), 2, size).sum(axis=1, dtype=np.uint16)
            held = np.concatenate([held, folded])
        for k, i in enumerate(mine.tolist()):
            other = np.flatnonzero(roots[both] != roots[i])
            n, m = sizes[i], sizes[both[other]]
            other = other[SIMILARITY[1] * np.minimum(n, m) >= SIMILARITY[0] * np.maximum(n, m)]
            if len(other):
                most = np.minimum(held[other], held[k]).sum(axis=1, dtype=np.int64)
                hit = both[other[SIMILARITY[1] * most >= SIMILARITY[0] * (n + sizes[both[other]] - most)]]
                found[hit] = True
                found[i] |= len(hit) > 0
    return found


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The distinct sets of one cell after another; rows come in order of their cells."""
    cell, held = None, {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["cell"] != cell:
                if len(held) > 1:
                    yield list(held.values())
                cell, held = row["cell"], {}
            held[row["s"]] = row
    if len(held) > 1:
        yield list(held.values())


def _bucket_links(docs: DataFrame, sets: DataFrame, members: DataFrame, rows: int) -> DataFrame:
    """Links (a, b) between the components of similar sets; ``members`` has bucket, s, n and root."""
    sizes = members.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = spread_join(members, sizes, "bucket", None if rows > FEW_ROWS else []).withColumn("i", F.pmod(F.xxhash64("s"), F.col("blocks")))
    cells = dealt.select("bucket", "s", "root", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    keyed = cells.select(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "s", "root")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced

    def by_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_cell(batches):
            fits = may_link([x["sketch"] for x in held], np.array([x["n"] for x in held]), np.array([x["root"] for x in held]))
            left = [x for x, fit in zip(held, fits.tolist(), strict=True) if fit]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in left], pa.int64()) for c in ("cell", "s", "root")], ["cell", "s", "root"])

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_cell(batches):
            known, root = np.unique(np.array([x["root"] for x in held], dtype=np.int64), return_inverse=True)
            if len(known) > 1:
                reached = links_between([np.array(x["shingles"], dtype=np.int64).view(np.uint64) for x in held], root)
                a, b = known[root], known[reached]
                pairs = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    sketched = keyed.join(sets.select("s", "n", "sketch"), "s").select("cell", "s", "root", "n", "sketch")
    dealt = sketched.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(by_sketch, "cell long, s long, root long")
    open_sets = materialise(dealt, "copies-cells", rows=rows)
    whole = _whole_sets(docs, sets.select("s", "least_id").join(open_sets.select("s").distinct(), "s"))
    compared = open_sets.join(whole, "s").select("cell", "s", "root", "shingles").repartition(tasks, "cell").sortWithinPartitions("cell")
    return compared.mapInArrow(exactly, "a long, b long").distinct()


def similar_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct sets (s, least_id, n), and node and root of those that are linked."""
    sets = _first_shingles(docs)
    number = sets.agg(F.sum(F.size("first"))).first()[0] or 0
    rows = sets.select("s", "n", F.explode("first").alias("h"))
    # One shuffle by shingle; the few shingles that very many sets begin with are aggregated before it.
    hot = hot_keys(rows, "h") if number > FEW_ROWS else []
    group = Window.partitionBy("h")
    least = F.min(F.struct("s", "n"))
    columns = ["h", "s", "n", F.col("least.s").alias("a"), F.col("least.n").alias("m")]
    seldom = rows.where(~F.col("h").isin(hot)) if hot else rows
    shared = seldom.withColumn("least", least.over(group)).withColumn("top", F.max("s").over(group)).where("least.s < top").select(*columns)
    if hot:
        often = rows.where(F.col("h").isin(hot))
        shared = shared.unionByName(often.join(F.broadcast(often.groupBy("h").agg(least.alias("least"))), "h").select(*columns))  # fewer than HOT_SHARE
    shared = materialise(shared, "copies-shared", rows=number)
    stars = shared.where("s > a").where(_fits("n", "m")).select("a", F.col("s").alias("b")).distinct()
    root = components(_similar(docs, sets, stars, number, hot_keys(shared, "a") if number > FEW_ROWS else []))
    placed = materialise(shared.select("h", "s", "n", "a").join(root.withColumnRenamed("node", "s"), "s", "left").select("h", "s", "n", "a", F.coalesce("root", "s").alias("root")), "copies-placed", rows=number)
    mixed = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
    members = materialise(spread_join(placed, mixed, "h", None if number > FEW_ROWS else [], how="left_semi").select(F.col("a").alias("bucket"), "s", "n", "root").distinct(), "copies-open", rows=number)
    further = components(_bucket_links(docs, sets, members, number))
    single = sets.select(F.col("s").alias("node")).join(root, "node", "left").select("node", F.coalesce("root", "node").alias("near"))
    final = single.join(further.select(F.col("node").alias("near"), F.col("root").alias("far")), "near", "left").select("node", F.coalesce("far", "near").alias("root"))
    return sets, final


def _joined_by(docs: DataFrame, near: DataFrame, roots: DataFrame) -> DataFrame:
    """node and root of all sets once the components of similar sets that a group of ``near`` (doc_id, component_id) reaches are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([set_key(x) for x in shingle_sets(texts)], pa.int64())], ["doc_id", "node"])

    keyed = text_of(docs).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, node long")
    groups = keyed.join(near.where("doc_id IS NOT NULL").select("doc_id", "component_id").distinct(), "doc_id").select("node", "component_id").distinct()
    held = materialise(groups.join(roots, "node").select("root", "component_id").distinct(), "copies-groups")
    low = held.groupBy("component_id").agg(F.min("root").alias("b"), F.max("root").alias("top")).where("b < top").select("component_id", "b")
    further = components(held.join(low, "component_id").where("root > b").select(F.col("root").alias("a"), "b").distinct())
    return roots.join(further.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.coalesce("far", "root").alias("root"))


def first_copies(docs: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """doc_id of the smallest document of each group of near copies, single documents too.

    ``near`` has doc_id and component_id of groups that were found otherwise, as by
    operator 8: their links and those of similar sets count alike, and no link is lost.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "copies-firsts")
    with temporary(spark):
        sets, roots = similar_sets(docs)
        if near is not None:
            roots = _joined_by(docs, near, materialise(roots, "copies-roots"))
        placed = sets.join(roots.withColumnRenamed("node", "s"), "s").select("root", "least_id")
        placed.groupBy("root").agg(F.min("least_id").alias("doc_id")).where("doc_id IS NOT NULL").select("doc_id").write.parquet(path)
    return spark.read.parquet(path)
