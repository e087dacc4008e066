"""Language-model scores with stupid backoff, computed relationally (operator 3).

The corpus is its own training text, each document left out of the counts that
it is scored with: an n-gram's count is that of all other documents. The score
of a word after its context is count(n-gram) / count(context) where the n-gram
is known, else ``BACKOFF`` times the score after the context without its first
word; single words have count / all words, and unknown words ``UNKNOWN`` / all.
A document's score is the sum of the logarithms over its words.

Tables are relations between blocks of documents and hash partitions of
n-grams, with columns packed into binary values:

1. blocks: whole documents, their texts compressed together, written once to
   the shared folder;
2. n-grams exploded by block, distinct there with their counts, partitioned by hash;
3. the count table: in each hash partition the blocks' counts are summed;
4. joined back: how often the other blocks have each of a block's n-grams;
5. the block is scored, summed per document.

An n-gram's hash has so many bits as tell all n-grams of the corpus apart
(``SPARE_BITS`` beyond their number: some 10^-7 of them are taken for another);
a block's sorted hashes are written as differences in the manner of Elias and
Fano, which takes about two bits more than the set itself.

A frequent n-gram occurs once per block at most, so no hash partition is hot; a
partition holds ``PARTITION_GRAMS`` n-grams or so at any size of corpus. Beyond
``MOST_TASKS`` partitions a task works on several, one after the other. With very
many blocks a row holds few n-grams of a block and a partition, at least one:
the work stays in proportion to the n-grams, and larger blocks make it less.

Defined results: null and empty texts have score 0 and no words; repeated rows
are documents of their own, as are rows without a doc_id; an empty table gives no rows; other columns are
ignored. A task holds one block (of ``BLOCK_BYTES``, or one longer document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialise, text_of
from foliant.llm.words import CHUNK_BYTES, Words, chunks, id_array, ids_of, mix, ngram_hashes, starts_ngram, texts_of, word_bounds

ORDER = 3
BACKOFF = 0.4
#: Count of a word that no other document has, as it is scored.
UNKNOWN = 0.5
BLOCK_BYTES = 5 << 20
PARTITION_GRAMS = 1 << 20
MOST_TASKS = 20_000
SPARE_BITS = 24
#: Bytes of a block's texts to a row of the shuffle.
SLICE = 1 << 18


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers, compressed with the bytes of each rank together."""
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def _low_bits(n: int, bits: int) -> int:
    """How many low bits of each of n values below 2^bits are written as they are."""
    return max(0, bits - max(1, n).bit_length() + 1)


def pack_set(values: np.ndarray, bits: int) -> bytes:
    """Sorted distinct values below 2^bits: whole bytes and odd bits of their low parts, and a bitmap of the high ones, each moved on by its place."""
    n = len(values)
    low = _low_bits(n, bits)
    whole, odd = divmod(low, 8)
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    planes = np.ascontiguousarray(raw[:, :whole].T).tobytes()
    rest = np.packbits(np.unpackbits(raw[:, whole : whole + 1], axis=1, count=odd, bitorder="little"), bitorder="little").tobytes() if odd else b""
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    steps = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
    steps[places] = 1
    return n.to_bytes(4, "little") + planes + rest + np.packbits(steps, bitorder="little").tobytes()


def unpack_set(data: bytes, bits: int) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    low = _low_bits(n, bits)
    whole, odd = divmod(low, 8)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :whole] = np.frombuffer(data, np.uint8, whole * n, 4).reshape(whole, n).T
    at = 4 + whole * n
    if odd:
        size = -(-odd * n // 8)
        part = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=odd * n, bitorder="little").reshape(n, odd)
        out[:, whole] = np.packbits(part, axis=1, bitorder="little")[:, 0]
        at += size
    steps = np.unpackbits(np.frombuffer(data, np.uint8, offset=at), bitorder="little")
    high = (np.flatnonzero(steps) - np.arange(n)).astype(np.uint64)
    return out.view("<u8").ravel() | high << np.uint64(low)


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents: ids, bytes per document, texts, number of words."""

    def row(number: int, texts: list[bytes], ids: list[np.ndarray]) -> pa.RecordBatch:
        words = sum(len(word_bounds(b"\n".join(texts[a:b]))[1]) for a, b in chunks(texts))
        squeezed = zstandard.ZstdCompressor(level=9).compress(b"".join(texts).lower())
        values = [number, pack(np.concatenate(ids).view(np.uint64)), pack(np.array([len(x) for x in texts])), squeezed, words]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], ["block", "ids", "sizes", "texts", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        texts: list[bytes] = []
        ids: list[np.ndarray] = []
        size = 0
        for batch in batches:
            mine, keys = texts_of(batch), ids_of(batch)
            for a, b in chunks(mine, min(block_bytes, CHUNK_BYTES)):
                more = sum(map(len, mine[a:b]))
                if texts and size + more > block_bytes:
                    yield row(number, texts, ids)
                    number, texts, ids, size = number + 1, [], [], 0
                texts += mine[a:b]
                ids.append(keys[a:b])
                size += more
        if texts:
            yield row(number, texts, ids)

    return materialise(text_of(docs).mapInArrow(run, "block long, ids binary, sizes binary, texts binary, n long"), "backoff-blocks", codec="none")


def _words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, and words per document."""
    data = zstandard.ZstdDecompressor().decompress(row["texts"])
    ends = np.cumsum(unpack(row["sizes"]).astype(np.int64)).tolist()
    texts = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    found = [Words(texts[a:b]) for a, b in chunks(texts)]
    return np.concatenate([x.hashes() for x in found]), np.concatenate([x.counts for x in found])


def _grams(words: np.ndarray, counts: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 .. order, where n-grams start and their hashes of so many bits (the orders don't mix)."""
    out = []
    for n in range(1, order + 1):
        h = mix(words) if n == 1 else ngram_hashes(words, n)
        at = np.flatnonzero(starts_ngram(counts, n)[: len(h)])
        out.append((at, h[at] >> np.uint64(64 - bits)))
    return out


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(batch.num_rows):
        yield dict(zip(batch.schema.names, (c[k].as_py() for c in batch.columns), strict=True))


def exploded(found: DataFrame, order: int, bits: int, part_bits: int) -> DataFrame:
    """Distinct n-grams of each block with their counts, cut by hash partition: the hashes' top ``part_bits``."""
    rest = bits - part_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _dicts(batch):
                distinct, count = np.unique(np.concatenate([h for _, h in _grams(*_words(row), order, bits)]), return_counts=True)
                part = (distinct >> np.uint64(rest)).astype(np.int64)
                distinct &= np.uint64((1 << rest) - 1)
                cuts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
                for first in range(0, len(cuts) - 1, 1000):
                    some = list(zip(cuts[first : first + 1000], cuts[first + 1 : first + 1001], strict=False))
                    columns = [pa.array(part[[a for a, _ in some]]), pa.array([row["block"]] * len(some)), pa.array([pack_set(distinct[a:b], rest) for a, b in some], pa.binary()), pa.array([pack(count[a:b]) for a, b in some], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "block", "grams", "counts"])

    return found.select("block", "sizes", "texts").mapInArrow(run, "part long, block long, grams binary, counts binary")


def others(requests: DataFrame, bits: int, part_bits: int) -> DataFrame:
    """For each part and block how often the other blocks have its n-grams, in their order."""
    rest = bits - part_bits

    def answer(part: int, blocks: list[int], grams: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
        mine = np.concatenate(counts)
        total = np.bincount(at, weights=mine, minlength=len(distinct)).astype(np.uint64)
        other, ends = total[at] - mine, np.cumsum([len(x) for x in grams])
        packed = [pack(other[e - len(x) : e]) for x, e in zip(grams, ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(blocks), pa.int64()), pa.array(blocks, pa.int64()), pa.array(packed, pa.binary())], ["part", "block", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, ([], [], [])
        for batch in batches:
            for row in _dicts(batch):
                if row["part"] != part and held[0]:
                    yield answer(part, *held)
                    held = ([], [], [])
                part = row["part"]
                for store, x in zip(held, (row["block"], unpack_set(row["grams"], rest), unpack(row["counts"])), strict=True):
                    store.append(x)
        if held[0]:
            yield answer(part, *held)

    tasks = min(1 << part_bits, MOST_TASKS)
    return requests.repartition(tasks, "part").sortWithinPartitions("part", "block").mapInArrow(run, "part long, block long, others binary")


def _scores(words: np.ndarray, counts: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray]], other: np.ndarray, all_words: int, backoff: float) -> np.ndarray:
    """The score of each word of a block; ``other`` has the other blocks' counts of its sorted distinct n-grams."""
    distinct, place, own = np.unique(np.concatenate([h for _, h in grams]), return_inverse=True, return_counts=True)
    total = other.astype(np.int64) + own
    doc = np.repeat(np.arange(len(counts)), counts)
    count = []  # by order and start, without the document's own
    first = 0
    for start, _ in grams:
        at, first = place[first : first + len(start)], first + len(start)
        _, pair, same = np.unique(doc[start] * max(1, len(distinct)) + at, return_inverse=True, return_counts=True)
        x = np.zeros(len(words))
        x[start] = total[at] - same[pair]
        count.append(x)
    rest = all_words - np.repeat(counts, counts).astype(np.float64)
    inside = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    log, done = np.zeros(len(words)), np.zeros(len(words), dtype=bool)
    for n in range(len(grams), 0, -1):
        last = np.flatnonzero(~done & (inside >= n - 1))
        start = last - n + 1
        top = count[n - 1][start]
        known = top > 0
        base = count[n - 2][start[known]] if n > 1 else rest[last[known]]
        log[last[known]] += np.log(top[known] / base)
        done[last[known]] = True
        if n > 1:
            log[last[~known]] += np.log(backoff)
    unknown = np.flatnonzero(~done)
    log[unknown] += np.log(UNKNOWN / np.maximum(rest[unknown], 1))
    return log


def _parts_of(found: DataFrame) -> DataFrame:
    """Blocks as rows of bounded size: block, part (-3 ids, -2 sizes, -1 texts), place and data."""
    rows = f"""concat(array(named_struct('part', -3L, 'place', 0, 'data', ids), named_struct('part', -2L, 'place', 0, 'data', sizes)),
        transform(sequence(0, length(texts) - 1, {SLICE}), i -> named_struct('part', -1L, 'place', i, 'data', substring(texts, i + 1, {SLICE}))))"""
    return found.select("block", F.explode(F.expr(rows)).alias("x")).select("block", "x.part", "x.place", "x.data")


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, block_bytes: int = BLOCK_BYTES, partition_grams: int = PARTITION_GRAMS) -> DataFrame:
    """doc_id, n_words and log_score of each row."""
    found = blocks(docs, block_bytes)
    size = found.agg(F.count("*").alias("blocks"), F.sum("n").alias("words")).first()
    all_words = int(size["words"] or 0)
    bits = min(64, max(1, order * all_words).bit_length() + SPARE_BITS)
    part_bits = max(0, (order * all_words - 1) // partition_grams).bit_length()
    answers = others(exploded(found, order, bits, part_bits), bits, part_bits).select("block", "part", F.lit(0).alias("place"), F.col("others").alias("data"))
    # A block's texts and answers meet as rows in order, not as one long row.
    tasks = min(MOST_TASKS, max(1, -(-size["blocks"] // 2)))
    met = _parts_of(found).unionByName(answers).repartition(tasks, "block").sortWithinPartitions("block", "part", "place").select("block", "part", "data")

    def scored(held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        parts: dict[int, list[bytes]] = {-3: [], -2: [], -1: [], 0: []}
        for part, data in held:
            parts[min(part, 0)].append(data)
        words, counts = _words({"texts": b"".join(parts[-1]), "sizes": parts[-2][0]})
        other = np.concatenate([np.zeros(0, dtype=np.uint64), *map(unpack, parts[0])])
        log = _scores(words, counts, _grams(words, counts, order, bits), other, all_words, backoff)
        sums = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=log, minlength=len(counts)).astype(np.float64)
        return pa.RecordBatch.from_arrays([id_array(unpack(parts[-3][0]).view(np.int64)), pa.array(counts), pa.array(sums)], ["doc_id", "n_words", "log_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for row in _dicts(batch):
                if row["block"] != block and held:
                    yield scored(held)
                    held = []
                block = row["block"]
                held.append((row["part"], row["data"]))
        if held:
            yield scored(held)

    return met.mapInArrow(run, "doc_id long, n_words long, log_score double")
