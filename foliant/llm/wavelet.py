"""Token ids in wavelet-matrix shard files (operator 5).

A shard file holds the ids of consecutive documents (ascending doc_id) as the
bit planes of a wavelet matrix: plane 0 has the ids' top bits in text order;
each further plane is ordered by the bit before, zeros first, stably. One
zero count a plane and a rank directory (ones before every 512 bits) make
access, counting and occurrence lookup need a few positions a plane.

File: magic, a header (bits, ids, documents, block sizes), documents' ids and
lengths, then for each plane its zero count, its rank directory and its bits in
blocks of 32,768, each zstd-compressed on its own, with their offsets; a reader
decompresses only the blocks that a query touches.

Shards are files in the shared folder, written under a name of the task's own
attempt; the table of the files that count (a row each, written by Spark's
committer) is read back, so lost executors and retried tasks leave no trace.
Starts are prefix sums over shards: per group of shards, then over groups.

Defined results: null text is empty (just the end id); rows that repeat a
doc_id each count, in an order fixed by their ids' checksum and length; an
empty table gives no rows. A document is never cut: a shard closes when it
has ``shard_tokens`` ids, so a very long one makes a long shard.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import fresh_path, materialise, text_of
from foliant.llm.tokens import encode, vocabulary
from foliant.llm.words import chunks, id_array, ids_of, texts_of

MAGIC = b"WVMX1\0\0\0"
#: Bits between rank samples, and bits in a compressed block.
RANK_BITS, BLOCK_BITS = 512, 32_768
#: Ids after which a shard closes.
SHARD_TOKENS = 1 << 21


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of a shard file."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    squeeze = zstandard.ZstdCompressor(level=1).compress
    n = len(ids)
    out = [MAGIC, struct.pack("<IIQQ", bits, BLOCK_BITS, n, len(doc_ids)), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes()]
    level = ids.astype(np.uint16) if bits <= 16 else ids
    for plane in range(bits - 1, -1, -1):
        bit = (level >> plane & 1).astype(bool)
        packed = np.packbits(bit, bitorder="little")
        ones = np.bitwise_count(np.pad(packed, (0, -len(packed) % (RANK_BITS // 8))).reshape(-1, RANK_BITS // 8)).sum(axis=1, dtype=np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u4")
        blocks = [squeeze(packed[k : k + BLOCK_BITS // 8].tobytes()) for k in range(0, len(packed), BLOCK_BITS // 8)]
        offsets = np.cumsum([0] + [len(x) for x in blocks]).astype("<u4")
        out += [struct.pack("<Q", n - int(ones.sum())), ranks.tobytes(), offsets.tobytes(), *blocks]
        level = np.concatenate([np.compress(~bit, level), np.compress(bit, level)])
    return b"".join(out)


class WaveletMatrix:
    """A shard file opened for access, rank, select, counting and full decoding."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        self.data = data
        self.bits, self.block_bits, self.n, docs = struct.unpack_from("<IIQQ", data, 8)
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<u4", docs, at + 8 * docs)
        at += 12 * docs
        samples, blocks = -(-self.n // RANK_BITS) + 1, -(-self.n // self.block_bits)
        self.zeros, self.ranks, self.offsets, self.payload = [], [], [], []
        for _ in range(self.bits):
            self.zeros.append(struct.unpack_from("<Q", data, at)[0])
            self.ranks.append(np.frombuffer(data, "<u4", samples, at + 8))
            self.offsets.append(np.frombuffer(data, "<u4", blocks + 1, at + 8 + 4 * samples))
            at += 12 + 4 * samples + 4 * blocks
            self.payload.append(at)
            at += int(self.offsets[-1][-1])
        self._block = lru_cache(maxsize=256)(self._read_block)

    def _read_block(self, plane: int, k: int) -> np.ndarray:
        first, last = self.offsets[plane][k : k + 2].tolist()
        at = self.payload[plane]
        raw = zstandard.ZstdDecompressor().decompress(self.data[at + first : at + last], max_output_size=self.block_bits // 8)
        return np.frombuffer(raw, dtype=np.uint8)

    def bit(self, plane: int, i: int) -> int:
        block = self._block(plane, i // self.block_bits)
        i %= self.block_bits
        return int(block[i >> 3]) >> (i & 7) & 1

    def rank1(self, plane: int, i: int) -> int:
        """Ones before position i of a plane."""
        sample = i // RANK_BITS
        total = int(self.ranks[plane][sample])
        rest = i - sample * RANK_BITS
        if rest:
            block = self._block(plane, sample * RANK_BITS // self.block_bits)
            at = sample * RANK_BITS % self.block_bits // 8
            part = np.unpackbits(block[at : at + RANK_BITS // 8], bitorder="little")[:rest]
            total += int(part.sum())
        return total

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            one = self.bit(plane, i)
            value = value << 1 | one
            ones = self.rank1(plane, i)
            i = self.zeros[plane] + ones if one else i - ones
        return value

    def _range(self, token: int, first: int, last: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for plane in range(self.bits):
            a, b = self.rank1(plane, first), self.rank1(plane, last)
            if token >> (self.bits - 1 - plane) & 1:
                first, last = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                first, last = first - a, last - b
        return first, last

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """Occurrences of an id among positions first to last."""
        a, b = self._range(token, first, self.n if last is None else last)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of an id."""
        first, last = self._range(token, 0, self.n)
        if not 0 <= k < last - first:
            raise IndexError(k)
        i = first + k
        for plane in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - plane) & 1
            want = i - self.zeros[plane] if one else i
            low, high = 0, self.n  # the smallest i with want + 1 such bits before i + 1
            while low < high:
                mid = (low + high) // 2
                ones = self.rank1(plane, mid + 1)
                if (ones if one else mid + 1 - ones) > want:
                    high = mid
                else:
                    low = mid + 1
            i = low
        return i

    def plane(self, plane: int) -> np.ndarray:
        blocks = [self._read_block(plane, k) for k in range(len(self.offsets[plane]) - 1)]
        packed = np.concatenate(blocks) if blocks else np.zeros(0, dtype=np.uint8)
        return np.unpackbits(packed, count=self.n, bitorder="little").astype(bool)

    def decode(self) -> np.ndarray:
        """All ids in order: from the last plane up, undo each stable division by a bit."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, dtype=kind)
        for plane in range(self.bits - 1, -1, -1):
            bit = self.plane(plane)
            above = np.empty_like(values)
            above[np.flatnonzero(~bit)] = values[: self.zeros[plane]]
            above[np.flatnonzero(bit)] = values[self.zeros[plane] :] | kind(1 << (self.bits - 1 - plane))
            values = above
        return values.astype("<u4")


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, n (ids, the end id too) crc and ids (as 16-bit integers) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = encode(texts_of(batch), path, end)
            # A column of binary values holds up to 2 GiB: rows go out in parts well below.
            for first, last in chunks(codes, 1 << 29):
                part = codes[first:last]
                ids = np.frombuffer(b"".join(part), "<u4")
                if ids.max(initial=0) > 0xFFFF:
                    raise ValueError("ids above 65,535 don't fit a shard's 16 planes")
                sizes = np.array([len(x) // 4 for x in part], dtype=np.int64)
                ends = np.concatenate([[0], 2 * np.cumsum(sizes)])
                if ends[-1] >= 1 << 31:
                    raise ValueError("a document of a thousand million ids doesn't fit a row")
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(sizes), pa.array([zlib.crc32(x) for x in part], pa.int64()), packed], ["doc_id", "n", "crc", "ids"])

    return text_of(docs).mapInArrow(run, "doc_id long, n long, crc long, ids binary")


def write_shards(docs: DataFrame, path: str | None = None, end: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write shard files; return their table: shard order, file, first and last place, ids, documents."""
    spark = docs.sparkSession
    codes = materialise(encoded(docs, path or vocabulary(), end), "wavelet-ids")
    folder = fresh_path(spark, "wavelet-shards")
    # Ranges of doc_id by sampling the written ids; a partition is a run of the total order.
    tasks = max(1, codes.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = codes.repartitionByRange(tasks, "doc_id", "crc", "n").sortWithinPartitions("doc_id", "crc", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, where = _store(folder)
        store.create_dir(where, recursive=True)
        part, shard = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        doc_ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal held, shard
            name = f"shard-{part:06d}-{shard:06d}-{uuid.uuid4().hex}.wvm"
            row = [[part], [shard], [name], [held], [sum(map(len, doc_ids))]]
            with store.open_output_stream(f"{where}/{name}") as out:
                out.write(build(np.concatenate(ids), np.concatenate(doc_ids), np.concatenate(lengths)))
            held, shard = 0, shard + 1
            for x in (ids, doc_ids, lengths):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "shard", "name", "n", "docs"])

        for batch in batches:
            sizes, keys = batch.column(1).to_numpy(), ids_of(batch)
            values = batch.column(3).to_pylist()
            first = 0
            while first < len(sizes):
                upto = np.cumsum(sizes[first:])
                last = first + min(int(np.searchsorted(upto, shard_tokens - held)) + 1, len(upto))
                ids.append(np.frombuffer(b"".join(values[first:last]), dtype="<u2"))
                doc_ids.append(keys[first:last])
                lengths.append(sizes[first:last].astype("<u4"))
                held += int(upto[last - first - 1])
                if held >= shard_tokens:
                    yield close()
                first = last
        if held:
            yield close()

    table = materialise(ordered.select("doc_id", "n", "crc", "ids").mapInArrow(run, "part int, shard int, name string, n long, docs long"), "wavelet-table")
    return table.withColumn("file", F.concat(F.lit(folder + "/"), "name"))


def with_starts(table: DataFrame) -> DataFrame:
    """Add start, the ids of all shards before each one: within a partition's shards, then over partitions."""
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = table.groupBy("part").agg(F.sum("n").alias("total")).withColumn("before", F.coalesce(F.sum("total").over(over), F.lit(0))).select("part", "before")
    return table.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part").withColumn("start", F.col("before") + F.col("inner")).drop("before", "inner")


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def read_shards(table: DataFrame) -> DataFrame:
    """Decode shard files: doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) per document.

    The table's rows are dealt to tasks, which open the files that they name.
    """
    tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, where = _store(file)
                with store.open_input_file(where) as f:
                    matrix = WaveletMatrix(f.read())
                raw = matrix.decode().tobytes()
                ends = np.cumsum(matrix.lengths, dtype=np.int64)
                begins = ends - matrix.lengths
                for first in range(0, len(ends), 2000):
                    a, b = begins[first : first + 2000], ends[first : first + 2000]
                    yield pa.RecordBatch.from_arrays([id_array(matrix.doc_ids[first : first + 2000]), pa.array(start + a), pa.array(b - a), pa.array([raw[4 * x : 4 * y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return with_starts(table).select("file", "start").repartition(tasks, "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
