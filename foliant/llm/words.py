"""Words of whole batches of texts as numpy arrays.

A word is ``[^\\x20\\x09-\\x0D]+`` over UTF-8: ASCII white space never occurs
inside a multi-byte character, so splitting bytes splits code points. One pass
over the bytes of a chunk yields the bounds and a 64-bit hash of every word;
there is no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once (arrays of eight bytes each then fit a processor's cache); a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_ORDER = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
_powers: list[np.ndarray] = []


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The column's texts as bytes; a null is the empty text."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


#: Stands for a null id in arrays of ids.
NO_ID = np.iinfo(np.int64).min


def ids_of(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    """The ids as integers, ``NO_ID`` for null."""
    return batch.column(column).fill_null(int(NO_ID)).to_numpy().astype(np.int64)


def id_array(ids: np.ndarray) -> pa.Array:
    """The ids as a column, null where they are ``NO_ID``."""
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts come to about ``most`` bytes."""
    first, size = 0, 0
    for k, x in enumerate(texts):
        if size and size + len(x) > most:
            yield first, k
            first, size = k, 0
        size += len(x) + 1
    if first < len(texts):
        yield first, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64 and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (_ODD, inverse)]
    return _powers[0], _powers[1]


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes as an array, and where words start and end."""
    a = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = ~SPACE[a]
    step = np.diff(inside)
    return a, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in an odd number, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(max(len(a), CHUNK_BYTES * 2))
    total = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + mix((ends - starts).astype(np.uint64)))


class Words:
    """The words of some texts: bounds in ``data``, hashes, and per text the first word's index."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = b"\n".join(texts)
        self.data = data.lower() if lower else data  # bytes.lower() changes A-Z alone
        self.bytes, self.starts, self.ends = word_bounds(self.data)
        at = np.cumsum([0] + [len(x) + 1 for x in texts])
        self.first = np.searchsorted(self.starts, at).astype(np.int64)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return word_hashes(self.bytes, self.starts, self.ends)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word; the last n-1 words of the
    array start none. The order of words counts."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(len(h) - n + 1, n, dtype=np.uint64) * _ODD
    for k in range(n):
        total = total * _ORDER[4] + h[k : len(h) - n + 1 + k] * _ORDER[k % 4]
    return mix(total)


def starts_ngram(counts: np.ndarray, n: int) -> np.ndarray:
    """Which words start an n-gram that stays within its text."""
    total = int(counts.sum())
    last = np.repeat(np.cumsum(counts), counts)
    return np.arange(total) + n <= last


#: Classes of bytes: 0 white space and control, 1 letters and all bytes of multi-byte characters, 2 digits, 3 other.
CLASS = np.full(256, 3, dtype=np.int8)
CLASS[:33] = 0
CLASS[127] = 0
CLASS[128:] = 1
for _first, _last in (("A", "Z"), ("a", "z")):
    CLASS[ord(_first) : ord(_last) + 1] = 1
CLASS[ord("0") : ord("9") + 1] = 2


class Runs:
    """Runs of bytes of one class (white space is none) in some texts: bounds,
    class, and per text the first run's index. ``wanted`` limits the classes."""

    def __init__(self, texts: list[bytes], lower: bool = True, wanted: tuple[int, ...] = (1, 2, 3)):
        raw = b"\n".join(texts)
        self.raw = np.frombuffer(raw, dtype=np.uint8)
        self.data = raw.lower() if lower else raw
        self.bytes = np.frombuffer(self.data, dtype=np.uint8)
        kind = np.zeros(len(self.bytes) + 2, dtype=np.int8)
        kind[1:-1] = CLASS[self.bytes]
        edge = np.flatnonzero(np.diff(kind))
        starts, ends = edge[:-1], edge[1:]
        self.kind = kind[starts + 1]
        keep = np.isin(self.kind, wanted)
        self.starts, self.ends, self.kind = starts[keep], ends[keep], self.kind[keep]
        at = np.cumsum([0] + [len(x) + 1 for x in texts])
        self.first = np.searchsorted(self.starts, at).astype(np.int64)
        self.counts = np.diff(self.first)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """Hashes of the runs, or of their first ``most`` bytes."""
        ends = self.ends if most is None else np.minimum(self.ends, self.starts + most)
        return word_hashes(self.bytes, self.starts, ends)


def sums_by(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of values; an empty group has 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
