"""Hashes of all windows of a text, by array operations, and bitmaps of hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Characters that are hashed at once.
STEP = 1 << 15
_UP = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * STEP, _ODD))])
_DOWN = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * STEP, _INVERSE))])
#: Bits that one aggregate of Spark's bitmap functions covers.
_COVERED = 32_768


def window_hashes(text: str, width: int) -> np.ndarray:
    """Unsigned 64-bit hashes of the windows of ``width`` characters at every place of a text.

    A window's hash is a polynomial of its code points modulo 2^64, mixed: the
    difference of two running sums, moved back to the first place.
    """
    if width > STEP:
        raise ValueError(f"a window has at most {STEP} characters")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    out = []
    for first in range(0, len(points) - width + 1, STEP):
        part = points[first : first + STEP + width - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * _UP[: len(part)])])
        n = len(part) - width + 1
        h = (sums[width:] - sums[:-width]) * _DOWN[:n]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def spans(points: np.ndarray, places: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """width, places and hashes (as of ``window_hashes``) of the windows at some places of each width, ascending; ``points`` are code points, a part of them is hashed at a time."""
    points, widest = points.astype(np.uint64) + np.uint64(1), max(width for width, _ in places)
    step = max(STEP, widest)
    up, down = (_UP, _DOWN) if step == STEP else (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * step, x))]) for x in (_ODD, _INVERSE))
    for first in range(0, len(points), step):
        part = points[first : first + step + widest - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)])])
        for width, wanted in places:
            at = wanted[np.searchsorted(wanted, first) : np.searchsorted(wanted, first + step)] - first
            if len(at):
                h = (sums[at + width] - sums[at]) * down[at]
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                yield width, at + first, h ^ (h >> np.uint64(32))


def bitmap(rows: DataFrame, place: Column, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits with those at the rows' places set, built on the executors; its bytes, lowest bit first.

    What is collected is of fixed size: at most 2^bits / 32,768 rows of 4 KB.
    """
    held = rows.select((place + 1).alias("place"))
    parts = held.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros((max(1, (1 << bits) // _COVERED), _COVERED // 8), dtype=np.uint8)
    for r in parts.collect():
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out.ravel()


def has_bits(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of the places are set."""
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
