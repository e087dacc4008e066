"""Benchmark decontamination by template canonicalisation (operator 2).

Texts become tokens (runs of letters, lower-cased, and numbers, written in digits
or as words). Numbers, with the unit behind them if there is one, and names
(capitalised within a sentence; a run of them is one) become typed placeholders;
what stood there is the slot's value. A capitalised word at a sentence's start
may be a name or not: windows with one are made in both readings. Windows of
``WINDOW`` tokens, for short items of ``SHORT`` as well, are hashed as templates
and joined by hash between documents and benchmark items, whole texts on both
sides. Along an alignment of an item in a document, the slots must be
consistent: a value of the item always stands for the same value of the
document, and no two values for one: names never, numbers only where both were
changed (two new numbers may happen to be equal). An alignment may change its
shift where words were put in or left out. One that covers ``COVERAGE`` of the
item's windows (of one size) with consistent slots is a leak: "verbatim" if all
slots have the item's own values, "re-parameterised" otherwise.

Windows with fewer than ``LITERALS`` plain tokens say too little and are left
out on both sides (they don't count for coverage). An item with fewer tokens
than a window is one window of its own length; one with fewer than three
tokens, or no eligible window, can't be found.

Documents' windows first pass a bitmap of the items' hashes (fixed size, built on
the executors), then the exact join, in which windows that very many documents
hold are broadcast.

Defined results: null and empty texts have no windows; rows that repeat a
doc_id are one document, and so are rows without one (which decontamination keeps); repeated items each match; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.rolling import bitmap, has_bits
from foliant.llm.common import materialise, spare_name, spread_join, text_of
from foliant.llm.words import NO_ID, Runs, chunks, ids_of, ngram_hashes, starts_ngram, texts_of, word_bounds, word_hashes

WINDOW = 8
LITERALS = 4
#: Items below two windows' length are also read in windows of so many tokens, with so many plain ones.
SHORT, SHORT_LITERALS = 5, 3
LEAST = {WINDOW: LITERALS, SHORT: SHORT_LITERALS}
COVERAGE = 0.5
#: Bits of the bitmap that documents' windows pass first.
BITMAP_BITS = 22

#: Unit words (fixed values).
UNITS = (
    "mm cm m km g mg kg t l ml cl s ms sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres "
    "gram grams kilogram kilograms liter liters litre litres pound pounds lb lbs oz ounce ounces dollar dollars cent cents euro euros usd eur gbp percent degree degrees "
    "mph kmh kph hz khz mhz ghz w kw kwh v a j kj cal kcal pa kpa n c f k"
).split()

#: Number words (fixed values); "one" is mostly none.
NUMBERS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()

_NUMBER, _NAME = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))


class Templates:
    """Template tokens of some texts: hashes, which are placeholders, and the tokens' own hashes."""

    def __init__(self, texts: list[bytes]):
        runs = Runs(texts, wanted=(1, 2))
        starts, ends, kind = runs.starts, runs.ends, runs.kind
        self.first = runs.first
        if len(starts):
            # 1,000 and 3.5 are one number: a run of digits joins the one before over one mark.
            joins = np.zeros(len(starts), dtype=bool)
            joins[1:] = (kind[1:] == 2) & (kind[:-1] == 2) & (starts[1:] - ends[:-1] == 1) & np.isin(runs.bytes[np.maximum(starts[1:] - 1, 0)], [44, 46])
            heads = np.flatnonzero(~joins)
            self.first = np.searchsorted(heads, runs.first)
            lasts = np.concatenate([heads[1:], [len(starts)]]) - 1
            starts, ends, kind = starts[heads], ends[lasts], kind[heads]
        runs.starts, runs.ends = starts, ends
        self.counts = np.diff(self.first)
        self.value = runs.hashes()
        raw = runs.raw
        lead = raw[starts] if len(starts) else np.zeros(0, dtype=np.uint8)
        after = raw[np.minimum(starts + 1, max(0, len(raw) - 1))] if len(starts) else lead
        capital = (kind == 1) & (((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E)))
        stops = np.concatenate([[0], np.cumsum(np.isin(raw, np.frombuffer(b".!?:;\n\"", dtype=np.uint8)))])
        begins = np.ones(len(starts), dtype=bool)
        begins[1:] = stops[starts[1:]] > stops[ends[:-1]]
        if len(starts):
            begins[self.first[:-1][self.counts > 0]] = True
        words = np.isin(self.value, _NUMBER_WORDS) & (kind == 1)
        number = (kind == 2) | words
        unit = np.zeros(len(starts), dtype=bool)
        if len(starts):
            unit[1:] = np.isin(self.value[1:], _UNIT_WORDS) & (kind[1:] == 1) & number[:-1] & ~begins[1:] & ~number[1:]
        name = capital & ~begins & ~unit & ~number
        # Mary Ann is one name, 10 kg and twenty five one number: a token joins the one before. A name's value is its last word's, a number's its first one's.
        joins = unit.copy()
        if len(starts):
            joins[1:] |= name[1:] & name[:-1] & (starts[1:] - ends[:-1] == 1) & (raw[starts[1:] - 1] == 32)
            joins[1:] |= words[1:] & words[:-1] & (starts[1:] - ends[:-1] == 1) & np.isin(raw[starts[1:] - 1], [32, 45])
        heads = np.flatnonzero(~joins)
        lasts = np.concatenate([heads[1:], [len(starts)]]).astype(np.int64) - 1 if len(starts) else heads
        self.whole = word_hashes(runs.bytes, starts[heads], ends[lasts])
        self.first = np.searchsorted(heads, self.first)
        self.counts = np.diff(self.first)
        number, name, leads = number[heads], name[heads], (capital & begins & ~number)[heads]
        self.value = np.where(number, self.value[heads], self.value[lasts])
        self.slot = number | name
        # The last bit of a slot's value is its type.
        self.value = np.where(number, self.value & ~np.uint64(1), self.value | np.uint64(1))
        self.token = np.where(number, _NUMBER, np.where(name, _NAME, self.value))
        # Capitalised at a sentence's start: a plain word in one reading, a name in the other.
        self.readings = [(self.token, self.slot), (np.where(leads, _NAME, self.token), self.slot | leads)]
        self.leads = leads

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First tokens, template hashes and readings of the eligible windows of n tokens."""
        ok = starts_ngram(self.counts, n)
        found = []
        for reading, (token, slot) in enumerate(self.readings):
            h = ngram_hashes(token, n)
            inside = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[[np.arange(len(h)), np.arange(len(h)) + n]], axis=0)[0]  # noqa: B023, E731
            fits = ok[: len(h)] & (inside(~slot) >= LEAST.get(n, max(2, n - 2)))
            if reading:
                fits &= inside(self.leads) > 0
            at = np.flatnonzero(fits)
            found.append((at, h[at], np.full(len(at), reading)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _word_set(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return word_hashes(*word_bounds(data))


_UNIT_WORDS, _NUMBER_WORDS = _word_set(UNITS), _word_set(NUMBERS)
_SCHEMA = "id long, h long, size int, place long, reading long, slots array<long>"


def _rows(ids: np.ndarray, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    row, h, size, place, reading, slots = (np.concatenate(x) if k < 5 else [y for z in x for y in z] for k, x in enumerate(zip(*found, strict=True)))
    columns = [pa.array(ids[row], pa.int64()), pa.array(h.view(np.int64)), pa.array(size, pa.int32()), pa.array(place, pa.int64()), pa.array(reading, pa.int64()), pa.array(slots, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["id", "h", "size", "place", "reading", "slots"])


def _windows(texts: list[bytes], sizes: tuple[int, ...], bits: np.ndarray | None, own_size: bool) -> tuple[np.ndarray, ...]:
    t = Templates(texts)
    parts = []
    for n in sizes:
        at, h, reading = t.windows(n)
        if bits is not None:
            hit = has_bits(bits, (h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64))
            at, h, reading = at[hit], h[hit], reading[hit]
        row = np.searchsorted(t.first, at, side="right") - 1
        if own_size:
            size = t.counts[row]
            mine = (size == n) | (n == WINDOW) & (size > n) | (n == SHORT) & (size >= WINDOW) & (size < 2 * WINDOW)
            at, h, row, reading = at[mine], h[mine], row[mine], reading[mine]
        # The slots' values, then whole names (of which the value is the last word).
        slots = []
        for a, r in zip(at.tolist(), reading.tolist(), strict=True):
            slot = t.readings[r][1][a : a + n]
            slots.append(np.concatenate([t.value[a : a + n][slot], t.whole[a : a + n][slot]]).view(np.int64))
        parts.append((row, h, np.full(len(at), n), at - t.first[row], reading, slots))
    return tuple(np.concatenate([p[k] for p in parts]) if k < 5 else [s for p in parts for s in p[5]] for k in range(6))


def template_windows(rows: DataFrame, sizes: tuple[int, ...], bits: bytes | None = None, own_size: bool = False) -> DataFrame:
    """Windows of each row's text. ``rows`` has doc_id and text; ``own_size``
    limits windows below ``WINDOW`` to texts of exactly that many tokens."""
    held = rows.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(held.value, dtype=np.uint8) if held is not None else None
        for batch in batches:
            texts, ids = texts_of(batch), ids_of(batch)
            for a, b in chunks(texts):
                yield _rows(ids[a:b], [_windows(texts[a:b], sizes, own, own_size)])

    return text_of(rows).mapInArrow(run, _SCHEMA)


def _join(known: dict[int, int], more: dict[int, int]) -> dict[int, int] | None:
    """Both mappings of slots in one, or None if a value stands for two, or two for one."""
    if any(known.get(k, v) != v for k, v in more.items()):
        return None
    both = known | more
    source: dict[int, int] = {}
    for k, v in both.items():
        other = source.setdefault(v, k)
        if other != k and (v & 1 or v in (k, other)):
            return None
    return both


def best_alignment(windows: list[dict], total: int, coverage: float) -> tuple | None:
    """The alignment of an item in a document that covers most: coverage, windows, first place, slots, kind.

    ``windows`` are the met ones of one size (shift, item_place, item_slots,
    slots). A shift whose slots contradict each other doesn't count. From each
    shift, those nearby are added, the largest first, as long as their slots
    agree: a word put in or left out moves what follows to another shift.
    """
    shifts: dict[int, tuple[set[int], dict[int, int], bool] | None] = {}
    for w in windows:
        half = len(w["slots"]) // 2
        held = shifts.get(w["shift"], (set(), {}, True))
        if held is not None:
            pairs = _join({}, held[1])
            for a, b in zip(w["item_slots"][:half], w["slots"][:half], strict=True):
                pairs = pairs if pairs is None else _join(pairs, {a: b})
            held = None if pairs is None else (held[0] | {w["item_place"]}, pairs, held[2] and w["item_slots"] == w["slots"])
        shifts[w["shift"]] = held
    good = sorted(k for k, v in shifts.items() if v is not None)
    reach, best = max(WINDOW, total), None
    for seed in good:
        places, pairs, same = shifts[seed]
        near = good[bisect_left(good, seed - reach) : bisect_right(good, seed + reach)]
        for k in sorted(near, key=lambda k: (-len(shifts[k][0]), abs(k - seed))):  # noqa: B023
            if k != seed and not shifts[k][0] <= places and (both := _join(pairs, shifts[k][1])) is not None:
                places, pairs, same = places | shifts[k][0], both, same and shifts[k][2]
        share = len(places) / total
        if share >= coverage:
            best = max(best or (0.0,), (share, len(places), -seed, len(pairs), "verbatim" if same else "re-parameterised"))
    return best


def _aligned(met: DataFrame, coverage: float) -> DataFrame:
    """doc_id, item_id and the best alignment of each pair and window size that covers enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                # With sentences' first words as plain words alone, then as names too.
                plain = [w for w in row["windows"] if not w["reading"]]
                found = max(best_alignment(plain, row["total"], coverage) or (), best_alignment(row["windows"], row["total"], coverage) or ())
                if found:
                    out.append({"doc_id": row["doc_id"], "item_id": row["item_id"], **dict(zip(("coverage", "n_windows", "first", "n_slots", "kind"), found, strict=True))})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_windows", pa.int64()), ("first", pa.int64()), ("n_slots", pa.int64()), ("kind", pa.string())]))

    some = met.groupBy("doc_id", "item_id", "size").agg(F.count_distinct("item_place").alias("n"), F.max("total").alias("total"), F.collect_list(F.struct("shift", "item_place", "reading", "item_slots", "slots")).alias("windows"))
    enough = some.where(F.col("n") / F.col("total") >= coverage).select("doc_id", "item_id", "total", "windows")
    return enough.mapInArrow(run, "doc_id long, item_id long, coverage double, n_windows long, first long, n_slots long, kind string")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows matched, coverage, n_slots, kind: one row per leaked item of a document."""
    items = benchmark.select(F.col("item_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    theirs = materialise(template_windows(items, tuple(range(3, WINDOW + 1)), own_size=True).distinct(), "templates-items")
    sizes = tuple(sorted(r["size"] for r in theirs.select("size").distinct().collect()))  # at most WINDOW sizes
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, coverage double, n_slots long, kind string")
    bits = bitmap(theirs, F.shiftrightunsigned("h", 64 - BITMAP_BITS), BITMAP_BITS)
    mine = materialise(template_windows(docs, sizes, bits.tobytes()), "templates-windows")
    totals = theirs.groupBy("id", "size").agg(F.count_distinct("place").alias("total"))
    known = theirs.join(totals, ["id", "size"]).select(F.col("id").alias("item_id"), "h", "size", F.col("place").alias("item_place"), F.col("reading").alias("item_reading"), F.col("slots").alias("item_slots"), "total")
    met = spread_join(mine.withColumnRenamed("size", "own_size"), known, "h").where("size = own_size").select(F.col("id").alias("doc_id"), "item_id", "size", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", "total", F.greatest("item_reading", "reading").alias("reading"), "item_slots", "slots")
    hits = _aligned(met, coverage).select("doc_id", "item_id", F.struct("coverage", "n_windows", "first", "n_slots", "kind").alias("best"))
    return hits.groupBy("doc_id", "item_id").agg(F.max("best").alias("best")).select(F.nullif("doc_id", F.lit(int(NO_ID))).alias("doc_id"), F.nullif("item_id", F.lit(int(NO_ID))).alias("item_id"), "best.n_windows", "best.coverage", "best.n_slots", "best.kind")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leaked item, all columns."""
    key = spare_name(docs, "leaked_id")
    leaked = leaks(docs, benchmark).select(F.col("doc_id").alias(key)).distinct()
    return docs.join(leaked.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col(key), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
