"""Entities of texts with their exact places: addresses, names, acronyms, terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.functions.rolling import bitmap, has_bits, spans
from foliant.operators.references import containing


def located(texts: DataFrame, doc: str, text: str, pattern: str, group: int = 1) -> DataFrame:
    """doc, label, occurrence (from 0) of all matches of a pattern, in order."""
    found = F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).alias("occurrence", "label")
    return texts.select(F.col(doc).alias("doc"), found)


def mentions(texts: DataFrame, terms: DataFrame, doc: str, text: str, most: int = 200) -> DataFrame:
    """doc, term, char_start, char_end, span_sha256 of each term's places in its document's
    normalised text, at most ``most``. ``terms`` has columns doc and term."""
    joined = terms.join(texts.select(F.col(doc).alias("doc"), F.col(text).alias("_t")), "doc")
    at = F.slice(tx.positions(F.col("_t"), F.col("term")), 1, most)
    places = joined.select("doc", "term", "_t", F.explode(at).alias("char_start")).withColumn("char_end", F.col("char_start") + F.length("term"))
    return places.select("doc", "term", "char_start", "char_end", F.sha2(F.substring("_t", F.col("char_start") + 1, F.length("term")), 256).alias("span_sha256"))


def with_chapter(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Mentions with the chapter (spans: doc, char_first, char_last, chapter_id) that holds them."""
    return containing(found, spans, ["doc"], "char_start", "char_end", "char_first", "char_last", "chapter_id")


def preferred(found: DataFrame, by: list[str], text: Column) -> DataFrame:
    """Of each key's mentions the first that a definition follows, or else the first."""
    order = F.struct(F.when(tx.definition_like(text, F.col("char_end")), 0).otherwise(1), F.col("char_start"))
    return found.groupBy(*by).agg(F.min_by("char_start", order).alias("char_start"))


def evidence(found: DataFrame, source: Column, record: Column, field: Column) -> DataFrame:
    """Evidence references with ids from their content, one per place and field."""
    rows = found.withColumn("source_sha256", source).withColumn("record_sha256", record).withColumn("field", field)
    one = rows.dropDuplicates(["doc", "char_start", "char_end", "span_sha256", "field"])
    parts = [F.col(c).cast("string") for c in ("source_sha256", "record_sha256", "char_start", "char_end", "span_sha256", "field")]
    return one.withColumn("id", F.concat(F.lit("EV-"), F.upper(F.substring(F.sha2(F.array_join(F.array(*parts), "\x00"), 256), 1, 20))))


def verify_evidence(refs: DataFrame, texts: DataFrame, doc: str, text: str) -> DataFrame:
    """References with what is wrong: "missing_source", "out_of_bounds", "hash_mismatch"; none if all holds."""
    joined = refs.join(texts.select(F.col(doc).alias("doc"), F.col(text).alias("_t")), "doc", "left")
    span = F.substring("_t", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    reason = (
        F.when(F.col("_t").isNull(), "missing_source")
        .when((F.col("char_start") < 0) | (F.col("char_end") > F.length("_t")) | (F.col("char_end") <= F.col("char_start")), "out_of_bounds")
        .when(F.sha2(span, 256) != F.col("span_sha256"), "hash_mismatch")
    )
    return joined.withColumn("reason", reason).drop("_t")


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and links (absolute addresses in order) of each page."""
    return pages.select(key, F.regexp_extract_all(html, F.lit(r"""(?i)\bhref\s*=\s*["'](https?://[^"']+)["']"""), F.lit(1)).alias("links"))


def duplicate_addresses(rows: DataFrame, url: str) -> DataFrame:
    """host, port, path, query and n of addresses that several rows have once normalised (fragments don't count)."""
    same = ["host", "port", "path", "query"]
    parts = {k: c for k, c in tx.url_identity(F.col(url)).items() if k in same}
    return rows.select(*[c.alias(k) for k, c in parts.items()]).where("host IS NOT NULL").groupBy(*same).agg(F.count("*").alias("n")).where("n > 1")


#: Bits of the bitmap that texts' spans pass before they are joined with terms, two a term; of the table of terms' beginnings.
TERM_BITS, LEAD_BITS = 24, 16
#: Terms that are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 100_000
#: Characters of texts that are looked at together.
CHARS_AT_ONCE = 1 << 17


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _term_places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash."""
    return (h >> np.uint64(64 - TERM_BITS)).astype(np.int64), (h >> np.uint64(64 - 2 * TERM_BITS)).astype(np.int64) & ((1 << TERM_BITS) - 1)


def _leads(points: np.ndarray) -> np.ndarray:
    """A number below 2^LEAD_BITS for the three characters at each place."""
    x = points.astype(np.uint64)
    h = x[:-2] * np.uint64(0x9E3779B97F4A7C15) + x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + x[2:] * np.uint64(0x165667B19E3779F9)
    return (h >> np.uint64(64 - LEAD_BITS)).astype(np.int64)


class _Lookup:
    """What spans of texts are looked up in: the bitmap of terms' hashes, and which widths have a term with some beginning (the last bit is for all widths beyond)."""

    def __init__(self, terms: DataFrame, term: str, widths: list[int], plain: bool):
        bit = {width: min(k, 62) for k, width in enumerate(widths)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = [_points(x) for x in batch.column(0).to_pylist()]
                h = np.array([next(spans(x, [(len(x), np.zeros(1, np.int64))]))[2][0] for x in held], dtype=np.uint64)
                leads = pa.array([int(_leads(x[:3])[0]) if len(x) > 2 else None for x in held], pa.int64())
                yield pa.RecordBatch.from_arrays([*map(pa.array, _term_places(h)), leads, pa.array([1 << bit[len(x)] for x in held], pa.int64())], ["one", "two", "lead", "widths"])

        rows = terms.select(term).mapInArrow(run, "one long, two long, lead long, widths long")
        self.widths, self.bit, self.plain = widths, bit, plain
        self.bits = bitmap(rows.select(F.explode(F.array("one", "two")).alias("place")), F.col("place"), TERM_BITS)
        self.begun = np.zeros(1 << LEAD_BITS, dtype=np.int64)
        for r in rows.where("lead IS NOT NULL").groupBy("lead").agg(F.bit_or("widths").alias("widths")).collect():  # at most 2^LEAD_BITS
            self.begun[r["lead"]] = r["widths"]

    def found(self, points: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """width and places of spans that have a term's bits: whole words', or all; ``ends`` has the end of each place's text."""
        at = np.arange(len(points))
        if self.plain:
            inside = np.zeros(len(points) + 2, dtype=bool)
            inside[1:-1] = (points >= 97) & (points <= 122) | (points >= 48) & (points <= 57)
            at = np.flatnonzero(inside[1:-1] & ~inside[:-2])
        long = at[at < len(points) - 2]
        begun = self.begun[_leads(points)[long]]
        places = []
        for width in self.widths:
            mine = long[(begun >> self.bit[width] & 1).astype(bool)] if width > 2 else at
            mine = mine[mine + width <= ends[mine]]
            if self.plain:
                mine = mine[~inside[mine + width + 1]]
            places.append((width, mine))
        for width, mine, h in spans(points, places):
            one, two = _term_places(h)
            hit = np.flatnonzero(has_bits(self.bits, one))
            yield width, mine[hit[has_bits(self.bits, two[hit])]]


def _held(texts: list[str], lookups: list[_Lookup]) -> Iterator[tuple[int, str, bool]]:
    """Text's number, span and whether it is plain, of the spans that may be terms; a text's end is no character."""
    apart = np.full(1, 0x110000, dtype=np.uint32)
    points = np.concatenate([x for text in texts for x in (_points(text), apart)])
    sizes = np.array([len(x) for x in texts])
    stops = np.cumsum(sizes + 1) - 1
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    ends, starts = stops[owner], (stops - sizes).tolist()
    for lookup in lookups:
        for width, at in lookup.found(points, ends):
            whose = owner[at].tolist()
            for k, p in zip(whose, at.tolist(), strict=True):
                yield k, texts[k][p - starts[k] : p - starts[k] + width], lookup.plain


def grounded_pairs(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """key and the columns of ``terms`` (each term once) of the texts that hold a term, both normalised: every text against every term.

    A text's spans of the terms' lengths are hashed in place, for plain terms (ASCII letters and
    digits at the start) only those between word boundaries, where a term begins with the same
    characters, and pass a bitmap of fixed size made of the terms' hashes. What is left is joined
    with the terms themselves, so that it is exact: a row for each text and term, and no text is shuffled.
    """
    known = terms.where(F.length(term) > 0).withColumn("_plain", F.col(term).rlike(r"^[a-z0-9][a-z0-9 ._'’-]*$"))
    sizes = known.groupBy("_plain", F.length(term).alias("n")).agg(F.count("*").alias("terms")).collect()  # a row for each length
    lookups = []
    for kind in (True, False):
        widths = sorted(r["n"] for r in sizes if r["_plain"] == kind)
        if widths:
            lookups.append(_Lookup(known.where(F.col("_plain") == kind), term, widths, kind))
    held = texts.sparkSession.sparkContext.broadcast(lookups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0), [x or "" for x in batch.column(1).to_pylist()]
            cuts = np.cumsum([len(x) for x in values]) // CHARS_AT_ONCE
            for part in np.split(np.arange(len(values)), np.flatnonzero(np.diff(cuts)) + 1):
                found = dict.fromkeys((int(part[k]), span, kind) for k, span, kind in _held([values[k] for k in part.tolist()], held.value)) if len(part) else {}
                at, held_spans, kinds = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(held_spans, pa.string()), pa.array(kinds, pa.bool_())], [key, term, "_plain"])

    met = texts.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, {term} string, _plain boolean")
    small = sum(r["terms"] for r in sizes) <= BROADCAST_TERMS
    return met.join(F.broadcast(known) if small else known, [term, "_plain"]).select(key, *terms.columns)
