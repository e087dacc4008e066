"""People, terms and references of whole texts with exact places, as mentions and as catalogue items.

Texts are looked at in three views: as they are shown (labels), normalised
(places), and compact (print that sets every glyph apart). A mention is doc, kind,
label, url, char_start, char_end (in the normalised text), confidence, reason.
Normalised labels and the text's length are known where it is read; a catalogue takes them from there.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import entities as en
from foliant.functions import text as tx
from foliant.functions.hashing import upper_hex
from foliant.functions.records import labelled
from foliant.operators.catalog import with_chapter

#: The most places of a label or an item in an inventory of limited size (the first ones stay); queries ask for all.
MOST_PLACES = 200
#: Places that a batch holds, whatever the number of a label's places or a text's (its last row may hold more).
BATCH_PLACES = 8192
#: Order of kinds in a catalogue (fixed values).
KINDS = ("person", "term", "reference")


# What is looked for in which order, and where a limit holds: for places, or to the first one.
SHAPES = ("latin", "katakana", "kanji", "quoted", "defined", "acronym", "url", "doi")
_LIMITED, _FIRST = ("latin", "acronym", "url", "doi"), ("quoted", "defined")
#: Marks that end the sentence around an address.
_TRAILING = re.compile(r"[.,;:!?)\]}）】」』]+$")
_STOP_AHEAD = re.compile("^(?:%s) " % "|".join(re.escape(x) for x in sorted(en.NAME_STOP, key=lambda x: (-len(x), x))))
#: Shapes of names that are people or not by what follows each place.
_JUDGED = ("latin", "katakana", "kanji")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: A blank between single glyphs, where there are single blanks alone.
_JOINT = re.compile(rf" (?={tx.GLYPH}(?!\S))(?<=(?<!\S){tx.GLYPH} )")


def _starts(text: str, term: str, bounded: bool, most: int | None) -> list[int]:
    """Starts of non-overlapping occurrences of a term, all or the first ones: as words of their own, if it is plain and that is asked for."""
    found: list[int] = []
    bounded = bounded and not set(term) - _ALNUM
    at = text.find(term) if term else -1
    while at >= 0 and (most is None or len(found) < most):
        end = at + len(term)
        fits = not bounded or (at == 0 or text[at - 1] not in _ALNUM) and (end == len(text) or text[end] not in _ALNUM)
        if fits:
            found.append(at)
        at = text.find(term, end if fits else at + 1)
    return found


def _compact(flat: str) -> tuple[str, np.ndarray | None]:
    """``compacted`` of a text with single blanks alone; no places where each character stays where it is."""
    joints = [m.start() for m in _JOINT.finditer(flat)]
    return (_JOINT.sub("", flat), np.delete(np.arange(len(flat)), joints)) if joints else (flat, None)


def _labels(shown: str, shown_compact: str, compact: str, shapes: dict[str, re.Pattern]) -> Iterator[tuple[str, str]]:
    """shape and label of what texts hold, each once."""
    looked_at = {"latin": shown, "katakana": compact, "kanji": compact, "quoted": shown_compact, "defined": shown_compact, "acronym": shown_compact, "url": shown, "doi": shown}
    # What a shape can't do without is looked for first.
    absent = {"url": "://" not in shown, "doi": "10." not in shown} | dict.fromkeys(("katakana", "kanji", "quoted", "defined"), compact.isascii() and shown_compact.isascii())
    for shape in SHAPES:
        if absent.get(shape):
            continue
        found = dict.fromkeys(shapes[shape].findall(looked_at[shape]))
        if shape == "latin":
            found = dict.fromkeys(_STOP_AHEAD.sub("", x) for x in found)
        elif shape in ("url", "doi"):
            found = dict.fromkeys(_TRAILING.sub("", x) for x in found)
        for label in found:
            if not (shape == "latin" and label in en.NAME_STOP or shape == "acronym" and en.no_acronym(label)):
                yield shape, label


def _views(text: str) -> tuple[str, str]:
    """``flattened`` and ``normalized`` text by one normalisation: case folding makes no white space."""
    shown = tx.flattened(text)
    return shown, shown.casefold()


def _places(shown: str, norm: str, shapes: dict[str, re.Pattern], most: int | None) -> Iterator[tuple[str, str, str, list[int], list[int], Iterator[str] | None]]:
    """shape, label, key, starts and ends in the normalised text (ascending) of all that a text may mention, and what follows (compact) where that decides."""
    shown_compact, (compact, offsets) = _compact(shown)[0], _compact(norm)
    limits = {} if most is None else dict.fromkeys(_LIMITED, most) | dict.fromkeys(_FIRST, 1)
    for shape, label in _labels(shown, shown_compact, compact, shapes):
        key, after = tx.normalized(label), None
        if shape in ("latin", "url", "doi"):
            named = f"https://doi.org/{key}" if shape == "doi" else key
            starts = _starts(norm, key, False, limits.get(shape))
            ends = [at + len(key) for at in starts]
            if shape in _JUDGED:
                after = (_compact(norm[end : end + 100].strip(" "))[0] for end in ends)
        else:
            named, term = key, label if shape in _JUDGED else _compact(key)[0]
            starts = _starts(compact, term, shape not in _JUDGED, limits.get(shape))
            ends = [at + len(term) for at in starts]
            if shape in _JUDGED:
                after = (compact[end : end + 80] for end in ends)
            if offsets is not None:
                starts, ends = [int(offsets[at]) for at in starts], [int(offsets[end - 1]) + 1 for end in ends]
        if starts:
            yield shape, label, named, starts, ends, after


def _rows(places: tuple[str, str, str, list[int], list[int], Iterator[str] | None], summed: bool) -> Iterator[tuple[str, str, str, int, int, str, list[int] | None]]:
    """A row for each place; ``summed``: one for all of a label that are meant or not alike."""
    *named, starts, ends, after = places
    if summed and after is None:
        yield *named, starts[0], ends[-1], "", starts
    else:
        for at, end, text in zip(starts, ends, after or repeat("", len(starts)), strict=True):
            yield *named, at, end, text, [at] if summed else None


def _batches(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Rows in order, as many at once as hold ``BATCH_PLACES``."""
    some, n = [], 0
    for row in rows:
        some.append(row)
        n += len(row[-1]) if row[-1] else 1
        if n >= BATCH_PLACES:
            yield some
            some, n = [], 0
    if some:
        yield some


def mentions(texts: DataFrame, doc: str, text: str, vertical: bool = False, summed: bool = False, most: int | None = MOST_PLACES) -> DataFrame:
    """Mentions of people, terms and references of each text.

    A text is read once, in a task that holds one batch; its views don't leave it, only what
    was found there does. Which Latin and Japanese names are people is decided by what follows them.
    ``summed``: for a catalogue, with key (the normalised label, a reference's address), n_chars (of the normalised text)
    and starts; all places of a label are one row, from the first start to the last end, if what follows them decides nothing.
    ``most``: None for all places of all labels. A number is the limit of an inventory: so many of a Latin name, an acronym
    or an address are looked at, and a defined term stands for its first place.
    """
    kana, kanji = (en.VERTICAL_KATAKANA_NAME, en.VERTICAL_KANJI_NAME) if vertical else (tx.KATAKANA_NAME, tx.KANJI_NAME)
    # As in Java, classes and case are those of ASCII.
    shapes = {k: re.compile(x, re.ASCII) for k, x in zip(SHAPES, (tx.PERSON, kana, kanji, tx.QUOTED_TERM, en.DEFINED_TERM, tx.ACRONYM, tx.URL, tx.DOI), strict=True)}

    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                views = ((k, *_views(value)) for k, value in enumerate(part.column(1).to_pylist()) if value)
                rows = ((k, len(norm), *row) for k, shown, norm in views for x in _places(shown, norm, shapes, most) for row in _rows(x, summed))
                for some in _batches(rows):
                    at, *columns = zip(*some, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *map(pa.array, columns, kinds)], ["doc", "n_chars", "shape", "found", "key", "char_start", "char_end", "after", "starts"])

    key = texts.schema[doc].dataType.simpleString()
    seen = texts.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc {key}, n_chars long, shape string, found string, key string, char_start long, char_end long, after string, starts array<long>")
    found, after, shape = F.col("found"), F.col("after"), F.col("shape")
    fits = {"latin": en.latin_person(after, vertical), "katakana": en.japanese_person(found, after, False, vertical), "kanji": en.japanese_person(found, after, True, vertical)}
    if vertical:
        fits |= {"quoted": en.quoted_term_label(found), "defined": en.defined_term_label(found)}
    meant = F.coalesce(*[F.when(shape == k, F.coalesce(c, F.lit(False))) for k, c in fits.items()], F.lit(True))
    reasons = {
        "latin": "latin_multi_token_name_shape", "katakana": "vertical_katakana_person_context" if vertical else "katakana_attribution_context",
        "kanji": "vertical_kanji_person_marker" if vertical else "kanji_attribution_context", "quoted": "vertical_quoted_definition_shape" if vertical else "quoted_definition_shape",
        "defined": "vertical_definition_shape" if vertical else "definition_shape", "acronym": "uppercase_acronym_shape", "url": "explicit_http_url", "doi": "explicit_doi",
    }
    label = F.when(shape == "url", F.regexp_replace(F.regexp_replace(found, r"(?i)^https?://", ""), r"/?(?:[?#].*)?$", "")).when(shape == "doi", F.concat(F.lit("DOI "), found)).otherwise(found)
    url = F.when(shape == "url", found).when(shape == "doi", F.col("key")).otherwise("")
    kind = F.when(shape.isin("latin", "katakana", "kanji"), "person").when(shape.isin("url", "doi"), "reference").otherwise("term")
    confidence = F.when(shape.isin("url", "doi"), "high").when(shape.isin("latin", "quoted", "defined"), "medium").otherwise("low")
    return seen.where(meant).select("doc", kind.alias("kind"), label.alias("label"), url.alias("url"), "char_start", "char_end", confidence.alias("confidence"), labelled(shape, reasons, "").alias("reason"), *["key", "n_chars", "starts"] * summed)


def items(found: DataFrame, spans: DataFrame | None = None, most: int | None = MOST_PLACES) -> DataFrame:
    """Mentions as catalogue items in order: doc, place, kind, label, url, chapter_id, n_places, first_start, reasons, item_id.

    A person is an item of its chapter, a term one of the chapter of its first
    mention there, a reference one of the book. ``spans`` has doc, char_first, char_last, chapter_id;
    without them mentions say their chapter_id, and may be summed up. Only mentions without a key are normalised.
    ``most``: how many of an item's places it lists (n_places counts all that are there); None for all.
    One grouping by what makes an item: tasks that find mentions sum them up before they are dealt out.
    """
    if spans is not None and "starts" in found.columns:
        raise ValueError("Places that are summed up can't be told apart by spans.")
    placed = found if spans is None else with_chapter(found, spans)
    kind, chapter = F.col("kind"), F.col("chapter_id").cast("string")
    if "key" not in found.columns:
        placed = placed.withColumn("key", tx.normalize_text(F.when(kind == "reference", F.col("url")).otherwise(F.col("label"))))
    keyed = placed.withColumn("own", F.when(kind == "person", F.coalesce(chapter, F.lit(""))).otherwise(""))
    # Places of two spellings may be the same: the order is one of all that is told apart.
    order = F.struct("char_start", "reason", "label", "url")
    earliest = F.struct(F.when(chapter.isNotNull(), 0).otherwise(1).alias("unresolved"), F.col("char_start"), F.col("reason"), chapter.alias("chapter"))
    starts = F.sort_array(F.array_distinct(F.flatten(F.collect_list("starts"))) if "starts" in placed.columns else F.collect_set("char_start"))
    grouped = keyed.groupBy("doc", "kind", "key", "own").agg(
        F.min(earliest).alias("earliest"), F.min(order).alias("first"), F.size(starts).alias("n_places"), F.element_at(starts, 1).alias("first_start"), (starts if most is None else F.slice(starts, 1, most)).alias("places"), F.sort_array(F.collect_set("reason")).alias("reasons")
    )
    grouped = grouped.withColumns({"label": F.col("first.label"), "url": F.col("first.url"), "chapter": F.when(kind == "term", F.coalesce("earliest.chapter", F.lit(""))).otherwise(F.col("own"))})
    content = F.array_join(F.array("kind", "key", "chapter", "url"), "\x00")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(rank, "chapter", "key"))
    return grouped.withColumn("item_id", F.concat(F.lit("CI-"), upper_hex(content, 20))).withColumn("place", place).select("doc", "place", "kind", "label", "url", F.col("chapter").alias("chapter_id"), "n_places", "first_start", "places", "reasons", "item_id")


def context_targets(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Items whose context is to be written, in order: the kinds in turn, unresolved ones last, those with more places first, then by label."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    order = Window.partitionBy("doc").orderBy(rank, F.when(F.col("chapter_id") == "", 1).otherwise(0), F.col("n_places").desc(), "label", "item_id")
    rows = found.where("kind <> 'reference'").withColumn("target", F.row_number().over(order))
    return rows if limit is None else rows.where(F.col("target") <= limit)
