"""Import plans: extracted structure as units with stable ids, reviewed, then merged into the canonical chapters.

Everything is keyed by ``doc``, so that many documents are planned and applied
at once. A plan holds headings alone, no text. ``chapters`` are what
``extract`` gives: doc, format, place (from 1), chapter_id, title, pages, sections (a list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.functions.entities import PLAIN_HEADING
from foliant.functions.records import first_rule
from foliant.operators.lineage import checkpointed
from foliant.operators.references import merge_match, union

#: The longest heading, and the most units of a plan (limits of the plan).
MOST_HEADING, MOST_UNITS = 500, 2_000
# Kinds by title or id.
_KINDS = (
    ("frontmatter", ("CH-PREFACE", "CH-FOREWORD"), ("preface", "foreword", "まえがき", "序文"), ()),
    ("afterword", ("CH-AFTERWORD", "CH-EPILOGUE"), ("afterword", "あとがき"), ()),
    ("appendix", (), (), ("appendix", "付録")),
    ("notes", ("CH-NOTES",), ("notes", "endnotes", "注", "註"), ()),
)
# How far each format's structure can be trusted.
CONFIDENCE = {"markdown": "high", "org": "high", "epub3": "high", "pdf": "medium", "pdf-vertical": "medium", "text": "low"}
HEURISTIC = ("pdf", "pdf-vertical", "text")
_ID = r"^CH-[A-Z0-9][A-Z0-9.-]*$"


def safe_heading(c: Column) -> Column:
    """A heading on one line without control characters; null if nothing is left or it is too long."""
    line = F.trim(F.regexp_replace(F.regexp_replace(c, tx.UNSAFE.replace(r"\x{00}-\x{1f}", r"\x{00}-\x{08}\x{0e}-\x{1f}"), ""), r"\s+", " "))
    return F.when(F.length(line).between(1, MOST_HEADING), line)


def unit_kind(chapter_id: Column, title: Column) -> Column:
    """frontmatter, afterword, appendix, notes or chapter, by id and title."""
    key, norm = F.upper(F.coalesce(chapter_id, F.lit(""))), F.lower(F.trim(title))
    rules = [(F.startswith(key, F.lit("CH-APP")), "appendix")]
    for kind, ids, titles, starts in _KINDS:
        for test in [*([key.isin(*ids)] if ids else []), *([norm.isin(*titles)] if titles else []), *[F.startswith(norm, F.lit(x)) for x in starts]]:
            rules.append((test, kind))
    return first_rule(rules, "chapter")


def without_prose(chapters: DataFrame) -> DataFrame:
    """Chapters without the plain-text reader's fallback, which takes a line of prose for a heading."""
    return chapters.where((F.col("format") != "text") | F.coalesce(safe_heading(F.col("title")).rlike(PLAIN_HEADING), F.lit(False)))


def _unit_id(kind: Column, parent: Column, norm: Column, occurrence: Column) -> Column:
    return F.concat(F.lit("U-"), F.upper(F.substring(F.sha2(F.array_join(F.array(kind, F.coalesce(parent, F.lit("")), norm, occurrence.cast("string")), "\x00"), 256), 1, 16)))


def plan(chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The units of each document and its diagnostics.

    Units: doc, staging_id, kind, parent_id, place, title, source_key, pages, confidence.
    Ids depend on kind, parent, title and which one of its equals a unit is, so
    that the same source gives the same plan. Diagnostics: doc, severity, code, unit.
    """
    key = F.lower(F.col("title"))
    held = without_prose(chapters).withColumn("raw", F.col("title")).withColumn("title", safe_heading(F.col("title")))
    named = held.where("title IS NOT NULL").withColumn("kind", unit_kind(F.col("chapter_id"), F.col("title"))).withColumn("norm", key)
    same = Window.partitionBy("doc", "kind", "norm")
    root = _unit_id(F.lit("book"), F.lit(None).cast("string"), F.lit("document-root"), F.lit(1))
    top = named.withColumn("occurrence", F.row_number().over(same.orderBy("place"))).withColumn("twins", F.count("*").over(same)).withColumn("parent_id", root)
    top = top.withColumn("staging_id", _unit_id(F.col("kind"), F.col("parent_id"), F.col("norm"), F.col("occurrence")))
    trust = first_rule([(F.col("twins") > 1, "conflict"), *[(F.col("format") == k, v) for k, v in CONFIDENCE.items()]], "low")
    columns = ["doc", "staging_id", "kind", "parent_id", "place", "title", "source_key", "pages", "confidence"]
    tops = top.withColumn("confidence", trust).withColumn("source_key", F.coalesce("chapter_id", F.lit(""))).withColumn("place", F.col("place").cast("int"))
    inner = tops.select("doc", F.col("staging_id").alias("parent_id"), "format", F.posexplode("sections").alias("at", "raw")).withColumn("title", safe_heading(F.col("raw")))
    sections = inner.where("title IS NOT NULL").withColumn("norm", key).withColumn("occurrence", F.row_number().over(Window.partitionBy("doc", "parent_id", "norm").orderBy("at")))
    sections = sections.withColumn("kind", F.lit("section")).withColumn("staging_id", _unit_id(F.lit("section"), F.col("parent_id"), F.col("norm"), F.col("occurrence")))
    by_format = first_rule([(F.col("format") == k, v) for k, v in CONFIDENCE.items()], "low")
    sections = sections.withColumn("place", F.col("at") + 1).withColumn("source_key", F.lit("")).withColumn("pages", F.lit("")).withColumn("confidence", by_format)
    books = chapters.select("doc", "format").distinct().select("doc", root.alias("staging_id"), F.lit("book").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("place"), F.lit("").alias("title"), F.lit("").alias("source_key"), F.lit("").alias("pages"), by_format.alias("confidence"))
    units = books.select(*columns).unionByName(tops.select(*columns)).unionByName(sections.select(*columns))

    note = lambda rows, severity, code, unit: rows.select("doc", F.lit(severity).alias("severity"), F.lit(code).alias("code"), unit.alias("unit"))
    none = F.lit(None).cast("string")
    counted = units.groupBy("doc").agg(F.count("*").alias("n"), F.count_if(~F.col("kind").isin("book", "section")).alias("navigable"))
    formats = chapters.select("doc", "format").distinct().join(counted, "doc")
    diagnostics = union(
        note(held.where("title IS NULL"), "warning", "RPIP103", none),
        note(inner.where("title IS NULL"), "warning", "RPIP103", F.col("parent_id")),
        note(tops.where("twins > 1"), "error", "RPIP201", F.col("staging_id")),
        note(formats.where("navigable = 0"), "error", "RPIP200", none),
        note(formats.where(F.col("n") > MOST_UNITS), "error", "RPIP202", none),
        note(formats.where((F.col("navigable") > 0) & F.col("format").isin(*HEURISTIC)), "warning", "RPIP100", none),
    )
    return units, diagnostics


def outcomes(units: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """doc and outcome: "blocked" by an error, "review_required" where the structure was guessed, else "ready"."""
    said = diagnostics.groupBy("doc").agg(F.bool_or(F.col("severity") == "error").alias("wrong"), F.bool_or(F.col("code") == "RPIP100").alias("guessed"))
    docs = units.select("doc").distinct().join(said, "doc", "left")
    return docs.select("doc", F.when(F.col("wrong"), "blocked").when(F.col("guessed"), "review_required").otherwise("ready").alias("outcome"))


def outline(rows: DataFrame, doc: str, line: str, place: str) -> DataFrame:
    """Chapters from lines of a manual outline: "CH-01 | title | pages" heads a chapter, "- title" adds a section to it."""
    shaped = rows.select(F.col(doc).alias("doc"), F.col(place).alias("at"), F.split(F.trim(line), r"\s*\|\s*").alias("f"), F.regexp_extract(F.trim(line), r"^-\s+(.+)$", 1).alias("section"))
    heads = F.col("f")[0].rlike(_ID) & (F.size("f") >= 2)
    numbered = shaped.withColumn("place", F.count_if(heads).over(Window.partitionBy("doc").orderBy("at")))
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("section") != "", F.struct("at", "section")))), lambda x: x["section"])
    head = lambda k: F.max(F.when(heads, F.coalesce(F.try_element_at("f", F.lit(k)), F.lit(""))))
    return numbered.where("place > 0").groupBy("doc", "place").agg(head(1).alias("chapter_id"), head(2).alias("title"), head(3).alias("pages"), listed.alias("sections")).withColumn("format", F.lit("markdown"))


def apply_plan(units: DataFrame, existing: DataFrame, manual: bool = False) -> tuple[DataFrame, DataFrame]:
    """The canonical chapters after a plan, and what stands in its way.

    ``existing`` has doc, id, kind, title, pages, sections, summary, status. Units
    match an existing chapter by id (a manual outline) or by kind and title.
    A matched chapter keeps its id and summary and is a draft again where its
    structure changed; a new one gets its own id, or the next free CH-number.
    Ambiguous and reused matches, and existing chapters that nothing matches, are
    findings (doc, code, subject); the plan must not be applied while there are any.
    """
    units = checkpointed(units)  # read by several branches below
    tops = units.where(~F.col("kind").isin("book", "section"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("place", "title"))), lambda x: x["title"])
    inner = units.where("kind = 'section'").groupBy(F.col("doc").alias("d"), F.col("parent_id").alias("p")).agg(listed.alias("sections"))
    proposed = tops.join(inner, (tops["doc"] == F.col("d")) & (tops["staging_id"] == F.col("p")), "left").withColumn("sections", F.coalesce("sections", F.array().cast("array<string>"))).drop("d", "p")

    scope = lambda c: F.concat_ws("\x00", F.col("doc").cast("string"), c)
    theirs = existing.select(scope(F.col("id")).alias("unit"), scope(F.col("kind")).alias("kind"), "title")
    mine = proposed.select(scope(F.when(F.col("source_key").rlike(_ID), F.col("source_key")).otherwise(F.col("staging_id"))).alias("unit"), scope(F.col("kind")).alias("kind"), "title", scope(F.col("staging_id")).alias("staged"))
    by_name = merge_match(mine.select(F.col("staged").alias("unit"), "kind", "title"), theirs, "unit", "kind", "title")
    if manual:
        by_id = merge_match(mine.select("unit", "kind", "title"), theirs, "unit", "kind", "title", by_id=True).where("matched IS NOT NULL")
        direct = mine.join(by_id.select("unit", F.col("matched").alias("by_id")), "unit").select(F.col("staged").alias("unit"), "by_id")
        by_name = by_name.join(direct, "unit", "left").select("unit", F.coalesce("by_id", "matched").alias("matched"), F.when(F.col("by_id").isNotNull(), "matched").otherwise(F.col("state")).alias("state"))
    found = proposed.withColumn("unit", scope(F.col("staging_id"))).join(by_name, "unit").drop("unit")

    old = existing.select(scope(F.col("id")).alias("matched"), F.col("id").alias("old_id"), *[F.col(c).alias(f"old_{c}") for c in ("kind", "title", "pages", "sections", "summary", "status")])
    found = checkpointed(found)
    joined = checkpointed(found.join(old, "matched", "left"))
    # New chapters: their own id if it is free, else the next number that no chapter of the document has.
    own = joined.where("old_id IS NULL").withColumn("own", F.when(F.col("source_key").rlike(_ID), F.col("source_key")))
    taken = own.join(existing.select("doc", F.col("id").alias("own")), ["doc", "own"], "left_semi").select("doc", "own").distinct().withColumn("is_taken", F.lit(True))
    first = Window.partitionBy("doc", "own").orderBy("place")
    own = own.join(taken, ["doc", "own"], "left").withColumn("own", F.when(F.col("is_taken").isNull() & (F.row_number().over(first) == 1), F.col("own")))
    occupied = existing.select("doc", "id").unionByName(own.where("own IS NOT NULL").select("doc", F.col("own").alias("id"))).distinct()
    totals = occupied.groupBy("doc").agg(F.count("*").alias("n_old"))
    waiting = own.where("own IS NULL").withColumn("turn", F.row_number().over(Window.partitionBy("doc").orderBy("place")))
    needed = waiting.groupBy("doc").agg(F.count("*").alias("n_new")).join(totals, "doc", "left")
    numbers = needed.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_new") + F.coalesce("n_old", F.lit(0)))).alias("k")).select("doc", "k", F.concat(F.lit("CH-"), F.when(F.col("k") < 10, F.lpad(F.col("k").cast("string"), 2, "0")).otherwise(F.col("k").cast("string"))).alias("id"))
    free = numbers.join(occupied, ["doc", "id"], "left_anti").withColumn("turn", F.row_number().over(Window.partitionBy("doc").orderBy("k"))).select("doc", "turn", "id")
    given = own.where("own IS NOT NULL").select("doc", "staging_id", F.col("own").alias("id")).unionByName(waiting.join(free, ["doc", "turn"]).select("doc", "staging_id", "id"))

    changed = F.lit(False)
    for c in ("kind", "title", "pages", "sections"):
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    named = joined.join(given, ["doc", "staging_id"], "left").withColumn("id", F.coalesce("old_id", "id"))
    status = F.when(F.col("old_id").isNull() | changed, "draft").otherwise(F.col("old_status"))
    records = named.select("doc", "id", "place", "kind", "title", "pages", "sections", F.coalesce("old_summary", F.lit("")).alias("summary"), status.alias("status"))
    left = existing.select("doc", "id").join(named.where("old_id IS NOT NULL").select("doc", F.col("old_id").alias("id")), ["doc", "id"], "left_anti")
    touched = left.join(units.select("doc").distinct(), "doc", "left_semi")
    findings = union(
        found.where("state = 'ambiguous'").select("doc", F.lit("RPIP301").alias("code"), F.col("staging_id").alias("subject")),
        found.where("state = 'reused'").select("doc", F.lit("RPIP302").alias("code"), F.col("staging_id").alias("subject")),
        touched.select("doc", F.lit("RPIP303").alias("code"), F.col("id").alias("subject")),
    )
    return records, findings


def direct_import(chapters: DataFrame, existing: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Draft chapters straight from extraction, and the documents refused: those that have chapters already, unless forced."""
    refused = chapters.select("doc").distinct().join(existing.select("doc").distinct(), "doc", "left_semi")
    taken = chapters if force else chapters.join(refused, "doc", "left_anti")
    number = F.row_number().over(Window.partitionBy("doc").orderBy("place")).cast("string")
    fresh = F.concat(F.lit("CH-"), F.when(F.length(number) < 2, F.lpad(number, 2, "0")).otherwise(number))
    named = taken.withColumn("title", safe_heading(F.col("title"))).where("title IS NOT NULL").withColumn("id", F.when(F.col("chapter_id").rlike(_ID), F.col("chapter_id")).otherwise(fresh))
    records = named.select("doc", "id", "place", unit_kind(F.col("chapter_id"), F.col("title")).alias("kind"), "title", F.coalesce("pages", F.lit("")).alias("pages"), "sections", F.lit("").alias("summary"), F.lit("draft").alias("status"))
    return records, refused.limit(0) if force else refused
