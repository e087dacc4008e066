"""Candidates for records, made from a catalogue, and the work that they settle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.hashing import upper_hex
from foliant.functions.records import labelled

# The collection and the main field of each kind of item.
COLLECTIONS = {"person": ("names", "name"), "term": ("glossary", "term"), "reference": ("references", "label")}
#: States of a candidate from which a reviewer may accept it.
OPEN = ("ready",)


def candidate_id(*parts: Column) -> Column:
    return F.concat(F.lit("CA-"), upper_hex(F.array_join(F.array(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), "\x00"), 20))


def from_catalog(items: DataFrame, run: str) -> DataFrame:
    """Catalogue items as candidates: run, doc, candidate_id, collection, record_id, fields, chapter_id, state, reasons.

    A candidate is "quarantined" with its reasons where the label is too long or
    a person or term belongs to no chapter, else "ready". Ids depend on content,
    so the same catalogue gives the same candidates.
    """
    collection = labelled(F.col("kind"), {k: x for k, (x, _) in COLLECTIONS.items()}, "references")
    main = labelled(F.col("kind"), {k: x for k, (_, x) in COLLECTIONS.items()}, "label")
    fields = F.map_filter(F.map_from_arrays(F.array(main, F.lit("chapter_id"), F.lit("url"), F.lit("status")), F.array("label", "chapter_id", "url", F.lit("draft"))), lambda k, v: v != "")
    reasons = F.array_compact(F.array(F.when(F.length("label") > 200, "too_long"), F.when((F.col("kind") != "reference") & (F.col("chapter_id") == ""), "unresolved_chapter")))
    rows = items.withColumn("collection", collection).withColumn("fields", fields).withColumn("reasons", reasons)
    record = F.concat(labelled(F.col("kind"), {k: x[:3].upper() for k, (x, _) in COLLECTIONS.items()}, "REF"), F.lit("-"), upper_hex(F.col("item_id"), 12))
    ids = candidate_id(F.lit(run), F.col("doc"), F.col("item_id"))
    return rows.select(F.lit(run).alias("run"), "doc", ids.alias("candidate_id"), "collection", record.alias("record_id"), "fields", "chapter_id", F.when(F.size("reasons") > 0, "quarantined").otherwise("ready").alias("state"), "reasons")


def ledger(candidates: DataFrame, chapters: DataFrame, modules: list[str]) -> DataFrame:
    """Work items (doc, module, chapter_id) with the candidates that settle them: "generated", or "not_applicable" with a reason where there are none."""
    grid = chapters.select("doc", "chapter_id").distinct().withColumn("module", F.explode(F.array(*[F.lit(x) for x in modules])))
    mine = candidates.where(F.col("state").isin(*OPEN)).groupBy("doc", F.col("collection").alias("module"), "chapter_id").agg(F.sort_array(F.collect_list("candidate_id")).alias("candidate_ids"))
    joined = grid.join(mine, ["doc", "module", "chapter_id"], "left")
    return joined.select("doc", "module", "chapter_id", F.when(F.col("candidate_ids").isNull(), "not_applicable").otherwise("generated").alias("status"), F.when(F.col("candidate_ids").isNull(), "no_candidate").otherwise("").alias("reason_code"), F.coalesce("candidate_ids", F.array().cast("array<string>")).alias("candidate_ids"))


def from_contexts(targets: DataFrame, answers: DataFrame, field: str, most: int = 500) -> DataFrame:
    """Targets' answers (item_id, text) as candidates' fields: ``state`` "ready", or "quarantined" where the answer is missing, repeated, too long or unsafe."""
    once = answers.groupBy("doc", "item_id").agg(F.count("*").alias("n"), F.first("text").alias("text"))
    joined = targets.join(once, ["doc", "item_id"], "left")
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n").isNull(), "missing"),
            F.when(F.col("n") > 1, "repeated"),
            F.when(F.length(text) > most, "too_long"),
            F.when(F.col("text").rlike(r"[\x{00}-\x{08}\x{0b}-\x{1f}\x{202a}-\x{202e}\x{2066}-\x{2069}]"), "unsafe_text"),
        )
    )
    return joined.withColumn("reasons", reasons).withColumn(field, text).withColumn("state", F.when(F.size("reasons") > 0, "quarantined").otherwise("ready")).drop("n", "text")


def from_questions(items: DataFrame, kinds: list[str]) -> DataFrame:
    """Classified questions (doc, source_key, kind, facets as a map) of some kinds as candidates for misreadings; an unclassified one is none."""
    ids = candidate_id(F.col("doc"), F.col("source_key"), F.col("kind"))
    empty = F.size(F.map_filter("facets", lambda k, v: F.length(F.trim(v)) > 0)) == 0
    rows = items.where(F.col("kind").isin(*kinds))
    return rows.select("doc", ids.alias("candidate_id"), F.lit("misreadings").alias("collection"), "kind", "facets", F.when(empty, "quarantined").otherwise("ready").alias("state"))
