"""Selections and projections of records: what is approved, in scope, required, changed, missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def approved_rules(rows: DataFrame, by: list[str], order: list[str], approved: Column) -> DataFrame:
    """Approved rows numbered in each group; a group with drafts alone has one row with number 0 and nulls elsewhere."""
    others = [c for c in rows.columns if c not in by]
    numbered = rows.where(approved).withColumn("number", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    drafts = rows.groupBy(*by).agg(F.count_if(approved).alias("n")).where("n = 0").select(*by, *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in others], F.lit(0).cast("long").alias("number"))
    return numbered.select(*by, *others, "number").unionByName(drafts)


def generation_gaps(modules: DataFrame, records: DataFrame, keys: list[str], mode: Column, filled: Column) -> DataFrame:
    """Modules with ``unfilled``: they are to be generated and have no filled record."""
    there = records.where(filled).select(*keys).distinct().withColumn("has_record", F.lit(True))
    return modules.withColumn("to_do", mode == "generate").join(there, keys, "left").withColumn("unfilled", F.col("to_do") & F.col("has_record").isNull()).drop("to_do", "has_record")


def actionable(rows: DataFrame, reference: Column, chapter: Column) -> tuple[DataFrame, DataFrame]:
    """Items with a reference or a resolved chapter, and one row with the number of the others (``dropped``)."""
    fine = F.coalesce(reference, F.lit(False)) | F.coalesce(chapter, F.lit(False))
    return rows.where(fine), rows.agg(F.count_if(~fine).alias("dropped"))


def without_stop_words(rows: DataFrame, label: str, stop_list: DataFrame, stop_label: str, prefixes: list[str]) -> DataFrame:
    """Rows whose normalised label isn't on the stop list, leading stop words taken off, the longest that fits; rows of which nothing is left go too."""
    known = stop_list.select(F.lower(F.trim(stop_label)).alias("stop_key")).distinct()
    kept = rows.withColumn("stop_key", F.lower(F.trim(label))).join(known, "stop_key", "left_anti").drop("stop_key")
    pattern = "(?i)^(?:" + "|".join(rf"\Q{x}\E" for x in sorted(prefixes, key=lambda x: (-len(x), x))) + r")\s+"
    cut = F.regexp_replace(F.col(label), pattern, "") if prefixes else F.col(label)
    return kept.withColumn(label, F.trim(cut)).where(F.length(label) > 0)


def companions(rows: DataFrame, declared: dict[str, object]) -> DataFrame:
    """Rows in which every one of some fields has its declared value."""
    for field, value in declared.items():
        rows = rows.where(F.col(field).eqNullSafe(F.lit(value)))
    return rows


def in_scope(rows: DataFrame, module: str, modules: list[str] | None = None, record_id: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Rows of some modules, and of some records (``ids`` has the column ``record_id``); no limit where none is given."""
    if modules is not None:
        rows = rows.where(F.col(module).isin(*modules)) if modules else rows.limit(0)
    return rows if ids is None else rows.join(ids.select(record_id).distinct(), record_id, "left_semi")


def changed_fields(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys with ``change`` (added, removed, changed, same) and the names of the fields that differ."""
    a = old.select(*keys, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("was"))
    b = new.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("is"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), f) for f in fields]))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.size(names) > 0, "changed").otherwise("same")
    return a.join(b, keys, "full").select(*keys, change.alias("change"), names.alias("changed"))


def effective_modules(required: DataFrame, overrides: DataFrame, key: str, module: str, mode: str) -> DataFrame:
    """key and module of what a profile requires, with overrides "add" and "remove" applied; removing comes first."""
    take, give = (overrides.where(F.col(mode) == x).select(key, module).distinct() for x in ("remove", "add"))
    return required.select(key, module).join(take, [key, module], "left_anti").unionByName(give).distinct()


def baseline(rows: DataFrame, key: list[str], counts: dict[str, Column]) -> DataFrame:
    """What a work item starts from: its key and counts alone, no text."""
    return rows.select(*key, *[c.cast("long").alias(name) for name, c in counts.items()])


def optional_sections(sections: DataFrame, records: DataFrame, section_key: str, record_key: str) -> DataFrame:
    """Sections that have at least one record."""
    return sections.join(records.select(F.col(record_key).alias(section_key)).distinct(), section_key, "left_semi")


def lacking_required(rows: DataFrame, kind: str, field: str, exempt: DataFrame) -> DataFrame:
    """Rows without a field that their kind needs; ``exempt`` has (field, kind) pairs that don't."""
    free = exempt.where(F.col("field") == field).select(F.col("kind").alias(kind)).distinct()
    empty = F.col(field).isNull() | (F.trim(F.col(field).cast("string")) == "")
    return rows.where(empty).join(F.broadcast(free), kind, "left_anti")  # a contract's pairs: a few dozen
