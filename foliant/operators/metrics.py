"""Counts, states and rates over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_pivot(rows: DataFrame, by: list[str], state: str, states: list[str]) -> DataFrame:
    """Total and one count per state, in one pass."""
    counts = [F.count_if(F.col(state) == s).alias(f"n_{s.lower()}") for s in states]
    return rows.groupBy(*by).agg(F.count("*").alias("total"), *counts)


def coverage_state(total: Column, pending: Column, generated: Column) -> Column:
    """"incomplete" if work is pending, "fully_generated" if all is generated, else "fully_accounted"."""
    return F.when(pending > 0, "incomplete").when((total > 0) & (generated == total), "fully_generated").otherwise("fully_accounted")


def rates(matched: Column, observed: Column, expected: Column) -> tuple[Column, Column]:
    """Precision and recall; null where nothing was observed or expected."""
    return F.when(observed > 0, matched / observed), F.when(expected > 0, matched / expected)


def first_by(rows: DataFrame, by: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """Per key the columns of its first row in an order, by one aggregation."""
    picked = F.min_by(F.struct(*columns), F.struct(*order)).alias("_p")
    return rows.groupBy(*by).agg(picked).select(*by, "_p.*")


def catalog_items(mentions: DataFrame, most: int = 200) -> DataFrame:
    """Mentions (kind, norm, chapter, url, label, pos, reason) as items: the first
    label, at most ``most`` places, reasons in order, the number of places."""
    places = F.sort_array(F.collect_set("pos"))
    return mentions.groupBy("kind", "norm", "chapter", "url").agg(
        F.min_by("label", "pos").alias("label"), F.slice(places, 1, most).alias("places"), F.size(places).alias("n_places"), F.sort_array(F.collect_set("reason")).alias("reasons")
    )


def sizes(text: Column, limit: int) -> dict[str, Column]:
    """Bytes, characters, use of a limit in percent and whether it warns (90 percent)."""
    n = F.octet_length(text)
    return {"n_bytes": n.cast("long"), "n_chars": F.length(text).cast("long"), "percent": F.bround(100.0 * n / limit, 3), "warns": n >= 0.9 * limit}


def conflicts(rows: DataFrame, keys: list[str]) -> Column:
    """Whether another row has the same keys."""
    return F.count("*").over(Window.partitionBy(*keys)) > 1


def latest_fields(rows: DataFrame, by: list[str], order: str, fields: list[str], lists: list[str]) -> DataFrame:
    """Partial updates folded: each field's last value that isn't null, all lists' entries in order."""
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    joined = [F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(x).alias("v")))), lambda e: e["v"])).alias(x) for x in lists]
    return rows.groupBy(*by).agg(*last, *joined)


def extractive_use(strings: DataFrame, by: list[str], value: str, source: str, least: int = 8, most_chars: int = 1000, most_strings: int = 200) -> DataFrame:
    """Characters of a record's strings that its source has verbatim, and whether that is too many."""
    copied = F.sum(F.when((F.length(value) >= least) & F.contains(F.col(source), F.col(value)), F.length(value)).otherwise(0))
    used = strings.groupBy(*by).agg(copied.alias("copied"), F.count("*").alias("n_strings"))
    return used.withColumn("risk", (F.col("copied") > most_chars) | (F.col("n_strings") > most_strings))


def enforce_limit(rows: DataFrame, most: int, what: str) -> DataFrame:
    """The rows, or an error if there are more than ``most``: limits fail, they never cut."""
    number = rows.agg(F.count("*")).scalar()
    too_many = F.raise_error(F.concat(number.cast("string"), F.lit(f" {what} exceed {most}"))).cast("boolean")
    return rows.where(F.when(number > most, too_many).otherwise(F.lit(True)))


def content_metrics(rows: DataFrame, by: list[str], text: str, distinct: str, long_text: int = 2000) -> DataFrame:
    """Texts by group: how many, their characters and lines, empty ones, distinct values of a column, the longest, and how many are long."""
    n = F.length(text)
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_docs"),
        F.sum(n).alias("n_chars"),
        F.sum(F.size(F.split(text, "\n"))).alias("n_lines"),
        F.count_if(F.length(F.trim(text)) == 0).alias("n_empty"),
        F.count_distinct(distinct).alias("n_sources"),
        F.max(n).cast("long").alias("longest"),
        F.count_if(n > long_text).alias("n_long"),
    )


def ledger_summary(rows: DataFrame, module: str, pending: Column, total: str = "all") -> DataFrame:
    """module, total, pending and generated of each module, and of all (one row named ``total``)."""
    counts = [F.count("*").alias("total"), F.count_if(pending).alias("pending"), F.count_if(~pending).alias("generated")]
    return rows.rollup(F.col(module).alias("module")).agg(*counts, F.grouping_id().alias("level")).select(F.when(F.col("level") == 1, total).otherwise(F.col("module")).alias("module"), "total", "pending", "generated")


def semantic_summary(rows: DataFrame, by: list[str], severity: Column, decision: Column, levels: list[str]) -> DataFrame:
    """Findings by severity, and ``blocking``: errors that weren't dismissed (one without a decision blocks)."""
    counts = [F.count_if(severity == x).alias(f"n_{x}") for x in levels]
    open_error = (severity == "error") & ~F.coalesce(decision == "dismissed", F.lit(False))
    return rows.groupBy(*by).agg(*counts, F.count_if(open_error).alias("blocking"))


def histogram(rows: DataFrame, *keys: str | Column, **conditions: Column) -> DataFrame:
    """How many rows each combination of keys has, and how many of them meet each condition."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in conditions.items()])


def structure_inventory(chapters: DataFrame, sections: DataFrame, chapter: str, of_chapter: str, by: list[str]) -> DataFrame:
    """Units by group: chapters and their sections; a chapter without any counts once."""
    counted = sections.groupBy(F.col(of_chapter).alias(chapter)).agg(F.count("*").alias("n_sections"))
    return chapters.join(counted, chapter, "left").groupBy(*by).agg(F.sum(1 + F.coalesce("n_sections", F.lit(0))).alias("units"))


def gap_counts(rows: DataFrame, gaps: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """How many rows have each gap; an unknown condition counts as none."""
    return rows.groupBy(*(by or [])).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in gaps.items()])


def content_groups(rows: DataFrame, keys: list[str], unit: str, prefix: str = "G-", size: int = 16) -> DataFrame:
    """Units grouped by several keys: the ordered list, its length, and an id made of it."""
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(unit)).alias("units"))
    joined = F.array_join(F.transform("units", lambda x: x.cast("string")), "\x00")
    return grouped.withColumn("group_id", F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(joined, 256), 1, size)))).withColumn("n", F.size("units").cast("long"))


def section_statistics(rows: DataFrame, by: list[str], distinct: dict[str, str], sums: dict[str, str], lattice: list[tuple[Column, str]], otherwise: str) -> DataFrame:
    """Sections' rows, distinct values and sums, and their state: the first of a lattice of aggregate conditions that holds."""
    state = None
    for condition, name in lattice:
        state = F.when(condition, name) if state is None else state.when(condition, name)
    counts = [F.count("*").alias("n"), *[F.count_distinct(c).alias(k) for k, c in distinct.items()], *[F.sum(c).alias(k) for k, c in sums.items()]]
    return rows.groupBy(*by).agg(*counts, state.otherwise(otherwise).alias("state"))


def glyph_signature(text: Column, share: float = 0.7, least: int = 20) -> Column:
    """Whether a text looks like one set glyph by glyph: enough tokens, most of them single characters."""
    tokens = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    single = F.size(F.filter(tokens, lambda x: F.length(x) == 1))
    return F.coalesce((F.size(tokens) >= least) & (single >= share * F.size(tokens)), F.lit(False))


def flags(rows: DataFrame, by: list[str], any_of: dict[str, Column] | None = None, all_of: dict[str, Column] | None = None) -> DataFrame:
    """By group whether any row, or every row, meets a condition; an unknown one isn't met."""
    known = lambda c: F.coalesce(c, F.lit(False))
    some = [F.bool_or(known(c)).alias(name) for name, c in (any_of or {}).items()]
    return rows.groupBy(*by).agg(*some, *[F.bool_and(known(c)).alias(name) for name, c in (all_of or {}).items()])


def session_summary(rows: DataFrame, session: str, answered: Column) -> DataFrame:
    """Items of each session, how many are answered, and the depth of its queue."""
    done = F.coalesce(answered, F.lit(False))
    return rows.groupBy(session).agg(F.count("*").alias("n"), F.count_if(done).alias("answered"), F.count_if(~done).alias("depth"))


def totals_match(whole: DataFrame, parts: DataFrame, key: str, part_key: str, stated: Column) -> DataFrame:
    """Keys of the whole with ``consistent``: the parts are as many as stated."""
    counted = parts.groupBy(F.col(part_key).alias(key)).agg(F.count("*").alias("n_parts"))
    return whole.join(counted, key, "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(0))).withColumn("consistent", stated == F.col("n_parts"))


def summary_faults(rows: DataFrame, by: list[str], stated: DataFrame, count: str = "stated") -> DataFrame:
    """Groups whose stated number of rows isn't what the rows give; groups that one side lacks count as 0."""
    derived = rows.groupBy(*by).agg(F.count("*").alias("n"))
    both = stated.select(*by, count).join(derived, by, "full").select(*by, F.coalesce(count, F.lit(0)).alias(count), F.coalesce("n", F.lit(0)).alias("n"))
    return both.where(F.col(count) != F.col("n"))


def rank_of(c: Column, ranks: list[object]) -> Column:
    """The place of a value in a list, the list's length for all others."""
    place = F.array_position(F.array(*[F.lit(x) for x in ranks]), c)
    return F.when(place > 0, place - 1).otherwise(len(ranks))


def placed(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """Rows with their place from 1 in each group's order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def next_pending(rows: DataFrame, pending: Column, order: list[str], most: int = 1) -> DataFrame:
    """The first pending rows of a queue, first in first out."""
    return rows.where(pending).orderBy(*order).limit(most)


def capped_places(rows: DataFrame, by: list[str], place: str, most: int = 200) -> DataFrame:
    """The first distinct places of each key in order, at most ``most``, and how many there are in all."""
    found = F.sort_array(F.collect_set(place))
    return rows.groupBy(*by).agg(F.slice(found, 1, most).alias("places"), F.size(found).cast("long").alias("n_places"))


def tail(rows: DataFrame, by: list[str], order: str, most: int = 1000) -> DataFrame:
    """The last rows of each history."""
    age = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))
    return rows.withColumn("age_in_history", age).where(F.col("age_in_history") <= most).drop("age_in_history")


def sorted_distinct(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The distinct values of each group in order."""
    return rows.groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("codes"))


def set_checks(part: DataFrame, whole: DataFrame) -> DataFrame:
    """One row: whether a set is part of another one (``is_subset``) and holds all of it (``is_covered``). Both have one column."""
    a, b = part.toDF("x").distinct(), whole.toDF("x").distinct()
    sides = a.withColumn("side", F.lit("part")).unionByName(b.withColumn("side", F.lit("whole"))).groupBy("x").agg(F.count_if(F.col("side") == "part").alias("a"), F.count_if(F.col("side") == "whole").alias("b"))
    return sides.agg((F.count_if(F.col("b") == 0) == 0).alias("is_subset"), (F.count_if(F.col("a") == 0) == 0).alias("is_covered"))


def snapshot_differences(before: DataFrame, after: DataFrame, path: str, digest: str) -> DataFrame:
    """Paths that two snapshots don't share byte by byte: "missing" afterwards, "unexpected" or "different"."""
    a, b = before.select(path, F.col(digest).alias("was"), F.lit(1).alias("a")), after.select(path, F.col(digest).alias("is"), F.lit(1).alias("b"))
    state = F.when(F.col("a").isNull(), "unexpected").when(F.col("b").isNull(), "missing").when(~F.col("was").eqNullSafe(F.col("is")), "different")
    return a.join(b, path, "full").select(path, state.alias("state")).where("state IS NOT NULL")


def shared_ids(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Ids that two runs share, which should be none."""
    return first.select(key).intersect(second.select(key))


def trailer_counts(pack: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """How many records a pack has of each collection, a column each, and in all."""
    rows = None
    for name, records in pack.items():
        part = records.select(*by, F.lit(name).alias("collection"))
        rows = part if rows is None else rows.unionByName(part)
    counts = [F.count_if(F.col("collection") == name).alias(f"n_{name}") for name in pack]
    return rows.groupBy(*by).agg(*counts, F.count("*").alias("n_records"))
