"""Keys between records: references, pairs, duplicates, intervals, chains and trees.

Every check returns rows of its own or ``findings`` (severity, code, path,
message), which union into one relation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.lineage import checkpointed


def findings(rows: DataFrame, severity: str | Column, code: str, path: Column, message: str | Column) -> DataFrame:
    """Rows as findings."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(lit(severity).alias("severity"), F.lit(code).alias("code"), path.cast("string").alias("path"), lit(message).alias("message"))


def union(*parts: DataFrame) -> DataFrame:
    """Findings of several checks in one relation."""
    return reduce(DataFrame.unionByName, parts)


def missing(child: DataFrame, key: str, parent: DataFrame, parent_key: str, optional: bool = False) -> DataFrame:
    """Rows whose key no parent has; an empty key is fine if it's optional, else missing too."""
    rows = child.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")) if optional else child
    keys = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return rows.join(keys, rows[key] == F.col("_parent"), "left_anti")


def missing_in_list(child: DataFrame, keys: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows and the entries of their key lists (as ``missing``) that no parent has."""
    return missing(child.withColumn("missing", F.explode(keys)), "missing", parent, parent_key)


def duplicates(rows: DataFrame, *keys: str, distinct: str | None = None) -> DataFrame:
    """Keys that more than one row (or more than one value of ``distinct``) has."""
    n = F.count_distinct(distinct) if distinct else F.count("*")
    return rows.groupBy(*keys).agg(n.alias("n")).where("n > 1")


def pair(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Records of two languages by key: state is "paired", "stale", "missing" or "extra"."""
    a = first.select(*keys, F.col(value).alias("here"), F.lit(True).alias("_a"))
    b = second.select(*keys, F.col(value).alias("there"), F.lit(True).alias("_b"))
    state = F.when(F.col("_a").isNull(), "extra").when(F.col("_b").isNull(), "missing").when(F.col("here").eqNullSafe(F.col("there")), "paired").otherwise("stale")
    return a.join(b, keys, "full").select(*keys, state.alias("state"))


def in_order(first: DataFrame, second: DataFrame, key: str, position: str) -> DataFrame:
    """Keys whose places differ between two orders, both counted over the keys that both have."""
    def placed(rows: DataFrame, other: DataFrame, name: str) -> DataFrame:
        both = rows.join(other.select(key), key, "left_semi").select(key, position)
        # A global order by range partitions: counts before a partition plus the place within it.
        return numbered(both, [position, key], name).select(key, name)

    return placed(first, second, "here").join(placed(second, first, "there"), key).where("here <> there")


def numbered(rows: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Consecutive numbers from 1 in a total order, without one task that sorts everything."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written once: bounds that are sampled anew for each use could number rows twice.
    ranged = checkpointed(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    inner = Window.partitionBy("_part").orderBy(*order)
    counted = ranged.withColumn("_place", F.row_number().over(inner))
    sums = counted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    return counted.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def containing(points: DataFrame, spans: DataFrame, by: list[str], start: str, end: str, first: str, last: str, span_id: str, width: int = 4096) -> DataFrame:
    """Each point [start, end) with the one span [first, last] of its group that holds it, else null.

    Spans are cut into cells of ``width``, so that the join is on equal cells
    and not on every pair of a group; a point within several spans stays unresolved.
    """
    cells = spans.select(*by, F.col(first).alias("_f"), F.col(last).alias("_l"), F.col(span_id).alias("_id"), F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width))).alias("_cell"))
    keyed = points.withColumn("_cell", F.floor(F.col(start) / width))
    hit = (F.col("_f") <= F.col(start)) & (F.col(end) <= F.col("_l"))
    found = keyed.join(cells, [*by, "_cell"], "left").groupBy(*points.columns).agg(F.count(F.when(hit, 1)).alias("_n"), F.max(F.when(hit, F.col("_id"))).alias("_id"))
    return found.withColumn(span_id, F.when(F.col("_n") == 1, F.col("_id"))).drop("_n", "_id")


def next_at_or_after(wanted: DataFrame, events: DataFrame, by: list[str], start: str, position: str) -> DataFrame:
    """For each wanted start the first event's position at or after it in the group.

    One sort by group instead of a join of ranges: the nearest event behind in
    the union of both.
    """
    a = wanted.select(*by, F.col(start).alias("_at"), F.lit(None).cast("long").alias("_event"), F.lit(1).alias("_kind"))
    b = events.select(*by, F.col(position).alias("_at"), F.col(position).cast("long").alias("_event"), F.lit(0).alias("_kind"))
    later = Window.partitionBy(*by).orderBy(F.col("_at").desc(), F.col("_kind"))
    both = a.unionByName(b).withColumn(position, F.last("_event", ignorenulls=True).over(later.rowsBetween(Window.unboundedPreceding, 0)))
    return both.where("_kind = 1").select(*by, F.col("_at").alias(start), position)


def continuity(runs: DataFrame, by: list[str], order: str, before: str, after: str, current: Column) -> DataFrame:
    """Runs whose outcome isn't what the next one starts from (the last: not the current state)."""
    following = F.lead(before).over(Window.partitionBy(*by).orderBy(order))
    last = F.lead(F.lit(1)).over(Window.partitionBy(*by).orderBy(order)).isNull()
    return runs.withColumn("_next", F.when(last, current).otherwise(following)).where(~F.col("_next").eqNullSafe(F.col(after))).drop("_next")


def follow_chain(edits: DataFrame, by: list[str], order: str, before: str, after: str, start: Column) -> DataFrame:
    """Per key the state after all edits whose before-state is the state then, and how many applied.

    An ordered fold over a key's edits (bounded by the retention of a record's history).
    """
    steps = edits.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(before).alias("b"), F.col(after).alias("a")))).alias("_s"), F.first(start).alias("_start"))
    folded = F.aggregate("_s", F.struct(F.col("_start").alias("head"), F.lit(0).alias("n")), lambda acc, e: F.when(acc["head"].eqNullSafe(e["b"]), F.struct(e["a"].alias("head"), (acc["n"] + 1).alias("n"))).otherwise(acc))
    return steps.select(*by, folded.alias("f")).select(*by, F.col("f.head").alias("head"), F.col("f.n").alias("applied"))


def two_levels(units: DataFrame, unit: str, parent: str, order: str, title: str) -> DataFrame:
    """Top units with the titles of their children in order; ``deeper`` counts grandchildren, which are errors."""
    top = units.where(F.col(parent).isNull())
    child = units.where(F.col(parent).isNotNull()).select(F.col(parent).alias("_up"), F.col(unit).alias("_child"), F.col(order).alias("_order"), F.col(title).alias("_title"))
    grand = child.join(child.select(F.col("_up").alias("_child")), "_child").groupBy(F.col("_up").alias("_g")).agg(F.count("*").alias("deeper"))
    lists = child.groupBy("_up").agg(F.transform(F.sort_array(F.collect_list(F.struct("_order", "_title"))), lambda x: x["_title"]).alias("sections"))
    return top.join(lists, top[unit] == lists["_up"], "left").join(grand, top[unit] == grand["_g"], "left").select(unit, title, F.coalesce("sections", F.array().cast("array<string>")).alias("sections"), F.coalesce("deeper", F.lit(0)).alias("deeper"))


def cyclic(units: DataFrame, unit: str, parent: str) -> DataFrame:
    """Units that don't reach a root (or a parent that isn't there), however deep the tree.

    Ancestors are followed in doubling steps among the units that haven't got
    there yet. While any of them still can, some do in every round, so those left
    when a round changes nothing are on or below a cycle.
    """
    ancestors = units.where(F.col(parent).isNotNull()).select(F.col(unit).alias("u"), F.col(parent).alias("up")).distinct()
    reach = checkpointed(ancestors)
    left = reach.count()
    while left:
        above = reach.select(F.col("u").alias("up"), F.col("up").alias("top"))
        reach = checkpointed(reach.join(above, "up").select("u", F.col("top").alias("up")))
        before, left = left, reach.count()
        if left == before:
            break
    return reach.select(F.col("u").alias(unit))


def coverage_faults(targets: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Targets not answered exactly once, and answers without target: key, n_targets, n_answers."""
    a = targets.groupBy(key).agg(F.count("*").alias("n_targets"))
    b = answers.groupBy(key).agg(F.count("*").alias("n_answers"))
    both = a.join(b, key, "full").select(key, F.coalesce("n_targets", F.lit(0)).alias("n_targets"), F.coalesce("n_answers", F.lit(0)).alias("n_answers"))
    return both.where("n_targets <> 1 OR n_answers <> 1")


def grid(items: DataFrame, labels: list[str], name: str) -> DataFrame:
    """Every item with every one of a few labels (a list, so no join)."""
    return items.withColumn(name, F.explode(F.array(*[F.lit(x) for x in labels])))


def provenance_faults(records: DataFrame, registry: DataFrame, source_id: str, source_hash: str, registry_id: str, registry_hash: str, exempt: Column | None = None) -> DataFrame:
    """Records whose source isn't registered or has another hash there, with ``state`` "unregistered" or "stale"; exempt ones (the primary book's) aren't asked."""
    asked = records if exempt is None else records.where(~F.coalesce(exempt, F.lit(False)))
    known = registry.select(F.col(registry_id).alias("known_id"), F.col(registry_hash).alias("known_hash"))
    joined = asked.join(known, asked[source_id] == F.col("known_id"), "left")
    state = F.when(F.col("known_id").isNull(), "unregistered").when(~F.col("known_hash").eqNullSafe(F.col(source_hash)), "stale")
    return joined.withColumn("state", state).where("state IS NOT NULL").drop("known_id", "known_hash")


def base_states(candidates: DataFrame, base: DataFrame, keys: list[str], structure: list[str]) -> DataFrame:
    """Candidates beside their base record: ``state`` is "unmatched", "changed" (some structural field differs) or "same"."""
    held = base.select(*keys, *[F.col(c).alias(f"base_{c}") for c in structure], F.lit(True).alias("has_base"))
    equal = F.lit(True)
    for c in structure:
        equal = equal & F.col(c).eqNullSafe(F.col(f"base_{c}"))
    state = F.when(F.col("has_base").isNull(), "unmatched").when(equal, "same").otherwise("changed")
    return candidates.join(held, keys, "left").withColumn("state", state).drop("has_base", *[f"base_{c}" for c in structure])


def work_matches(candidates: DataFrame, work: DataFrame, collection: str, chapters: str, module: str, scope: str, book: object) -> DataFrame:
    """Candidates with the work items of their collection's module: those of their chapters, or of the whole book where they name none."""
    scopes = F.when(F.size(chapters) > 0, F.array_distinct(chapters)).otherwise(F.array(F.lit(book)))
    each = candidates.withColumn("work_scope", F.explode(scopes))
    return each.join(work, (F.col(collection) == work[module]) & (F.col("work_scope") == work[scope])).drop("work_scope")


def contained(rows: DataFrame, *parents: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows all of whose keys are known: each of ``parents`` is a table, its key, and the rows' column for it."""
    for table, parent_key, key in parents:
        rows = rows.join(table.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")
    return rows


def merge_match(units: DataFrame, existing: DataFrame, unit: str, kind: str, title: str, by_id: bool = False) -> DataFrame:
    """unit, matched (the existing unit or null) and state: "matched", "ambiguous", "reused" or "unmatched".

    A manual outline matches by id, an import by kind and normalised title. A
    title that several existing units have is ambiguous; an existing unit that
    several units match is reused. Both are errors, and so is what isn't matched.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    keys = (lambda rows: [F.col(unit).cast("string").alias("k")]) if by_id else (lambda rows: [F.concat_ws("\x00", F.col(kind), norm(F.col(title))).alias("k")])
    theirs = existing.select(F.col(unit).alias("matched"), *keys(existing)).groupBy("k").agg(F.count("*").alias("n"), F.min("matched").alias("matched"))
    found = units.select(unit, *keys(units)).join(theirs, "k", "left")
    # Units without a match each count for themselves, so that they don't meet in one task.
    times = F.count("*").over(Window.partitionBy(F.coalesce(F.col("matched").cast("string"), F.concat(F.lit("\x00"), F.col(unit).cast("string")))))
    state = F.when(F.col("n").isNull(), "unmatched").when(F.col("n") > 1, "ambiguous").when(times > 1, "reused").otherwise("matched")
    return found.withColumn("state", state).select(unit, F.when(F.col("state") == "matched", F.col("matched")).alias("matched"), "state")


def existence_flags(rows: DataFrame, others: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows with a flag a collection: whether it mentions their key. A collection is its table, its column (a value or a list) and the rows' key."""
    for name, (table, column, key) in others.items():
        listed = F.explode(column) if table.schema[column].dataType.typeName() == "array" else F.col(column)
        there = table.select(listed.alias(key)).distinct().withColumn(name, F.lit(True))
        rows = rows.join(there, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows


def seed_or_recall(candidates: DataFrame, inventory: DataFrame, value: str, chapter: str | None = None) -> DataFrame:
    """Candidates with ``origin``: "seed" where the inventory has their normalised value (in their chapter), else "recall"."""
    norm = F.trim(F.regexp_replace(F.lower(value), r"\s+", " ")).alias("norm_value")
    keys = ["norm_value", *([chapter] if chapter else [])]
    known = inventory.select(norm, *([chapter] if chapter else [])).distinct().withColumn("is_seed", F.lit(True))
    joined = candidates.withColumn("norm_value", norm).join(known, keys, "left")
    return joined.withColumn("origin", F.when(F.col("is_seed"), "seed").otherwise("recall")).drop("norm_value", "is_seed")


def relinked(secondary: DataFrame, primary: DataFrame, keys: list[str], linked: str, current: str, status: str, draft: str = "draft") -> DataFrame:
    """Translations linked to the primary's current hash; those whose link moved are drafts again, those without a primary are left as they are."""
    now = primary.select(*keys, F.col(current).alias("current_hash"))
    joined = secondary.join(now, keys, "left")
    moved = F.col("current_hash").isNotNull() & ~F.col(linked).eqNullSafe(F.col("current_hash"))
    return joined.withColumn(status, F.when(moved, draft).otherwise(F.col(status))).withColumn(linked, F.coalesce("current_hash", linked)).drop("current_hash")


def facet_states(plan: DataFrame, source: DataFrame, keys: list[str], facets: list[str]) -> DataFrame:
    """Planned items with the facets of the source read again: ``state`` is "missing", "stale" (some facet differs) or "current", ``stale`` names those."""
    again = source.select(*keys, *[F.col(c).alias(f"again_{c}") for c in facets], F.lit(True).alias("is_there"))
    names = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"again_{c}")), c) for c in facets]))
    joined = plan.join(again, keys, "left").withColumn("stale", names)
    state = F.when(F.col("is_there").isNull(), "missing").when(F.size("stale") > 0, "stale").otherwise("current")
    return joined.withColumn("state", state).drop("is_there", *[f"again_{c}" for c in facets])


def decided(units: DataFrame, groups: DataFrame, by: list[str], own: str, group: str, otherwise: str = "pending") -> DataFrame:
    """Units with ``decision``: their own, else their group's, else pending."""
    return units.join(groups.select(*by, F.col(group).alias("group_decision")), by, "left").withColumn("decision", F.coalesce(own, "group_decision", F.lit(otherwise))).drop("group_decision")


def bulk_eligible(units: DataFrame, states: DataFrame, provided: DataFrame, key: str, unit_hash: str, state_hash: str, provided_hash: str) -> DataFrame:
    """Units with ``bulk``: their module's state and what the authority provided both have the unit's hash."""
    held = states.select(key, F.col(state_hash).alias("held_hash")).distinct()
    given = provided.select(key, F.col(provided_hash).alias("given_hash")).distinct()
    same = units.select(key, F.col(unit_hash).alias("own_hash")).distinct()
    bound = same.join(held, (same[key] == held[key]) & (F.col("own_hash") == F.col("held_hash")), "left_semi").join(given, (same[key] == given[key]) & (F.col("own_hash") == F.col("given_hash")), "left_semi")
    known = bound.select(key, F.col("own_hash").alias(unit_hash)).withColumn("bulk", F.lit(True))
    return units.join(known, [key, unit_hash], "left").withColumn("bulk", F.coalesce("bulk", F.lit(False)))


def within_span(evidence: DataFrame, spans: DataFrame, keys: list[str], start: str, end: str, first: str, last: str) -> DataFrame:
    """Evidence with ``inside``: its chapter's span holds it wholly; false where the chapter has no span."""
    held = spans.select(*keys, F.col(first).alias("span_first"), F.col(last).alias("span_last"))
    fits = (F.col(start) >= F.col("span_first")) & (F.col(end) <= F.col("span_last"))
    return evidence.join(held, keys, "left").withColumn("inside", F.coalesce(fits, F.lit(False))).drop("span_first", "span_last")


def looked_up(rows: DataFrame, contracts: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Rows with a contract's columns by key; a key that has none gets the defaults. A contract table is a few rows."""
    joined = rows.join(F.broadcast(contracts), key, "left")
    for column, value in defaults.items():
        joined = joined.withColumn(column, F.coalesce(column, F.lit(value)))
    return joined


def current_bindings(snapshot: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """A snapshot's keys with ``current``: the hash is still the same; false where the key is gone."""
    now = current.select(key, F.col(digest).alias("digest_now"))
    return snapshot.join(now, key, "left").withColumn("current", F.coalesce(F.col(digest) == F.col("digest_now"), F.lit(False))).drop("digest_now")


def binding(runs: DataFrame, inventories: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Runs with ``bound``: their inventory names the same value in every field, none of them unknown."""
    held = inventories.select(key, *[F.col(c).alias(f"held_{c}") for c in fields])
    equal = F.lit(True)
    for c in fields:
        equal = equal & (F.col(c) == F.col(f"held_{c}"))
    return runs.join(held, key, "left").withColumn("bound", F.coalesce(equal, F.lit(False))).drop(*[f"held_{c}" for c in fields])


def state_faults(states: DataFrame, data: DataFrame, keys: list[str], digest: str, status: str | None = None) -> DataFrame:
    """keys and code of records whose state doesn't fit the data: RP500 gone, RP501 without state, RP502 changed since."""
    now = data.select(*keys, F.col(digest).alias("digest_now"), F.lit(True).alias("is_there"))
    then = states.select(*keys, F.col(digest).alias("digest_then"), F.lit(True).alias("has_state"))
    code = F.when(F.col("is_there").isNull(), "RP500").when(F.col("has_state").isNull(), "RP501").when(~F.col("digest_then").eqNullSafe(F.col("digest_now")), "RP502")
    return then.join(now, keys, "full").select(*keys, code.alias("code")).where("code IS NOT NULL")


def addition_faults(additions: DataFrame, spans: DataFrame, texts: DataFrame, doc: str, text: str, value: str) -> DataFrame:
    """Generated additions with what is wrong: evidence outside its chapter, or that doesn't hold the value.

    ``additions`` has doc, chapter_id, char_start, char_end and the value;
    ``spans`` has doc, chapter_id, char_first, char_last. Values are compared normalised.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    placed = within_span(additions, spans, [doc, "chapter_id"], "char_start", "char_end", "char_first", "char_last")
    joined = placed.join(texts.select(doc, F.col(text).alias("whole_text")), doc, "left")
    said = F.substring("whole_text", F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    reason = F.when(F.col("whole_text").isNull(), "missing_source").when(~F.col("inside"), "outside_chapter").when(~F.contains(norm(said), norm(F.col(value))), "value_not_held")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").drop("whole_text", "inside")
