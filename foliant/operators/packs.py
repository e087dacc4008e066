"""Checks and measures of whole language packs: what ``sources.readers.packs`` reads, for any number of projects.

``held`` maps a collection to its records with path (the pack's file), language,
pos and the collection's fields. All checks give findings: severity, code, path, message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.hashing import semantic_hash
from foliant.functions.text import unsafe
from foliant.operators.references import findings, missing, missing_in_list, union

# The texts of each collection that are shown, and the lists of lines.
SHOWN = {
    "chapters": ("title", "pages", "summary"),
    "certainty": ("label", "definition"),
    "claims": ("kind", "statement", "falsifiability", "revision_conditions", "reader_note"),
    "misreadings": ("issue", "misreading", "response", "impact", "remaining_uncertainty", "anchor"),
    "policies": ("kind", "statement"),
    "names": ("name", "book_context"),
    "glossary": ("term", "book_meaning"),
    "references": ("label", "url"),
}
LISTS = {"chapters": ("sections", "terms", "contributors", "aliases", "learning_objectives", "prerequisites"), "names": ("aliases",), "glossary": ("aliases",)}
# Accounts of names and terms, their most and least characters, and a formula that says nothing.
ACCOUNTS = {"names": "book_context", "glossary": "book_meaning"}
MOST_ACCOUNT, LEAST_ACCOUNT = 500, 16
FORMULA = r"同章の(?:[^。]{0,40}参照人物|議論を組み立てる概念・枠組み)"
# What a release needs of each gate of the workflow.
GATES = {"design_constraints": "approved", "rights_review": "approved", "author_review": "approved", "publisher_review": "approved not_required", "reconstruction_review": "approved", "publication_decision": "approved"}
_SHA, _SOURCE = r"^[0-9a-f]{64}$", r"^SRC-[A-Z0-9][A-Z0-9.-]{0,99}$"


def _at(collection: str, field: str = "") -> Column:
    """The place of a record: file, collection, number and field."""
    return F.concat(F.element_at(F.split("path", "/"), -1), F.format_string(f".{collection}[%d]", F.col("pos")), F.lit(f".{field}" if field else ""))


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def record_findings(held: dict[str, DataFrame], most_summary: int = 500) -> DataFrame:
    """Records by themselves: RP107, RP108 fields that a claim's layer excludes, RP109 addresses, RP117 long summaries, RP123 texts that can't be shown, RP127 provenance by halves."""
    parts = []
    for name, rows in held.items():
        for field in SHOWN[name]:
            parts.append(findings(rows.where(unsafe(F.col(field))), "error", "RP123", _at(name, field), "must be one safe line"))
        for field in (*LISTS.get(name, ()), "source_locations"):
            wrong = F.coalesce(F.exists(field, lambda x: x.isNull() | (x == "") | unsafe(x)), F.lit(False))
            parts.append(findings(rows.where(wrong), "error", "RP123", _at(name, field), "must contain safe lines"))
        if name in ACCOUNTS:
            parts.append(findings(rows.where(F.length(ACCOUNTS[name]) > MOST_ACCOUNT), "error", "RP123", _at(name, ACCOUNTS[name]), f"must not exceed {MOST_ACCOUNT} characters"))
        source, digest = F.col("provenance_source_id"), F.col("provenance_source_hash")
        halves = source.isNull() != digest.isNull()
        parts.append(findings(rows.where(halves | ~source.rlike(_SOURCE) | ~digest.rlike(_SHA)), "error", "RP127", _at(name), "provenance needs a source and its hash"))
    claims = held["claims"]
    parts.append(findings(claims.where((F.col("layer") == "descriptive") & _filled(F.col("revision_conditions"))), "error", "RP107", _at("claims"), "descriptive claims have no revision conditions"))
    parts.append(findings(claims.where((F.col("layer") == "normative") & _filled(F.col("falsifiability"))), "error", "RP108", _at("claims"), "normative claims have no falsifiability"))
    parts.append(findings(held["references"].where(~F.coalesce(F.col("url").rlike(r"(?i)^https?://[^\s/?#]"), F.lit(False))), "error", "RP109", _at("references", "url"), "must be an absolute address"))
    parts.append(findings(held["chapters"].where(F.length("summary") > most_summary), "error", "RP117", _at("chapters", "summary"), f"exceeds {most_summary} characters"))
    return union(*parts)


def reference_findings(held: dict[str, DataFrame]) -> DataFrame:
    """Keys between a pack's records: RP115 ids used twice, RP118 to RP121 chapters, certainty and claims that aren't there."""
    scoped = lambda rows, key: rows.withColumn("key", F.concat_ws("\x00", "path", key))
    parents = {name: scoped(held[name], "id").select(F.col("key").alias("known")) for name in ("chapters", "certainty", "claims")}
    parts = []
    for name, field, parent, code in (("claims", "chapter_ids", "chapters", "RP118"), ("misreadings", "chapter_ids", "chapters", "RP118"), ("misreadings", "claim_ids", "claims", "RP121")):
        rows = held[name].withColumn("keys", F.transform(field, lambda x: F.concat_ws("\x00", "path", x)))
        broken = missing_in_list(rows, "keys", parents[parent], "known")
        parts.append(findings(broken, "error", code, _at(name, field), F.concat(F.lit("broken reference: "), F.element_at(F.split("missing", "\x00"), -1))))
    for name in ("names", "glossary"):
        parts.append(findings(missing(scoped(held[name], F.coalesce("chapter_id", F.lit(""))), "key", parents["chapters"], "known"), "error", "RP119", _at(name), F.concat(F.lit("broken chapter reference: "), F.coalesce("chapter_id", F.lit("none")))))
    certain = scoped(held["claims"].where(_filled(F.col("certainty_id"))), "certainty_id")
    parts.append(findings(missing(certain, "key", parents["certainty"], "known"), "error", "RP120", _at("claims", "certainty_id"), F.concat(F.lit("broken certainty reference: "), "certainty_id")))
    every = union(*[rows.where(_filled(F.col("id"))).select("path", "pos", "id", F.lit(k).alias("rank"), F.lit(name).alias("collection")) for k, (name, rows) in enumerate(held.items())])
    again = every.withColumn("use", F.row_number().over(Window.partitionBy("path", "id").orderBy("rank", "pos"))).where("use > 1")
    place = F.concat(F.element_at(F.split("path", "/"), -1), F.format_string(".%s[%d].id", F.col("collection"), F.col("pos")))
    parts.append(findings(again, "error", "RP115", place, F.concat(F.lit("duplicates the ID "), "id")))
    return union(*parts)


def bilingual_findings(held: dict[str, DataFrame], primary: str, project: Column) -> DataFrame:
    """Translations beside the primary language: RP200 other ids or another order, RP201 a source that isn't its own, RP202 a stale link, RP203 no status of translation."""
    parts = []
    packs = union(*[rows.select("path", "language", project.alias("project")) for rows in held.values()]).where(F.col("language") != primary).distinct()
    none = F.array().cast("array<string>")
    for name, rows in held.items():
        rows = rows.withColumn("project", project)
        # Review and link keys, the file and the place aren't part of what is translated.
        digest = semantic_hash(rows, [c for c in rows.columns if c not in ("path", "language", "pos", "project")])
        first = rows.where(F.col("language") == primary).select("project", F.col("id").alias("first_id"), F.col("pos").alias("first_pos"), digest.alias("now"))
        others = rows.where(F.col("language") != primary)
        paired = others.join(first, (others["project"] == first["project"]) & (F.col("id") == F.col("first_id"))).drop(first["project"])
        listed = lambda x, k, p: F.transform(F.sort_array(F.collect_list(F.struct(p, k))), lambda e: e[k])  # noqa: B023, E731
        theirs = others.groupBy("project", "language", "path").agg(listed(others, "id", "pos").alias("ids"))
        ours = first.groupBy("project").agg(listed(first, "first_id", "first_pos").alias("first_ids"))
        both = packs.join(theirs, ["project", "language", "path"], "left").join(ours, "project", "left")
        uneven = both.where(F.coalesce("ids", none) != F.coalesce("first_ids", none))
        parts.append(findings(uneven, "error", "RP200", F.concat(F.element_at(F.split("path", "/"), -1), F.lit(f".{name}")), "ids or their order differ from the primary language"))
        parts.append(findings(paired.where(~F.col("source_id").eqNullSafe(F.col("id"))), "error", "RP201", _at(name, "source_id"), F.concat(F.lit("must equal "), "id")))
        parts.append(findings(paired.where(~F.col("source_hash").eqNullSafe(F.col("now"))), "error", "RP202", _at(name, "source_hash"), "stale translation"))
        parts.append(findings(paired.where(~F.coalesce(F.col("translation_status").isin("draft", "reviewed", "approved"), F.lit(False))), "error", "RP203", _at(name, "translation_status"), "must be draft, reviewed, or approved"))
    return union(*parts)


def release_findings(held: dict[str, DataFrame], workflow: DataFrame) -> DataFrame:
    """What keeps a pack from release: RP300 gates, RP301 records that aren't approved, RP303 and RP304 names and terms without a real account, RP302 no licence chosen.

    ``workflow`` has project, license and a column for each gate.
    """
    parts = [findings(workflow.where(~F.coalesce(F.col(gate).isin(*accepted.split()), F.lit(False))), "error", "RP300", F.concat(F.col("project").cast("string"), F.lit(f".workflow.{gate}")), f"release requires {accepted.replace(' ', ' or ')}") for gate, accepted in GATES.items()]
    parts.append(findings(workflow.where(F.col("license") == "rights-holder decision pending"), "error", "RP302", F.concat(F.col("project").cast("string"), F.lit(".book.pack_license")), "release requires explicit terms"))
    for name, rows in held.items():
        parts.append(findings(rows.where(~F.col("status").eqNullSafe(F.lit("approved"))), "error", "RP301", _at(name, "status"), "release requires approved"))
    for name, field in ACCOUNTS.items():
        said = F.trim(field)
        parts.append(findings(held[name].where(~_filled(F.col(field))), "error", "RP303", _at(name, field), "release requires an account of this entry"))
        parts.append(findings(held[name].where(_filled(F.col(field)) & ((F.length(said) < LEAST_ACCOUNT) | F.col(field).rlike(FORMULA))), "error", "RP304", _at(name, field), "release rejects placeholders"))
    return union(*parts)


def content_metrics(held: dict[str, DataFrame]) -> DataFrame:
    """path, language and the fifteen counts of what a pack says: records, those with their account, and characters."""
    filled = lambda c: _filled(F.col(c))
    size = lambda c: F.when(_filled(F.col(c)), F.length(c)).otherwise(0)
    terms = F.filter("terms", lambda x: F.length(F.trim(x)) > 0)
    each = {
        "chapters": {"chapter_summaries": filled("summary"), "summary_characters": size("summary"), "chapter_terms": F.greatest(F.size(terms), F.lit(0)), "content_characters": size("summary") + F.coalesce(F.aggregate(terms, F.lit(0), lambda a, x: a + F.length(x)), F.lit(0))},
        "certainty": {"certainty_levels": F.lit(1), "content_characters": size("definition")},
        "claims": {"claims": F.lit(1), "claims_with_certainty": filled("certainty_id"), "claims_with_falsifiability": filled("falsifiability"), "claims_with_revision_conditions": filled("revision_conditions"), "content_characters": size("statement") + size("falsifiability") + size("revision_conditions") + size("reader_note")},
        "misreadings": {"misreadings": F.lit(1), "content_characters": size("issue") + size("misreading") + size("response") + size("impact") + size("remaining_uncertainty")},
        "policies": {"content_characters": size("statement")},
        "names": {"names": F.lit(1), "names_with_context": filled("book_context"), "content_characters": size("name") + size("book_context")},
        "glossary": {"glossary_terms": F.lit(1), "glossary_terms_with_meaning": filled("book_meaning"), "content_characters": size("term") + size("book_meaning")},
        "references": {"references": F.lit(1), "content_characters": size("label")},
    }
    rows = union(*[held[name].select("path", "language", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), c.cast("long").alias("value")) for k, c in counts.items()]))) for name, counts in each.items() if name in held])
    names = sorted({k for counts in each.values() for k in counts})
    return rows.groupBy("path", "language").agg(*[F.coalesce(F.sum(F.when(F.col("metric") == k, F.col("value"))), F.lit(0)).alias(k) for k in names])
