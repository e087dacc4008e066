"""Checks of what work leaves behind: runs, ledgers, inventories, packages, reviews and question plans.

Each function takes flat tables and gives findings: severity, code, path, message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.records import is_iso_datetime
from foliant.functions.text import safe_line
from foliant.operators.plans import MODES
from foliant.operators.references import duplicates, union
from foliant.operators.references import findings as as_findings
from foliant.operators.rules import Rule, findings
from foliant.operators.windows import overlaps

_SHA = r"^[0-9a-f]{64}$"
#: States of candidates, of work items, kinds of questions and their facets (fixed values).
CANDIDATE_STATES = ("proposed", "quarantined", "ready", "accepted", "applying", "applied", "rejected")
WORK_STATES = ("pending", "generated", "not_applicable", "failed")
QUESTION_KINDS = ("misreading", "clarification", "limitation", "unclassified")
FACETS = ("criticism", "impact", "response", "remaining_uncertainty")


def _empty(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def _filled(c: Column) -> Column:
    return ~_empty(c)


def _sha(field: str, code: str) -> Rule:
    return Rule(code, field, ~F.coalesce(F.col(field).rlike(_SHA), F.lit(False)), f"{field} isn't a SHA-256 hash")


def _repeated(rows: DataFrame, key: str, code: str) -> DataFrame:
    return as_findings(duplicates(rows, key), "error", code, F.col(key), f"{key} is used more than once")


def run_findings(candidates: DataFrame) -> DataFrame:
    """Candidates of a run: candidate_id, state, qa_passed, reasons (list), n_evidence, reviewer, reviewed_at, record_sha256, stated_sha256.

    CR01 unknown state, CR02 ready without QA or with reasons, CR03 quarantined without a reason,
    CR04 decided without reviewer and time, CR05 no evidence, CR06 the record's hash isn't the one stated, CR07 ids used twice.
    """
    state = F.col("state")
    decided = state.isin("accepted", "applying", "applied", "rejected")
    reviewed = _filled(F.col("reviewer")) & safe_line(F.col("reviewer"), 200) & is_iso_datetime(F.col("reviewed_at"))
    rules = [
        Rule("CR01", "state", ~F.coalesce(state.isin(*CANDIDATE_STATES), F.lit(False)), "unknown state"),
        Rule("CR02", "qa", state.isin("ready", "accepted", "applying", "applied") & (~F.coalesce("qa_passed", F.lit(False)) | (F.size("reasons") > 0)), "a candidate that is ready has passed QA without reasons"),
        Rule("CR03", "reasons", (state == "quarantined") & (F.size("reasons") <= 0), "a quarantined candidate has a reason"),
        Rule("CR04", "review", decided & ~F.coalesce(reviewed, F.lit(False)), "a decision has a reviewer and a time"),
        Rule("CR04", "review", ~decided & _filled(F.col("reviewer")), "an open candidate has no reviewer"),
        Rule("CR05", "evidence", F.coalesce("n_evidence", F.lit(0)) < 1, "no evidence"),
        Rule("CR06", "record_sha256", ~F.col("record_sha256").eqNullSafe(F.col("stated_sha256")), "the record isn't the one stated"),
    ]
    return union(findings(candidates, "candidate_id", rules), _repeated(candidates, "candidate_id", "CR07"))


def ledger_findings(work: DataFrame, candidates: DataFrame) -> DataFrame:
    """Work items (work_id, status, reason_code, candidate_ids) and the candidates there are (candidate_id).

    WL01 unknown status, WL02 generated without candidates, WL03 another end with candidates or without a
    reason, WL04 pending with either, WL05 candidates that aren't there, WL06 candidates of two items, WL07 ids used twice.
    """
    status, n = F.col("status"), F.size("candidate_ids")
    rules = [
        Rule("WL01", "status", ~F.coalesce(status.isin(*WORK_STATES), F.lit(False)), "unknown status"),
        Rule("WL02", "candidate_ids", (status == "generated") & (n < 1), "generated without candidates"),
        Rule("WL03", "reason_code", status.isin("not_applicable", "failed") & ((n > 0) | _empty(F.col("reason_code"))), "needs a reason and has no candidates"),
        Rule("WL04", "status", (status == "pending") & ((n > 0) | _filled(F.col("reason_code"))), "pending work has neither candidates nor a reason"),
    ]
    each = work.select("work_id", F.explode("candidate_ids").alias("candidate_id"))
    lost = each.join(candidates.select("candidate_id").distinct(), "candidate_id", "left_anti")
    return union(
        findings(work, "work_id", rules),
        as_findings(lost, "error", "WL05", F.col("work_id"), F.concat(F.lit("no candidate "), "candidate_id")),
        as_findings(duplicates(each, "candidate_id", distinct="work_id"), "error", "WL06", F.col("candidate_id"), "belongs to several work items"),
        _repeated(work, "work_id", "WL07"),
    )


def inventory_findings(items: DataFrame, spans: DataFrame, summary: DataFrame, again: Column) -> DataFrame:
    """An inventory: items (doc, item_id, kind, chapter_id, first_start), spans (doc, chapter_id, char_first, char_last), stated counts (doc, kind, stated).

    CI01 an id that content doesn't give (``again``), CI02 spans that overlap or are out of order, CI03 a place
    outside its chapter, CI04 counts that the items don't give, CI05 ids used twice.
    """
    wrong_id = items.where(~F.col("item_id").eqNullSafe(again))
    outside = items.join(spans, ["doc", "chapter_id"]).where((F.col("first_start") < F.col("char_first")) | (F.col("first_start") >= F.col("char_last")))
    counted = items.groupBy("doc", "kind").agg(F.count("*").alias("n"))
    counts = summary.join(counted, ["doc", "kind"], "full").where(F.coalesce("stated", F.lit(0)) != F.coalesce("n", F.lit(0)))
    doc = F.col("doc").cast("string")
    return union(
        as_findings(wrong_id, "error", "CI01", F.concat_ws("/", doc, "item_id"), "the id isn't that of the content"),
        as_findings(overlaps(spans, ["doc"], "char_first", "char_last"), "error", "CI02", F.concat_ws("/", doc, "chapter_id"), "spans overlap"),
        as_findings(outside, "error", "CI03", F.concat_ws("/", doc, "item_id"), "lies outside its chapter"),
        as_findings(counts, "error", "CI04", F.concat_ws("/", doc, "kind"), "the items don't give this count"),
        as_findings(duplicates(items, "doc", "item_id"), "error", "CI05", F.concat_ws("/", doc, "item_id"), "the id is used more than once"),
    )


def package_findings(modules: DataFrame, records: DataFrame) -> DataFrame:
    """An author's package: modules (module, mode, file, reason) and its records (module, id).

    AI01 unknown mode, AI02 a mode with records that needs a file, AI03 one without that has a file or lacks a
    reason, AI04 records of a module that isn't supplied, AI05 a supplied module without records, AI06 modules named twice.
    """
    mode, supplied = F.col("mode"), F.col("mode").isin("provided", "augment")
    rules = [
        Rule("AI01", "mode", ~F.coalesce(mode.isin(*MODES), F.lit(False)), "unknown mode"),
        Rule("AI02", "file", supplied & _empty(F.col("file")), "needs a file"),
        Rule("AI02", "file", supplied & F.col("file").rlike(r"(^/|(^|/)\.\.(/|$))"), "must lie in the package"),
        Rule("AI03", "reason", (mode == "omit") & (_filled(F.col("file")) | _empty(F.col("reason"))), "what is left out has a reason and no file"),
        Rule("AI03", "file", (mode == "generate") & _filled(F.col("file")), "what is to be generated has no file"),
    ]
    given = modules.where(supplied).select("module").distinct()
    there = records.select("module").distinct()
    return union(
        findings(modules, "module", rules),
        as_findings(there.join(given, "module", "left_anti"), "error", "AI04", F.col("module"), "has records and isn't supplied"),
        as_findings(modules.where(mode == "provided").join(there, "module", "left_anti"), "error", "AI05", F.col("module"), "is supplied without records"),
        _repeated(modules, "module", "AI06"),
    )


def review_findings(units: DataFrame, history: DataFrame) -> DataFrame:
    """A review: units (unit_id, choice, reviewer, reviewed_at, before_sha256, note) and its history (unit_id, before_sha256, after_sha256).

    AR01 unknown choice, AR02 a decision without reviewer or time, AR03 a revision without a note, AR04 no hash of what was
    reviewed, AR05 history of another state than the unit's, AR06 history of no unit, AR07 units numbered twice.
    """
    choice = F.col("choice")
    made = F.coalesce(choice != "pending", F.lit(False))
    rules = [
        Rule("AR01", "choice", ~F.coalesce(choice.isin("approve", "revise", "exclude", "defer", "pending"), F.lit(False)), "unknown choice"),
        Rule("AR02", "reviewer", made & ~F.coalesce(_filled(F.col("reviewer")) & is_iso_datetime(F.col("reviewed_at")), F.lit(False)), "a decision has a reviewer and a time"),
        Rule("AR03", "note", (choice == "revise") & _empty(F.col("note")), "a revision says why"),
        _sha("before_sha256", "AR04"),
    ]
    joined = history.join(units.select("unit_id", F.col("before_sha256").alias("reviewed")), "unit_id", "left")
    return union(
        findings(units, "unit_id", rules),
        as_findings(joined.where(F.col("reviewed") != F.col("before_sha256")), "error", "AR05", F.col("unit_id"), "another state was reviewed"),
        as_findings(joined.where(F.col("reviewed").isNull()), "error", "AR06", F.col("unit_id"), "no such unit"),
        _repeated(units, "unit_id", "AR07"),
    )


def question_findings(items: DataFrame, chapters: DataFrame, least: int = 8) -> DataFrame:
    """A question plan: items (source_key, kind, chapter_ids, facets as a map of texts, char_start, char_end) and the chapters there are (chapter_id).

    QA01 unknown kind, QA02 a facet that it needs is missing or too short, QA03 unknown facets, QA04 a place that isn't
    one, QA05 chapters that aren't there, QA06 keys used twice.
    """
    said = lambda x: F.coalesce(F.length(F.trim(F.try_element_at("facets", F.lit(x)))) >= least, F.lit(False))
    rules = [
        Rule("QA01", "kind", ~F.coalesce(F.col("kind").isin(*QUESTION_KINDS), F.lit(False)), "unknown kind"),
        *[Rule("QA02", x, (F.col("kind") == "misreading") & ~said(x), f"{x} says too little") for x in ("criticism", "response")],
        Rule("QA03", "facets", F.size(F.array_except(F.map_keys("facets"), F.array(*[F.lit(x) for x in FACETS]))) > 0, "unknown facets"),
        Rule("QA04", "place", ~F.coalesce((F.col("char_start") >= 0) & (F.col("char_end") > F.col("char_start")), F.lit(False)), "isn't a place"),
    ]
    each = items.select("source_key", F.explode("chapter_ids").alias("chapter_id"))
    lost = each.join(chapters.select("chapter_id").distinct(), "chapter_id", "left_anti")
    return union(findings(items, "source_key", rules), as_findings(lost, "error", "QA05", F.col("source_key"), F.concat(F.lit("no chapter "), "chapter_id")), _repeated(items, "source_key", "QA06"))
