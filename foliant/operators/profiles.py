"""Quality profiles: named contracts, and what records lack under them, for many projects at once.

Every check is a relation of findings (severity, code, path, message) keyed by
project. A finding is an error in a release of a project that asks for
conformance, else a warning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import safe_line
from foliant.operators.references import union

# The contracts by name (least level, required modules, required fields of chapters, critical policies, modules that may be declared not applicable).
CONTRACTS = (
    ("general-navigation", 1, "chapters", "title", "source_fidelity non_reconstruction rights", ""),
    ("academic-argument", 3, "chapters claims references", "title summary", "source_fidelity claim_attribution epistemic_integrity non_reconstruction rights", ""),
    ("nonfiction-reading", 3, "chapters claims references", "title summary", "source_fidelity claim_attribution qualification_preservation non_reconstruction rights", "references"),
    ("textbook-learning", 3, "chapters claims glossary references", "title summary learning_objectives", "source_fidelity learning_coverage misconception_safety non_reconstruction rights", ""),
    ("fiction-spoiler-free", 2, "chapters", "title summary spoiler_scope", "source_fidelity spoiler_control interpretive_openness non_reconstruction rights", ""),
    ("anthology-attribution", 2, "chapters references", "title summary contributors", "source_fidelity contributor_attribution authority_coverage non_reconstruction rights", ""),
    ("reference-routing", 2, "chapters glossary references", "title aliases", "source_fidelity inventory_completeness alias_routing non_reconstruction rights", ""),
)
# Kinds of chapters that need not have a field.
EXEMPT = {
    "summary": "bibliography index colophon",
    "learning_objectives": "frontmatter part afterword notes bibliography glossary index colophon",
    "contributors": "frontmatter part bibliography glossary index colophon",
    "aliases": "frontmatter part afterword notes bibliography colophon",
    "spoiler_scope": "frontmatter part bibliography index colophon",
}
# Fields that are lists, those whose entries may not repeat, and the values of a spoiler scope.
LIST_FIELDS = ("sections", "terms", "contributors", "aliases", "learning_objectives")
UNIQUE_FIELDS = ("contributors", "aliases")
SPOILER_SCOPES = ("none", "chapter_only", "labeled_spoilers", "full_book")


@dataclass(frozen=True)
class Floor:
    """A metric's least value and the code of a finding below it."""

    metric: str
    least: float
    code: str


def contracts(spark: SparkSession) -> DataFrame:
    """profile, level, modules, fields, policies and not_applicable (lists) of every contract."""
    rows = [(name, level, *[x.split() for x in lists]) for name, level, *lists in CONTRACTS]
    return spark.createDataFrame(rows, "profile string, level int, modules array<string>, fields array<string>, policies array<string>, not_applicable array<string>")


def below_floors(values: DataFrame, key: str, floors: list[Floor]) -> DataFrame:
    """key, metric, value, least and code of the metrics (a column each) that are below their floor."""
    each = [F.struct(F.lit(f.metric).alias("metric"), F.col(f.metric).cast("double").alias("value"), F.lit(float(f.least)).alias("least"), F.lit(f.code).alias("code")) for f in floors]
    return values.select(key, F.inline(F.array(*each))).where("value < least")


def rederived_metrics(stated: DataFrame, evidence: DataFrame, key: str, column: str, matched: str, observed: str, tolerance: float = 1e-12) -> DataFrame:
    """Keys whose stated rate isn't matched / observed of the evidence; one without evidence has none."""
    both = stated.select(key, column).join(evidence.select(key, matched, observed), key, "left")
    again = F.when(F.col(observed) > 0, F.col(matched) / F.col(observed))
    return both.withColumn("derived", again).where(F.coalesce(F.abs(F.col("derived") - F.col(column)) > tolerance, ~F.col(column).eqNullSafe(F.col("derived"))))


def _found(rows: DataFrame, code: str, path: Column, message: Column | str, always: bool = False) -> DataFrame:
    """Findings of rows that have project, release and conformance."""
    severity = F.lit("error") if always else F.when(F.col("release") & F.col("conformance"), "error").otherwise("warning")
    return rows.select("project", severity.alias("severity"), F.lit(code).alias("code"), path.alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def plan_findings(projects: DataFrame) -> DataFrame:
    """Plans by themselves; ``projects`` has project, release, conformance, profile, level and the plan's columns.

    QP001 no plan, QP041 the level is too low, QP008 no reviewer, QP010 the authority
    hasn't approved, QP042 it approved other data, QP012 a spoiler policy that
    the profile doesn't allow, QP036 to QP040 the measured evaluation.
    """
    known = projects.join(F.broadcast(contracts(projects.sparkSession).withColumnRenamed("level", "least_level")), "profile")
    at = lambda x: F.lit(f"quality-plan.{x}")
    result = lambda x: at(f"acceptance.result.{x}")
    below = [known.where(F.col(x) < F.col(f"least_{x}")).transform(_found, "QP037", result(x), "measured result does not meet the threshold") for x in ("structure_precision", "structure_recall")]
    above = [known.where(F.col(x) > F.col(f"most_{x}")).transform(_found, "QP038", result(x), "measured result does not meet the threshold") for x in ("source_attribution_errors", "invented_records")]
    lines = [known.where(~safe_line(F.col(x), 500) | F.col(x).isNull()).transform(_found, "QP040", result(x), "must be one safe non-empty line") for x in ("evidence_record", "reviewer")]
    return union(
        projects.where(F.col("profile").isNull()).select("project", F.when(F.col("release"), "error").otherwise("warning").alias("severity"), F.lit("QP001").alias("code"), F.lit("quality-plan").alias("path"), F.lit("quality plan is absent").alias("message")),
        _found(known.where("level < least_level"), "QP041", F.lit("level"), F.format_string("profile %s requires level %d or higher", "profile", "least_level")),
        _found(known.where(F.coalesce(F.size("reviewers"), F.lit(0)) <= 0), "QP008", at("authority.reviewers"), "conformance requires a named reviewer"),
        _found(known.where(F.col("authority_status").isin("pending", "reviewed")), "QP010", at("authority.status"), "conformance requires approved"),
        _found(known.where(~F.col("authority_data").eqNullSafe(F.col("data_sha256"))), "QP042", at("authority.canonical_data_sha256"), "approval is absent or stale"),
        _found(known.where((F.col("profile") == "fiction-spoiler-free") & (F.col("spoiler_policy") != "spoiler_free")), "QP012", at("spoiler_policy"), "fiction-spoiler-free requires spoiler_free"),
        _found(known.where(F.col("result_status").isin("pending", "reviewed")), "QP036", result("status"), "release requires an approved evaluation"),
        _found(known.where(~F.col("result_data").eqNullSafe(F.col("data_sha256"))), "QP039", result("canonical_data_sha256"), "evaluation is stale"),
        *below,
        *above,
        *lines,
    )


def module_findings(projects: DataFrame, overrides: DataFrame, records: DataFrame, languages: DataFrame) -> DataFrame:
    """QP017 a mandatory module declared not applicable, QP018 one made optional, QP019 a required one that is empty in some language.

    ``overrides`` has project, module, status; ``records`` project, lang, module; ``languages`` project, lang.
    """
    known = projects.join(F.broadcast(contracts(projects.sparkSession).drop("level")), "profile")
    asked = overrides.join(known, "project")
    mandatory, excusable = F.array_contains("modules", F.col("module")), F.array_contains("not_applicable", F.col("module"))
    path = F.concat(F.lit("quality-plan.module_overrides."), "module")
    required = known.select("project", "release", "conformance", F.explode("modules").alias("module"))
    excused = overrides.where("status = 'not_applicable'").select("project", "module")
    added = overrides.where("status = 'required'").join(known, "project").select("project", "release", "conformance", "module")
    effective = required.join(excused, ["project", "module"], "left_anti").select("project", "release", "conformance", "module").unionByName(added).distinct()
    empty = effective.join(languages, "project").join(records.select("project", "lang", "module").distinct(), ["project", "lang", "module"], "left_anti")
    return union(
        _found(asked.where((F.col("status") == "not_applicable") & mandatory & ~excusable), "QP017", path, F.concat("module", F.lit(" is mandatory"))),
        _found(asked.where((F.col("status") == "optional") & mandatory), "QP018", path, F.concat("module", F.lit(" cannot be made optional"))),
        _found(empty.select("project", "release", "conformance", "module").distinct(), "QP019", F.concat(F.lit("data.*."), "module"), F.concat("module", F.lit(" is required in every language"))),
    )


def chapter_findings(projects: DataFrame, chapters: DataFrame) -> DataFrame:
    """QP020: a chapter without a valid value of a field that its profile requires and its kind isn't exempt from.

    ``chapters`` has project, lang, place, kind and the fields as columns: texts, and lists of texts.
    """
    known = projects.join(F.broadcast(contracts(projects.sparkSession).drop("level")), "profile").select("project", "release", "conformance", "profile", "fields")
    joined = chapters.join(known, "project")
    parts = []
    for field in sorted({x for _, _, _, fields, *_ in CONTRACTS for x in fields.split()}):
        c = F.col(field)
        if field in LIST_FIELDS:
            valid = (F.size(c) > 0) & (F.size(c) <= 1000) & F.forall(c, lambda x: safe_line(x, 500))
            valid = valid & (F.size(F.array_distinct(c)) == F.size(c)) if field in UNIQUE_FIELDS else valid
        elif field == "spoiler_scope":
            valid = c.isin(*SPOILER_SCOPES) & ((F.col("profile") != "fiction-spoiler-free") | (c == "none"))
        else:
            valid = safe_line(c, 500)
        asked = F.array_contains("fields", F.lit(field)) & ~F.coalesce(F.col("kind").isin(*EXEMPT.get(field, "").split()), F.lit(False))
        path = F.format_string(f"data.%s.chapters[%d].{field}", F.col("lang"), F.col("place"))
        parts.append(_found(joined.where(asked & ~F.coalesce(valid, F.lit(False))), "QP020", path, f"a valid {field} is required"))
    return union(*parts)


def policy_findings(projects: DataFrame, policies: DataFrame) -> DataFrame:
    """QP023 a critical policy that isn't approved, QP031 one that the profile doesn't have. ``policies`` has project, policy, state."""
    known = projects.join(F.broadcast(contracts(projects.sparkSession).drop("level")), "profile").select("project", "release", "conformance", F.col("policies").alias("critical"))
    asked = policies.join(known, "project")
    is_critical = F.array_contains("critical", F.col("policy"))
    path = F.concat(F.lit("quality-plan.critical_policies."), "policy")
    return union(
        _found(asked.where(is_critical & F.col("state").isin("pending", "reviewed")), "QP023", path, "conformance requires approved"),
        _found(asked.where(~is_critical), "QP031", path, "the profile has no such policy", always=True),
    )


def floor_findings(projects: DataFrame, floors: DataFrame, metrics: DataFrame, languages: DataFrame) -> DataFrame:
    """QP051 a floor for a language that the project hasn't, QP052 a metric below its floor.

    ``floors`` and ``metrics`` have project, lang, metric and ``least`` or ``value``.
    """
    known = projects.select("project", "release", "conformance")
    asked = floors.join(known, "project")
    foreign = asked.join(languages, ["project", "lang"], "left_anti")
    short = asked.join(metrics, ["project", "lang", "metric"]).where("value < least")
    return union(
        _found(foreign.select("project", "release", "conformance", "lang").distinct(), "QP051", F.concat(F.lit("content_floor.languages."), "lang"), "must use a project language", always=True),
        _found(short, "QP052", F.concat_ws(".", F.lit("data"), "lang", "metric"), F.format_string("observed %s is below the floor %s", F.col("value").cast("string"), F.col("least").cast("string"))),
    )
