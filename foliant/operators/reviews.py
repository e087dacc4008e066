"""Reviews by authors: units of a review, forms to fill in, and what their decisions make of the records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.records import corrected, form_choice, protected_hash

#: Choices of a form, and the status that each gives a record (fixed values; "defer" changes nothing).
STATUS = {"approve": "approved", "revise": "draft", "exclude": "excluded"}
CHOICES = [*STATUS, "defer"]


def units(records: DataFrame, by: list[str], order: list[str], key: str, digest: str) -> DataFrame:
    """Records as units of a review, numbered in each group: unit_id, number, before_sha256."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    unit = F.concat(F.lit("RU-"), F.upper(F.substring(F.sha2(F.concat_ws("\x00", *by, F.col(key).cast("string"), F.col(digest)), 256), 1, 16)))
    return records.withColumn("number", number).withColumn("unit_id", unit).withColumnRenamed(digest, "before_sha256")


def forms(rows: DataFrame, title: str, body: str) -> DataFrame:
    """Units with ``form``: a Markdown text with a box a choice and a line for a note, and ``form_sha256`` of what mustn't be edited."""
    boxes = "\n".join(f"- [ ] {x}" for x in CHOICES)
    form = F.concat(F.lit("## "), F.col(title), F.lit("\n\nUnit: "), F.col("unit_id"), F.lit("\n\n"), F.col(body), F.lit(f"\n\n{boxes}\nNote:\n"))
    return rows.withColumn("form", form).withColumn("form_sha256", protected_hash(F.col("form")))


def decisions(filled: DataFrame, given: DataFrame) -> DataFrame:
    """unit_id, choice, note and fault of filled forms (column ``form``): "unknown" unit, "altered" text, "undecided" or "repeated"."""
    unit = F.regexp_extract("form", r"(?m)^Unit: (\S+)$", 1)
    held = filled.select("form", unit.alias("unit_id"), F.trim(F.regexp_extract("form", r"(?m)^Note:(.*)$", 1)).alias("note"), form_choice(F.col("form"), CHOICES).alias("choice"), protected_hash(F.col("form")).alias("now"))
    joined = held.join(given.select("unit_id", "form_sha256"), "unit_id", "left").withColumn("times", F.count("*").over(Window.partitionBy("unit_id")))
    fault = F.when(F.col("form_sha256").isNull(), "unknown").when(F.col("now") != F.col("form_sha256"), "altered").when(F.col("times") > 1, "repeated").when(F.col("choice").isNull(), "undecided")
    return joined.select("unit_id", "choice", "note", fault.alias("fault"))


def plan(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Units with their decision: those without one, or with a fault, are "pending"; a status follows from the choice."""
    fine = decided.where("fault IS NULL").select("unit_id", "choice", "note")
    status = F.lit(None).cast("string")
    for choice, name in STATUS.items():
        status = F.when(F.col("choice") == choice, name).otherwise(status)
    return rows.join(fine, "unit_id", "left").withColumn("choice", F.coalesce("choice", F.lit("pending"))).withColumn("new_status", status)


def apply_plan(records: DataFrame, planned: DataFrame, keys: list[str], digest: str, fields: str, status: str) -> tuple[DataFrame, DataFrame]:
    """Records after a review, and a history row for each that changed.

    A decision applies where the record's hash is the one that was reviewed; a
    record that moved since is left as it is (history: "stale"). A note of
    a revision is kept as the field review_notes.
    """
    asked = planned.where("new_status IS NOT NULL").select(*keys, "unit_id", "before_sha256", "new_status", "choice", F.col("note").alias("review_note"))
    joined = records.join(asked, keys, "left")
    fits = F.col("new_status").isNotNull() & (F.col(digest) == F.col("before_sha256"))
    noted = F.when(fits & (F.col("choice") == "revise") & (F.length("review_note") > 0), corrected(F.col(fields), {"review_notes": F.col("review_note")}, [])).otherwise(F.col(fields))
    after = joined.withColumn(fields, noted).withColumn(status, F.when(fits, F.col("new_status")).otherwise(F.col(status)))
    history = joined.where("new_status IS NOT NULL").select(*keys, "unit_id", "before_sha256", F.when(fits, "applied").otherwise("stale").alias("outcome"), F.when(fits, F.col("new_status")).alias("after_status"))
    return after.select(*records.columns), history
