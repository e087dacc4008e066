"""Import plans: stable units, diagnostics, merging into canonical chapters."""

from pyspark.sql import functions as F

from foliant.operators import imports

CHAPTERS = "doc int, format string, place int, chapter_id string, title string, pages string, sections array<string>"
EXISTING = "doc int, id string, kind string, title string, pages string, sections array<string>, summary string, status string"


def chapters(spark):
    return spark.createDataFrame(
        [
            (1, "markdown", 1, "CH-01", "Preface", "1-4", []),
            (1, "markdown", 2, "CH-02", "One‮  Thing", "5-9", ["a", "a", " \n"]),
            (1, "markdown", 3, "CH-APP1", "Tables", "", ["t"]),
            (2, "text", 1, None, "Just a line of prose", "", []),
            (3, "text", 1, None, "Chapter 1 Start", "", []),
            (4, "org", 1, None, "Same", "", []),
            (4, "org", 2, None, "same", "", []),
            (4, "org", 3, None, "x" * 600, "", []),
        ],
        CHAPTERS,
    )


def test_units_and_diagnostics(spark):
    units, said = imports.plan(chapters(spark))
    rows = units.collect()
    assert [(r["kind"], r["title"], r["confidence"]) for r in sorted(rows, key=lambda r: (r["doc"], r["parent_id"] or "", r["place"])) if r["doc"] == 1 and r["kind"] != "section"] == [("book", "", "high"), ("frontmatter", "Preface", "high"), ("chapter", "One Thing", "high"), ("appendix", "Tables", "high")]
    assert len({(r["doc"], r["staging_id"]) for r in rows}) == len(rows)
    sections = sorted((r["place"], r["title"]) for r in rows if r["doc"] == 1 and r["kind"] == "section")
    assert sections == [(1, "a"), (1, "t"), (2, "a")]
    again, _ = imports.plan(chapters(spark).orderBy(F.col("place").desc()))
    assert {(r["doc"], r["staging_id"]) for r in again.collect()} == {(r["doc"], r["staging_id"]) for r in rows}
    assert sorted((r["doc"], r["code"]) for r in said.collect()) == [(1, "RPIP103"), (2, "RPIP200"), (3, "RPIP100"), (4, "RPIP103"), (4, "RPIP201"), (4, "RPIP201")]
    got = {r["doc"]: r["outcome"] for r in imports.outcomes(units, said).collect()}
    assert got == {1: "ready", 2: "blocked", 3: "review_required", 4: "blocked"}


def test_merge_keeps_ids_and_demotes_what_changed(spark):
    units, _ = imports.plan(chapters(spark).where("doc = 1"))
    existing = spark.createDataFrame(
        [(1, "CH-07", "frontmatter", "preface", "1-4", [], "said", "approved"), (1, "CH-09", "chapter", "One  thing", "5-8", ["a", "a"], "more", "approved"), (9, "CH-01", "chapter", "Other book", "", [], "", "approved")],
        EXISTING,
    )
    records, wrong = imports.apply_plan(units, existing)
    got = [(r["id"], r["title"], r["sections"], r["summary"], r["status"]) for r in records.orderBy("place").collect()]
    assert got == [("CH-07", "Preface", [], "said", "draft"), ("CH-09", "One Thing", ["a", "a"], "more", "draft"), ("CH-APP1", "Tables", ["t"], "", "draft")]
    assert wrong.count() == 0
    same = existing.where("id = 'CH-07'").withColumn("title", F.lit("Preface")).unionByName(existing.where("id <> 'CH-07'"))
    assert {r["id"]: r["status"] for r in imports.apply_plan(units, same)[0].collect()}["CH-07"] == "approved"


def test_merge_refuses_what_is_unclear(spark):
    units, _ = imports.plan(chapters(spark).where("doc = 1"))
    existing = spark.createDataFrame([(1, "CH-01", "appendix", "tables", "", [], "", "draft"), (1, "CH-02", "appendix", "Tables", "", [], "", "draft"), (1, "CH-03", "chapter", "gone", "", [], "", "draft")], EXISTING)
    _, wrong = imports.apply_plan(units, existing)
    assert sorted(r["code"] for r in wrong.collect()) == ["RPIP301", "RPIP303", "RPIP303", "RPIP303"]


def test_new_chapters_get_free_numbers(spark):
    rows = spark.createDataFrame([(1, "org", k, None, f"T{k}", "", []) for k in range(1, 13)], CHAPTERS)
    existing = spark.createDataFrame([(1, "CH-02", "chapter", "T5", "", [], "", "draft"), (1, "CH-11", "chapter", "T6", "", [], "", "draft")], EXISTING)
    records, wrong = imports.apply_plan(imports.plan(rows)[0], existing)
    got = [r["id"] for r in records.orderBy("place").collect()]
    assert got == ["CH-01", "CH-03", "CH-04", "CH-05", "CH-02", "CH-11", "CH-06", "CH-07", "CH-08", "CH-09", "CH-10", "CH-12"]
    assert wrong.count() == 0


def test_manual_outline_matches_by_id(spark):
    lines = ["# notes", "CH-02 | New name | 3-9", "- first", "- second", "CH-05 | Added"]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc int, k int, line string")
    listed = imports.outline(rows, "doc", "line", "k")
    assert [(r["chapter_id"], r["title"], r["pages"], r["sections"]) for r in listed.orderBy("place").collect()] == [("CH-02", "New name", "3-9", ["first", "second"]), ("CH-05", "Added", "", [])]
    existing = spark.createDataFrame([(1, "CH-02", "chapter", "Old name", "3-9", ["first", "second"], "kept", "approved")], EXISTING)
    records, wrong = imports.apply_plan(imports.plan(listed)[0], existing, manual=True)
    assert [(r["id"], r["title"], r["summary"], r["status"]) for r in records.orderBy("place").collect()] == [("CH-02", "New name", "kept", "draft"), ("CH-05", "Added", "", "draft")]
    assert wrong.count() == 0


def test_direct_import(spark):
    existing = spark.createDataFrame([(1, "CH-01", "chapter", "x", "", [], "", "draft")], EXISTING)
    records, refused = imports.direct_import(chapters(spark), existing)
    assert [r["doc"] for r in refused.collect()] == [1] and {r["doc"] for r in records.collect()} == {2, 3, 4}
    records, refused = imports.direct_import(chapters(spark), existing, force=True)
    assert refused.count() == 0 and [r["id"] for r in records.where("doc = 1").orderBy("place").collect()] == ["CH-01", "CH-02", "CH-APP1"]
