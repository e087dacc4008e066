"""Candidates, reviews, profiles, settings, tools and transactions."""

import os
import stat

import pytest
from pyspark.errors.exceptions.captured import SparkRuntimeException
from pyspark.sql import functions as F

from foliant.functions import records as fields
from foliant.operators import candidates, profiles, records, reviews, rules
from foliant.operators import references as ref
from foliant.sources import readers, sinks


def test_candidates_and_ledger(spark):
    items = spark.createDataFrame(
        [(1, "CI-1", "person", "Ada", "", "CH-01"), (1, "CI-2", "term", "AGI", "", ""), (1, "CI-3", "reference", "x.org", "https://x.org", ""), (1, "CI-4", "term", "y" * 300, "", "CH-02")],
        "doc int, item_id string, kind string, label string, url string, chapter_id string",
    )
    got = {r["fields"].get("name") or r["fields"].get("term") or r["fields"].get("label"): r for r in candidates.from_catalog(items, "run").collect()}
    assert got["Ada"]["fields"] == {"name": "Ada", "chapter_id": "CH-01", "status": "draft"} and got["Ada"]["state"] == "ready"
    assert (got["AGI"]["state"], got["AGI"]["reasons"]) == ("quarantined", ["unresolved_chapter"])
    assert got["x.org"]["fields"]["url"] == "https://x.org" and got["y" * 300]["reasons"] == ["too_long"]
    chapters = spark.createDataFrame([(1, "CH-01"), (1, "CH-02")], "doc int, chapter_id string")
    work = {(r["module"], r["chapter_id"]): (r["status"], len(r["candidate_ids"])) for r in candidates.ledger(candidates.from_catalog(items, "run"), chapters, ["names", "glossary"]).collect()}
    assert work == {("names", "CH-01"): ("generated", 1), ("names", "CH-02"): ("not_applicable", 0), ("glossary", "CH-01"): ("not_applicable", 0), ("glossary", "CH-02"): ("not_applicable", 0)}
    targets = items.select("doc", "item_id")
    answers = spark.createDataFrame([(1, "CI-1", " a\n b "), (1, "CI-2", "x"), (1, "CI-2", "y"), (1, "CI-3", "z" * 600)], "doc int, item_id string, text string")
    states = {r["item_id"]: (r["state"], r["reasons"]) for r in candidates.from_contexts(targets, answers, "book_context").collect()}
    assert states == {"CI-1": ("ready", []), "CI-2": ("quarantined", ["repeated"]), "CI-3": ("quarantined", ["too_long"]), "CI-4": ("quarantined", ["missing"])}
    asked = spark.createDataFrame([(1, "Q1", "misreading", {"criticism": "x"}), (1, "Q2", "misreading", {"criticism": " "}), (1, "Q3", "unclassified", {"criticism": "x"})], "doc int, source_key string, kind string, facets map<string,string>")
    assert sorted(r["state"] for r in candidates.from_questions(asked, ["misreading"]).collect()) == ["quarantined", "ready"]


def test_a_review_from_forms_to_records(spark):
    rows = spark.createDataFrame([("en", k, f"Title {k}", f"h{k}", {"title": f"t{k}"}, "draft") for k in range(6)], "lang string, id int, title string, sha string, fields map<string,string>, status string")
    asked = reviews.forms(reviews.units(rows, ["lang"], ["id"], "id", "sha"), "title", "title").cache()
    held = {r["id"]: r["form"] for r in asked.collect()}
    assert [r["number"] for r in asked.orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    filled = [
        (held[0].replace("[ ] approve", "[x] approve"),),
        (held[1].replace("[ ] revise", "[X] revise").replace("Note:", "Note: say more"),),
        (held[2].replace("[ ] approve", "[x] approve").replace("[ ] revise", "[x] revise"),),
        (held[3].replace("[ ] approve", "[x] approve").replace("Title", "Other"),),
        (held[4].replace("[ ] exclude", "[x] exclude"),),
        (held[5].replace("[ ] approve", "[x] approve").replace("RU-", "RU-0"),),
    ]
    decided = reviews.decisions(spark.createDataFrame(filled, "form string"), asked)
    assert sorted((r["choice"] or "", r["fault"] or "") for r in decided.collect()) == [("", "undecided"), ("approve", ""), ("approve", "altered"), ("approve", "unknown"), ("exclude", ""), ("revise", "")]
    planned = reviews.plan(asked, decided)
    now = rows.withColumn("sha", F.when(F.col("id") == 4, "moved").otherwise(F.col("sha")))
    after, history = reviews.apply_plan(now, planned, ["lang", "id"], "sha", "fields", "status")
    assert {r["id"]: (r["status"], r["fields"].get("review_notes")) for r in after.collect()} == {0: ("approved", None), 1: ("draft", "say more"), 2: ("draft", None), 3: ("draft", None), 4: ("draft", None), 5: ("draft", None)}
    assert {r["id"]: r["outcome"] for r in history.collect()} == {0: "applied", 1: "applied", 4: "stale"}


PROJECT = "project int, release boolean, conformance boolean, profile string, level int, reviewers array<string>, authority_status string, authority_data string, data_sha256 string, spoiler_policy string, result_status string, structure_precision double, structure_recall double, source_attribution_errors int, invented_records int, least_structure_precision double, least_structure_recall double, most_source_attribution_errors int, most_invented_records int, result_data string, evidence_record string, reviewer string"


def test_profile_findings(spark):
    good = (1, True, True, "academic-argument", 3, ["a"], "approved", "h", "h", "not_applicable", "approved", 1.0, 1.0, 0, 0, 1.0, 1.0, 0, 0, "h", "e.json", "r")
    bad = (2, True, True, "fiction-spoiler-free", 1, [], "pending", "old", "h", "full", "reviewed", 0.5, 1.0, 1, 0, 1.0, 1.0, 0, 0, None, "", "r")
    draft = (3, False, True, "fiction-spoiler-free", 1, ["a"], "approved", "h", "h", "spoiler_free", "approved", 1.0, 1.0, 0, 0, 1.0, 1.0, 0, 0, "h", "e", "r")
    none = (4, True, False, None, *[None] * 18)
    projects = spark.createDataFrame([good, bad, draft, none], PROJECT)
    got = sorted((r["project"], r["code"], r["severity"]) for r in profiles.plan_findings(projects).collect())
    assert got == [(2, c, "error") for c in ("QP008", "QP010", "QP012", "QP036", "QP037", "QP038", "QP039", "QP040", "QP041", "QP042")] + [(3, "QP041", "warning"), (4, "QP001", "error")]

    languages = spark.createDataFrame([(1, "en"), (1, "fr"), (2, "en")], "project int, lang string")
    held = spark.createDataFrame([(1, "en", "chapters"), (1, "fr", "chapters"), (1, "en", "claims"), (1, "en", "references"), (1, "fr", "references"), (2, "en", "chapters")], "project int, lang string, module string")
    overrides = spark.createDataFrame([(1, "claims", "optional"), (1, "references", "not_applicable"), (2, "glossary", "required")], "project int, module string, status string")
    found = sorted((r["project"], r["code"], r["path"].split(".")[-1]) for r in profiles.module_findings(projects, overrides, held, languages).collect())
    assert found == [(1, "QP017", "references"), (1, "QP018", "claims"), (1, "QP019", "claims"), (2, "QP019", "glossary")]

    chapters = spark.createDataFrame(
        [(2, "en", 0, "chapter", "T", "S", "full_book", None, None, None), (2, "en", 1, "index", "T", "", "none", None, None, None), (2, "en", 2, "part", "", "S", None, None, None, None)],
        "project int, lang string, place int, kind string, title string, summary string, spoiler_scope string, contributors array<string>, aliases array<string>, learning_objectives array<string>",
    )
    paths = sorted(r["path"] for r in profiles.chapter_findings(projects, chapters).collect())
    assert paths == ["data.en.chapters[0].spoiler_scope", "data.en.chapters[2].title"]

    policies = spark.createDataFrame([(1, "rights", "approved"), (1, "claim_attribution", "pending"), (1, "spoiler_control", "approved")], "project int, policy string, state string")
    assert sorted((r["code"], r["path"].split(".")[-1]) for r in profiles.policy_findings(projects, policies).collect()) == [("QP023", "claim_attribution"), ("QP031", "spoiler_control")]
    floors = spark.createDataFrame([(1, "en", "claims", 5.0), (1, "de", "claims", 1.0)], "project int, lang string, metric string, least double")
    metrics = spark.createDataFrame([(1, "en", "claims", 4.0)], "project int, lang string, metric string, value double")
    assert sorted(r["code"] for r in profiles.floor_findings(projects, floors, metrics, languages).collect()) == ["QP051", "QP052"]
    assert profiles.contracts(spark).count() == 7


def test_settings_lines(spark):
    texts = ["[a]\nk = 1\n[b]\nk = 2 # x\n", "[b]\n[a]\nother = 1\n", "", "[a.b]\nk = 1\n[b] # c\n"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r["e"] for r in rows.select(fields.edited_setting(F.col("t"), "b", "k", F.lit('"$\\9"')).alias("e")).collect()]
    line = 'k = "$\\9"\n'
    assert got == [f"[a]\nk = 1\n[b]\n{line}", f"[b]\n{line}[a]\nother = 1\n", f"[b]\n{line}", f"[a.b]\nk = 1\n[b]\n{line}"]


def test_metadata_and_versions(spark):
    rows = spark.createDataFrame([({"model": " a\n b ", "note": "x" * 9, "bad": "y", "run": "‮z"},)], "m map<string,string>")
    assert rows.select(fields.sanitised_metadata(F.col("m"), {"model": 9, "note": 5, "run": 9}).alias("m")).first()["m"] == {"model": "a b"}
    with pytest.raises(SparkRuntimeException):
        rules.supported(spark.createDataFrame([(1,), (3,)], "v int"), "v", [1, 2]).collect()
    assert rules.supported(spark.createDataFrame([(1,), (2,)], "v int"), "v", [1, 2]).count() == 2
    with pytest.raises(ValueError, match="xx"):
        rules.in_languages(rows, "lang", ["xx"], ["en"])


def test_structured_errors_and_forms(spark):
    rows = spark.createDataFrame([("- [x] approve\n- [ ] revise\nNote: a", "- [ ] approve\n- [ ] revise\nNote: b")], "a string, b string")
    same = rows.select((fields.protected_hash(F.col("a")) == fields.protected_hash(F.col("b"))).alias("s"), fields.form_choice(F.col("a"), ["approve"]).alias("c"), fields.form_choice(F.col("a"), ["revise"]).alias("d")).first()
    assert same["s"] and same["c"] == "approve" and same["d"] is None
    leaves = spark.createDataFrame([('{"a": {"b/c": [1, "x", null, true]}}',), ("{",), (None,)], "j string").select(fields.leaves("j").alias("l")).collect()
    assert [[(x["path"], x["value"]) for x in r["l"]] for r in leaves] == [[("/a/b~1c/0", "1"), ("/a/b~1c/1", "x"), ("/a/b~1c/3", "true")], [], []]


def test_selections(spark):
    rows = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "draft"), ("b", 3, "draft")], "g string, k int, s string")
    assert sorted((r["g"], r["k"], r["number"]) for r in records.approved_rules(rows, ["g"], ["k"], F.col("s") == "ok").collect() if r["k"]) == [("a", 1, 1)]
    assert [r["g"] for r in records.approved_rules(rows, ["g"], ["k"], F.col("s") == "ok").where("number = 0").collect()] == ["b"]
    kept, dropped = records.actionable(rows, F.col("s") == "ok", F.lit(None).cast("boolean"))
    assert kept.count() == 1 and dropped.first()["dropped"] == 2
    labels = spark.createDataFrame([("The Old Man",), ("the",), ("Sea ",), ("old",)], "l string")
    stop = spark.createDataFrame([("SEA",)], "w string")
    assert [r["l"] for r in records.without_stop_words(labels, "l", stop, "w", ["the", "the old"]).collect()] == ["Man", "the", "old"]
    states = ref.state_faults(spark.createDataFrame([(1, "x"), (2, "y")], "k int, h string"), spark.createDataFrame([(2, "z"), (3, "w")], "k int, h string"), ["k"], "h")
    assert sorted((r["k"], r["code"]) for r in states.collect()) == [(1, "RP500"), (2, "RP502"), (3, "RP501")]


def tool(path, body):
    path.write_text(f"#!/bin/sh\n{body}\n")
    path.chmod(path.stat().st_mode | stat.S_IXUSR)
    return str(path)


def test_pdf_through_tools(spark, tmp_path):
    for name in ("good", "locked", "wordy", "broken"):
        (tmp_path / f"{name}.pdf").write_bytes(name.encode())
    info = tool(tmp_path / "info", 'x=$(cat); case "$x" in locked) echo "Encrypted: yes";; broken) exit 3;; *) echo "Title: A Book"; echo "Encrypted: no";; esac; echo "Pages: 2"')
    text = tool(tmp_path / "text", 'x=$(cat); if [ "$x" = wordy ]; then while :; do echo 0123456789; done; fi; printf "one\\ftwo\\f"')
    got = {os.path.basename(r["path"]): (r["title"], r["pages"], r["text"], r["error"]) for r in readers.pdf_text(spark, str(tmp_path), text, info, most=100_000).collect()}
    assert got == {"good.pdf": ("A Book", 2, "one\ftwo\f", None), "locked.pdf": (None, 2, None, "encrypted"), "wordy.pdf": (None, None, None, "too much output"), "broken.pdf": (None, None, None, "exit 3")}
    with pytest.raises(readers.ToolError, match="timeout"):
        readers._output(["sleep", "30"], b"", 0.3, 10)


def test_resources_and_scaffold(spark, tmp_path):
    made = sinks.scaffold(str(tmp_path / "p"), "en", {"claims": ["id", "statement"]}, "author")
    assert made == ["claims.csv", "manifest.json"] and (tmp_path / "p/claims.csv").read_text() == "id,statement\n"
    with pytest.raises(FileExistsError):
        sinks.scaffold(str(tmp_path / "p"), "en", {"claims": ["id"]}, "author")
    (tmp_path / "p/skip.bin").write_bytes(b"\xff")
    (tmp_path / "p/skip.bin").unlink()
    assert sorted((r["name"], r["kind"]) for r in readers.resources(spark, str(tmp_path / "p")).collect()) == [("manifest.json", "json")]


def test_transaction_hooks(tmp_path):
    (tmp_path / "a").write_bytes(b"1")
    with pytest.raises(PermissionError):
        sinks.transaction(str(tmp_path), {"../b": (None, b"x")})
    with pytest.raises(PermissionError):
        sinks.transaction(str(tmp_path), {"a": (b"1", b"2")}, allowed=lambda name: name == "c")

    def refuse(folder):
        assert (tmp_path / "a").read_bytes() == b"2"
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        sinks.transaction(str(tmp_path), {"a": (b"1", b"2"), "c": (None, b"3")}, check=refuse)
    assert (tmp_path / "a").read_bytes() == b"1" and not (tmp_path / "c").exists() and sinks.recover(str(tmp_path)) == "clean"
    sinks.transaction(str(tmp_path), {"a": (b"1", b"2")}, check=lambda folder: None)
    assert (tmp_path / "a").read_bytes() == b"2"
