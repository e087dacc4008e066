"""Whole packs in files: records, references, translations, release, counts."""

import copy
import json

from pyspark.sql import functions as F

from foliant.functions.hashing import semantic_hash
from foliant.operators import packs
from foliant.sources import readers

SHA = "a" * 64
GOOD = {
    "language": "en",
    "book": {"title": "T"},
    "chapters": [{"id": "CH-01", "kind": "chapter", "title": "One", "pages": "1-2", "sections": ["a"], "summary": "Short.", "terms": ["x", " "], "status": "approved"}],
    "certainty": [{"id": "CE-1", "label": "high", "definition": "sure", "status": "approved"}],
    "claims": [{"id": "CL-1", "layer": "descriptive", "kind": "k", "statement": "It is.", "chapter_ids": ["CH-01"], "certainty_id": "CE-1", "falsifiability": "f", "status": "approved"}],
    "misreadings": [{"id": "MI-1", "kind": "k", "misreading": "m", "response": "r", "chapter_ids": ["CH-01"], "claim_ids": ["CL-1"], "status": "approved"}],
    "policies": [{"id": "PO-1", "kind": "k", "statement": "s", "status": "approved"}],
    "names": [{"id": "NA-1", "name": "Ada", "aliases": [], "chapter_id": "CH-01", "book_context": "She wrote the first notes.", "status": "approved"}],
    "glossary": [{"id": "GL-1", "term": "AGI", "aliases": ["x"], "chapter_id": "CH-01", "book_meaning": "What the last chapter is about.", "status": "approved"}],
    "references": [{"id": "RE-1", "label": "Site", "url": "https://x.org", "status": "approved", "provenance_source_id": "SRC-2", "provenance_source_hash": SHA}],
}


def read(spark, folder, **files):
    folder.mkdir(exist_ok=True)
    for name, pack in files.items():
        (folder / f"pack.{name}.json").write_text(json.dumps(pack))
    return readers.packs(spark, str(folder))


def changed(**edits):
    pack = copy.deepcopy(GOOD)
    for place, value in edits.items():
        collection, field = place.split("__")
        pack[collection][0][field] = value
    return pack


def codes(rows):
    return sorted((r["code"], r["path"]) for r in rows.collect())


def test_records_and_references(spark, tmp_path):
    held = read(spark, tmp_path / "good", en=GOOD)
    assert codes(packs.record_findings(held)) == [] and codes(packs.reference_findings(held)) == []
    bad = changed(
        chapters__summary="x" * 501, claims__revision_conditions="r", claims__certainty_id="CE-9", claims__chapter_ids=["CH-01", "CH-77"], misreadings__claim_ids=["CL-9"], names__chapter_id="CH-88", names__aliases=["ok", ""],
        glossary__id="NA-1", glossary__book_meaning="y" * 501, references__url="ftp://x", references__provenance_source_hash=None, policies__statement="a‮b",
    )
    held = read(spark, tmp_path / "bad", en=bad)
    assert codes(packs.record_findings(held)) == [
        ("RP107", "pack.en.json.claims[0]"),
        ("RP109", "pack.en.json.references[0].url"),
        ("RP117", "pack.en.json.chapters[0].summary"),
        ("RP123", "pack.en.json.glossary[0].book_meaning"),
        ("RP123", "pack.en.json.names[0].aliases"),
        ("RP123", "pack.en.json.policies[0].statement"),
        ("RP127", "pack.en.json.references[0]"),
    ]
    assert codes(packs.reference_findings(held)) == [
        ("RP115", "pack.en.json.glossary[0].id"),
        ("RP118", "pack.en.json.claims[0].chapter_ids"),
        ("RP119", "pack.en.json.names[0]"),
        ("RP120", "pack.en.json.claims[0].certainty_id"),
        ("RP121", "pack.en.json.misreadings[0].claim_ids"),
    ]


def test_translations(spark, tmp_path):
    held = read(spark, tmp_path / "one", en=GOOD)
    hashes = {name: rows.select(semantic_hash(rows, [c for c in rows.columns if c not in ("path", "language", "pos")]).alias("h")).first()["h"] for name, rows in held.items()}
    french = copy.deepcopy(GOOD) | {"language": "fr"}
    for name, h in hashes.items():
        french[name][0] |= {"source_id": french[name][0]["id"], "source_hash": h, "translation_status": "draft"}
    project = F.lit("p")
    both = read(spark, tmp_path / "two", en=GOOD, fr=french)
    assert codes(packs.bilingual_findings(both, "en", project)) == []
    french["claims"][0] |= {"source_hash": "0", "translation_status": None}
    french["names"][0]["source_id"] = "NA-2"
    french["glossary"] = []
    french["policies"].append({"id": "PO-2"})
    both = read(spark, tmp_path / "three", en=GOOD, fr=french)
    assert codes(packs.bilingual_findings(both, "en", project)) == [
        ("RP200", "pack.fr.json.glossary"),
        ("RP200", "pack.fr.json.policies"),
        ("RP201", "pack.fr.json.names[0].source_id"),
        ("RP202", "pack.fr.json.claims[0].source_hash"),
        ("RP203", "pack.fr.json.claims[0].translation_status"),
    ]


def test_release_and_counts(spark, tmp_path):
    gates = {g: a.split()[0] for g, a in packs.GATES.items()}
    workflow = spark.createDataFrame([("p", "CC", *gates.values())], ", ".join(f"{c} string" for c in ("project", "license", *gates)))
    held = read(spark, tmp_path / "good", en=GOOD)
    assert codes(packs.release_findings(held, workflow)) == []
    wrong = workflow.withColumn("rights_review", F.lit("pending")).withColumn("license", F.lit("rights-holder decision pending"))
    held = read(spark, tmp_path / "bad", en=changed(names__book_context=" ", glossary__book_meaning="too short", claims__status="draft"))
    assert [c for c, _ in codes(packs.release_findings(held, wrong))] == ["RP300", "RP301", "RP302", "RP303", "RP304"]
    row = packs.content_metrics(read(spark, tmp_path / "good", en=GOOD)).first().asDict()
    assert len(row) == 17 and row["chapter_terms"] == 1 and row["claims_with_certainty"] == row["claims_with_falsifiability"] == 1 and row["claims_with_revision_conditions"] == 0
    assert row["summary_characters"] == 6 and row["content_characters"] == 6 + 1 + 4 + 7 + 2 + 1 + (3 + 26) + (3 + 31) + 4
