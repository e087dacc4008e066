"""One fault a rule, and nothing else found."""

from pyspark.sql import functions as F

from foliant.operators import manifests

A, B = "a" * 64, "b" * 64
TIME = "2026-01-02T03:04:05Z"


def codes(found):
    return sorted((r["code"], r["path"]) for r in found.collect())


def test_runs(spark):
    rows = [
        ("c1", "ready", True, [], 1, None, None, A, A),
        ("c2", "accepted", True, [], 2, "ann", TIME, A, A),
        ("c3", "lost", True, [], 1, None, None, A, A),
        ("c4", "ready", None, [], 1, None, None, A, A),
        ("c5", "quarantined", False, [], 1, None, None, A, A),
        ("c6", "rejected", False, ["x"], 1, "ann", "yesterday", A, A),
        ("c7", "proposed", False, ["x"], 0, "ann", None, A, B),
        ("c1", "ready", True, [], 1, "", None, A, A),
    ]
    held = spark.createDataFrame(rows, "candidate_id string, state string, qa_passed boolean, reasons array<string>, n_evidence int, reviewer string, reviewed_at string, record_sha256 string, stated_sha256 string")
    assert codes(manifests.run_findings(held)) == [("CR01", "c3/state"), ("CR02", "c4/qa"), ("CR03", "c5/reasons"), ("CR04", "c6/review"), ("CR04", "c7/review"), ("CR05", "c7/evidence"), ("CR06", "c7/record_sha256"), ("CR07", "c1")]


def test_ledgers(spark):
    rows = [("w1", "generated", "", ["c1"]), ("w2", "generated", "", []), ("w3", "failed", "", []), ("w4", "pending", "x", []), ("w5", "done", "", []), ("w6", "generated", "", ["c1", "c9"]), ("w1", "not_applicable", "none", [])]
    work = spark.createDataFrame(rows, "work_id string, status string, reason_code string, candidate_ids array<string>")
    known = spark.createDataFrame([("c1",)], "candidate_id string")
    assert codes(manifests.ledger_findings(work, known)) == [("WL01", "w5/status"), ("WL02", "w2/candidate_ids"), ("WL03", "w3/reason_code"), ("WL04", "w4/status"), ("WL05", "w6"), ("WL06", "c1"), ("WL07", "w1")]


def test_inventories(spark):
    items = spark.createDataFrame([(1, "i-term", "term", "CH-1", 5), (1, "i-x", "person", "CH-2", 50), (1, "i-person", "person", "CH-1", 1), (1, "i-person", "person", "CH-1", 2)], "doc int, item_id string, kind string, chapter_id string, first_start int")
    spans = spark.createDataFrame([(1, "CH-1", 0, 10), (1, "CH-2", 9, 20)], "doc int, chapter_id string, char_first int, char_last int")
    stated = spark.createDataFrame([(1, "term", 1), (1, "person", 2), (1, "reference", 0)], "doc int, kind string, stated int")
    got = codes(manifests.inventory_findings(items, spans, stated, F.concat(F.lit("i-"), "kind")))
    assert got == [("CI01", "1/i-x"), ("CI02", "1/CH-2"), ("CI03", "1/i-x"), ("CI04", "1/person"), ("CI05", "1/i-person")]


def test_packages(spark):
    rows = [("claims", "provided", "claims.csv", None), ("names", "augment", "../names.csv", None), ("terms", "provided", None, None), ("map", "omit", None, ""), ("refs", "generate", "refs.csv", None), ("rest", "later", None, None), ("claims", "augment", "x.csv", None)]
    modules = spark.createDataFrame(rows, "module string, mode string, file string, reason string")
    records = spark.createDataFrame([("claims", "1"), ("terms", "2"), ("map", "3")], "module string, id string")
    got = codes(manifests.package_findings(modules, records))
    assert got == [("AI01", "rest/mode"), ("AI02", "names/file"), ("AI02", "terms/file"), ("AI03", "map/reason"), ("AI03", "refs/file"), ("AI04", "map"), ("AI06", "claims")]
    assert codes(manifests.package_findings(modules.where("module = 'terms'"), records.limit(0)))[-1] == ("AI05", "terms")


def test_reviews(spark):
    rows = [("u1", "approve", "ann", TIME, A, None), ("u2", "revise", "ann", TIME, A, " "), ("u3", "exclude", None, TIME, A, None), ("u4", "maybe", "ann", TIME, "x", None), ("u5", "pending", None, None, A, None), ("u5", "pending", None, None, A, None)]
    units = spark.createDataFrame(rows, "unit_id string, choice string, reviewer string, reviewed_at string, before_sha256 string, note string")
    history = spark.createDataFrame([("u1", A, B), ("u2", B, A), ("u9", A, A)], "unit_id string, before_sha256 string, after_sha256 string")
    assert codes(manifests.review_findings(units, history)) == [("AR01", "u4/choice"), ("AR02", "u3/reviewer"), ("AR03", "u2/note"), ("AR04", "u4/before_sha256"), ("AR05", "u2"), ("AR06", "u9"), ("AR07", "u5")]


def test_question_plans(spark):
    full = {"criticism": "long enough", "response": "long enough"}
    rows = [("q1", "misreading", ["CH-1"], full, 0, 5), ("q2", "misreading", ["CH-2"], {"criticism": "long enough"}, 0, 5), ("q3", "other", [], full, 0, 5), ("q4", "clarification", [], {"odd": "x"}, 5, 5), ("q1", "limitation", [], {}, 1, 2)]
    items = spark.createDataFrame(rows, "source_key string, kind string, chapter_ids array<string>, facets map<string,string>, char_start int, char_end int")
    chapters = spark.createDataFrame([("CH-1",)], "chapter_id string")
    assert codes(manifests.question_findings(items, chapters)) == [("QA01", "q3/kind"), ("QA02", "q2/response"), ("QA03", "q4/facets"), ("QA04", "q4/place"), ("QA05", "q2"), ("QA06", "q1")]
