from foliant.llm import lines


def test_spread_keeps_the_first_and_order(spark):
    rows = [(k, f"own {k}\nshared everywhere\n\nend {k}", f"s{k % 7}") for k in range(14)] + [(50, "two sites", "s1"), (51, "two sites", "s2"), (52, "two sites", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in lines.deduplicate(df).collect()}
    assert got[0] == "own 0\nshared everywhere\n\nend 0" and got[9] == "own 9\n\nend 9"
    assert got[50] == got[52] == "two sites"


def test_threshold_is_exact(spark):
    for sites, removed in ((lines.MIN_SITES - 1, 0), (lines.MIN_SITES, lines.MIN_SITES - 1)):
        df = spark.createDataFrame([(k, "the line", f"s{k}") for k in range(sites)], "doc_id long, text string, source string")
        assert sum(r["n_removed"] for r in lines.deduplicate(df, counts=True).collect()) == removed


def test_odd_rows(odd_docs, no_docs):
    got = lines.deduplicate(odd_docs, min_sites=3)
    assert got.columns == odd_docs.columns and got.count() == 9
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["text"] is None and by[3][0]["text"] == "" and by[4][0]["text"] == "  \n\t "
    assert [r["text"] for r in by[1]] == ["Alpha beta gamma delta.\nSame line here today."] * 2
    assert by[7][0]["text"] == "Alpha beta gamma delta." and by[7][0]["n_chars"] == len(by[7][0]["text"])
    assert by[None][0]["text"] == "Nobody's text.\nSame line here today."
    assert lines.deduplicate(no_docs).count() == 0


def test_clashing_names(spark):
    rows = [(k, f"shared\nown {k}", f"s{k}", k, "a", "b") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, removal_id int, Removal_Lines string, text_kept string")
    got = {r["doc_id"]: r for r in lines.deduplicate(docs).collect()}
    assert got[3].asDict() == {"doc_id": 3, "text": "own 3", "source": "s3", "removal_id": 3, "Removal_Lines": "a", "text_kept": "b"}
    assert got[0]["text"] == "shared\nown 0"
    other = docs.withColumnsRenamed({"removal_id": "h", "Removal_Lines": "drop", "text_kept": "keeper"})
    assert lines.deduplicate(other).columns == other.columns and lines.deduplicate(other).where("text LIKE 'shared%'").count() == 1


def test_lines_that_all_documents_hold(spark, monkeypatch):
    rows = [(k, "everywhere\n" + ("often" if k % 3 else f"own {k}"), f"s{k % 9}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["doc_id"]: r["text"] for r in lines.deduplicate(docs).collect()}
    monkeypatch.setattr(lines, "HOT_SHARE", 0)  # none is hot
    assert {r["doc_id"]: r["text"] for r in lines.deduplicate(docs).collect()} == want and want[1] == "often" and want[2] == ""
