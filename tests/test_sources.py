import io
import json
import os
import zipfile

import pytest
from pyspark.errors.exceptions.captured import SparkRuntimeException
from pyspark.sql import functions as F

from foliant.operators.plans import commit_version, head
from foliant.sources import readers, sinks
from foliant.streaming import work_queue


def book(extra=(), mimetype=b"application/epub+zip") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", mimetype)
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        z.writestr("OPS/p.opf", '<package xmlns:dc="d"><metadata><dc:title>Book</dc:title></metadata><manifest><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OPS/a.xhtml", "<html><body><h1>One</h1><p>text</p><h2>Deep</h2></body></html>")
        z.writestr("OPS/b.xhtml", "<html><body><h1>Two</h1></body></html>")
        for name, data in extra:
            z.writestr(name, data)
    return out.getvalue()


def test_epub(spark, tmp_path):
    (tmp_path / "good.epub").write_bytes(book())
    (tmp_path / "drm.epub").write_bytes(book([("META-INF/encryption.xml", "x")]))
    (tmp_path / "path.epub").write_bytes(book([("../x", "x")]))
    (tmp_path / "kind.epub").write_bytes(book(mimetype=b"zip"))
    (tmp_path / "broken.epub").write_bytes(b"PK")
    rows = readers.epub(spark, str(tmp_path)).collect()
    good = [(r["ordinal"], r["level"], r["heading"]) for r in rows if r["error"] is None]
    assert sorted(good) == [(0, 1, "One"), (0, 2, "Deep"), (1, 1, "Two")]
    assert len([r for r in rows if r["error"]]) == 4


def test_files_and_registry(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x\n")
    found = readers.texts(spark, str(tmp_path))
    assert found.first()["format"] == "markdown" and found.first()["text"] == "# x\n"
    with pytest.raises(SparkRuntimeException):
        readers.files(spark, str(tmp_path), most=1).collect()
    sources = found.select("name", F.lit("0").alias("sha256"), F.col("n_bytes").alias("size_bytes")).unionByName(spark.createDataFrame([("b.md", "1", 1)], "name string, sha256 string, size_bytes long"))
    assert {r["name"]: r["state"] for r in readers.registered(sources, found).collect()} == {"a.md": "changed", "b.md": "missing"}


def test_strict_json(spark):
    cases = {'{"a":1}': None, '{"a":1,"a":2}': "repeated key", '{"a":NaN}': "number isn't finite", '{"a":1e999}': "number isn't finite", "{": "invalid JSON"}
    rows = spark.createDataFrame([(x,) for x in cases], "t string")
    assert [r["e"] for r in rows.select(readers.json_error("t").alias("e")).collect()] == list(cases.values())


def test_string_view(spark):
    row = spark.createDataFrame([('{"a/b": ["x", {"c": "y  z"}]}',)], "t string").select(readers.string_view("t").alias("v")).first()["v"]
    assert row["text"] == "a/b\nx\nc\ny z"
    assert [(x["pointer"], x["kind"], row["text"][x["char_start"] : x["char_end"]]) for x in row["leaves"]] == [("/a~1b", "key", "a/b"), ("/a~1b/0", "value", "x"), ("/a~1b/1/c", "key", "c"), ("/a~1b/1/c", "value", "y z")]


def test_packs_and_csv(spark, tmp_path):
    (tmp_path / "pack.en.json").write_text(json.dumps({"language": "en", "chapters": [{"id": "CH-01", "title": "T", "sections": ["s"]}], "names": []}))
    found = readers.packs(spark, str(tmp_path / "pack.en.json"))
    assert found["chapters"].first()["sections"] == ["s"] and found["names"].count() == 0
    (tmp_path / "names.csv").write_text("id,name,alias\nN1,Ann,a | b|\n")
    columns = {"id": "text", "name": "text", "aliases": "list"}
    assert readers.list_csv(spark, str(tmp_path / "names.csv"), columns, {"alias": "aliases"}).first()["aliases"] == ["a", "b"]
    with pytest.raises(ValueError):
        readers.list_csv(spark, str(tmp_path / "names.csv"), columns)


def test_questions(spark):
    items = spark.createDataFrame([("p", '{"items":[{"criticism":"c","response":"r"}]}')], "path string, text string")
    assert {(r["facet"], r["pointer"]) for r in readers.qa_items(items).collect()} == {("criticism", "/items/0/criticism"), ("response", "/items/0/response")}
    outline = "* Top\n** Q one\n:PROPERTIES:\n:CUSTOM_ID: q1\n:END:\n- Criticism :: it is\n  long\n- Response :: yes\n[fn:1] note\n** Q two\n- Impact :: none\n"
    rows = readers.qa_outline(spark.createDataFrame([("p", outline)], "path string, text string")).collect()
    assert [(r["source_key"], r["facet"], r["value"]) for r in rows] == [("q1", "criticism", "it is long"), ("q1", "response", "yes"), ("", "impact", "none")]
    assert [outline[r["char_start"] : r["char_end"]] for r in rows] == ["it is\n  long", "yes", "none"]
    kinds = readers.qa_outline(spark.createDataFrame([("p", outline)], "path string, text string"), kinds={"q1": "misreading"}).collect()
    assert [r["kind"] for r in kinds] == ["misreading", "misreading", "unclassified"]


def test_author_package(spark, tmp_path):
    manifest = {"modules": {"claims": {"mode": "provided", "file": "claims.csv"}, "names": {"mode": "augment", "file": "names.json"}, "map": {"mode": "omit", "reason": "none"}}}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    (tmp_path / "claims.csv").write_text('id,text,chapters\nC1,"a, b",CH-1 | CH-2\nC2,c,\n')
    (tmp_path / "names.json").write_text('[{"id": "N1", "name": "Ada", "aliases": ["x", "y"]}]')
    columns = {"claims": {"id": "text", "statement": "text", "chapters": "list"}, "names": {"id": "text", "name": "text", "aliases": "list"}, "map": {}}
    modules, records = readers.author_package(spark, str(tmp_path), columns, {"text": "statement"})
    assert [(r["module"], r["mode"]) for r in modules.orderBy("module").collect()] == [("claims", "provided"), ("map", "omit"), ("names", "augment")]
    got = {r["id"]: r["fields"] for r in records.collect()}
    assert got == {"C1": {"id": "C1", "statement": "a, b", "chapters": "CH-1 | CH-2"}, "C2": {"id": "C2", "statement": "c"}, "N1": {"id": "N1", "name": "Ada", "aliases": "x | y"}}
    with pytest.raises(ValueError, match="unknown modules: claims"):
        readers.author_package(spark, str(tmp_path), {k: v for k, v in columns.items() if k != "claims"})


def test_adapter(spark):
    rows = spark.createDataFrame([('{"a":1}',), ("no",)], "request string")
    got = readers.adapter(rows, ["cat"]).collect()
    assert [(r["response"], r["error"]) for r in got] == [('{"a":1}', None), (None, "invalid JSON")]
    assert readers.adapter(rows, ["sleep", "5"], seconds=0.2).first()["error"] == "timeout"


def test_pdf_without_its_tool(spark, tmp_path):
    with pytest.raises(RuntimeError, match="no-such-tool"):
        readers.pdf_text(spark, str(tmp_path), tool="no-such-tool")


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "x.txt")
    sinks.create_text(path, "a")
    with pytest.raises(FileExistsError):
        sinks.create_text(path, "b")
    sinks.replace_text(path, "b")
    assert open(path).read() == "b"
    assert sinks.archive({"b": b"1", "a": b"2"}) == sinks.archive({"a": b"2", "b": b"1"})
    files = spark.createDataFrame([("a", b"1"), ("b", b"2")], "path string, content binary")
    first = sinks.publish(files, str(tmp_path / "pub"))
    assert sinks.publish(files, str(tmp_path / "pub")) == first
    packs = spark.createDataFrame([("en", "x\ny\n")], "language string, text string")
    sinks.write_packs(packs, str(tmp_path / "packs"), 100)
    assert spark.read.text(str(tmp_path / "packs"), wholetext=True).first()["value"] == "x\ny\n"
    assert [r["n"] for r in sinks.probes(spark, [64, 100]).select(F.length("body").alias("n")).collect()] == [64, 100]
    page = sinks.review_page(spark.createDataFrame([("error", "c", "p", "<m>")], "severity string, code string, path string, message string"), "t")
    assert "&lt;m&gt;" in page.first()["html"]


def test_transaction(tmp_path):
    folder = str(tmp_path)
    (tmp_path / "a").write_bytes(b"1")
    sinks.transaction(folder, {"a": (b"1", b"2"), "b": (None, b"3")})
    assert sinks.recover(folder) == "clean" and (tmp_path / "b").read_bytes() == b"3"
    record = {"a": {"before": b"2".hex(), "after": b"4".hex()}, "b": {"before": b"3".hex(), "after": b"5".hex()}}
    sinks.replace_json(f"{folder}/PREPARED.json", record)
    (tmp_path / "a").write_bytes(b"4")
    assert sinks.recover(folder) == "undone" and (tmp_path / "a").read_bytes() == b"2"
    with pytest.raises(RuntimeError):
        sinks.transaction(folder, {"a": (b"x", b"y")})


def test_work_queue(spark, tmp_path):
    ledger, inbox = str(tmp_path / "ledger"), str(tmp_path / "in")
    os.makedirs(inbox)
    work = spark.createDataFrame([("w1", "pending"), ("w2", "pending")], "work_id string, status string")
    commit_version(work, ledger, None, "start")
    (tmp_path / "in" / "1.json").write_text('{"work_id":"w1","status":"generated"}\n{"work_id":"w1","status":"generated"}\n')
    work_queue.ingest(work_queue.results(spark, inbox), ledger, str(tmp_path / "ck")).awaitTermination()
    assert head(ledger) == "00000000"
    assert work_queue.next_item(spark, ledger).first()["work_id"] == "w2"
