"""Edge cases that the tables don't have."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.errors.exceptions.captured import SparkRuntimeException
from pyspark.sql import functions as F

from foliant.functions import hashing, rolling, text
from foliant.operators import catalog, extract, layout, metrics, plans, references, windows
from foliant.registry import QUERIES, SQL


def values(df, column):
    return [r[column] for r in df.collect()]


def test_normalize(spark):
    df = spark.createDataFrame([("ﬁne　Straße\t\n x ",), (None,), ("",)], "t string")
    assert values(df.select(text.normalize_text("t").alias("n")), "n") == ["fine strasse x", None, ""]
    assert values(df.select(text.flat_text("t").alias("n")), "n") == ["fine Straße x", None, ""]


def test_compact_view(spark):
    row = spark.createDataFrame([("人 工 知 能 is A I ok",)], "t string").select(text.compact_view("t").alias("v")).first()["v"]
    assert row["text"] == "人工知能 is AI ok"
    assert len(row["offsets"]) == len(row["text"]) and row["offsets"][1] == 2


def test_grounded_needs_a_word(spark):
    df = spark.createDataFrame([("an axis of ai", "ai"), ("maintain", "ai"), ("人工知能だ", "知能")], "t string, w string")
    assert values(df.select(text.grounded(F.col("t"), F.col("w")).alias("g")), "g") == [True, False, True]


def test_positions_and_snippet(spark):
    df = spark.createDataFrame([("aXbXXc", "X"), ("none", "X"), ("aaa", "aa")], "t string, w string")
    assert values(df.select(text.positions(F.col("t"), F.col("w")).alias("p")), "p") == [[1, 3, 4], [], [0]]


def test_page_locator(spark):
    df = spark.createDataFrame([("12",), ("12–15",), ("x",)], "t string")
    got = values(df.select(text.page_locator(F.col("t")).alias("p")), "p")
    assert [x and (x["first"], x["last"]) for x in got] == [(12, 12), (12, 15), None]


def test_semantic_hash_of_a_known_record(spark):
    """The hash ignores review keys and key order; null is absent."""
    a = spark.createDataFrame([("x", ["b"], "draft", None)], "id string, terms array<string>, status string, note string")
    b = spark.createDataFrame([(["b"], "approved", "x")], "terms array<string>, status string, id string")
    assert a.select(hashing.semantic_hash(a).alias("h")).first() == b.select(hashing.semantic_hash(b).alias("h")).first()
    assert a.select(hashing.canonical_json(a).alias("j")).first()["j"] == '{"id":"x","status":"draft","terms":["b"]}'


def test_markdown_fences_and_nesting(spark):
    body = "# Book\n```\n# no\n```\n## One #\ntext\n### Part &amp; x\n## Two {#two}\n"
    heads = extract.markdown_headings(spark.createDataFrame([(1, body)], "doc int, text string"))
    title = extract.implicit_title(heads)
    assert title.first()["title"] == "Book" and title.first()["skip_first"]
    got = {r["id"]: (r["title"], r["sections"]) for r in extract.chapters(heads, title).collect()}
    assert got == {"CH-01": ("One", ["Part & x"]), "CH-02": ("Two", [])}


def test_org_include_is_an_error(spark):
    df = spark.createDataFrame([(1, "* A\n#+INCLUDE: x\n")], "doc int, text string")
    with pytest.raises(SparkRuntimeException):
        extract.org_headings(df).collect()


def test_plain_text_fallback(spark):
    df = spark.createDataFrame([(1, "T\n\nfirst\nmore"), (2, "T\nChapter 1 A\nx\nChapter 2 B"), (3, "")], "doc int, text string")
    got = sorted((r["doc"], r["title"]) for r in extract.text_headings(df).collect())
    assert got == [(1, "first"), (2, "Chapter 1 A"), (2, "Chapter 2 B")]


def test_packing_keeps_order_and_marks_large_records(spark):
    df = spark.createDataFrame([("a", k, n) for k, n in enumerate([5, 5, 5, 20, 1])], "g string, k int, n int")
    got = [(r["part"], r["over"]) for r in layout.pack_records(df, ["g"], "k", F.col("n"), 12).orderBy("k").collect()]
    assert got == [(1, False), (1, False), (2, False), (3, True), (4, False)]


def test_template_placeholder_left(spark):
    with pytest.raises(SparkRuntimeException):
        spark.range(1).select(layout.fill_template(F.lit("{{a}} {{b}}"), {"a": F.lit("x")})).collect()


def test_limit_fails_instead_of_cutting(spark):
    assert metrics.enforce_limit(spark.range(3), 3, "rows").count() == 3
    with pytest.raises(SparkRuntimeException):
        metrics.enforce_limit(spark.range(4), 3, "rows").collect()


def test_containing_crosses_cells(spark):
    spans = spark.createDataFrame([(1, 0, 10_000, "A"), (1, 10_000, 10_010, "B"), (1, 9_000, 10_000, "C")], "doc int, f int, l int, c string")
    points = spark.createDataFrame([(1, 10, 20), (1, 9_500, 9_600), (1, 9_999, 10_001), (2, 1, 2)], "doc int, s int, e int")
    got = {(r["doc"], r["s"]): r["c"] for r in references.containing(points, spans, ["doc"], "s", "e", "f", "l", "c").collect()}
    assert got == {(1, 10): "A", (1, 9_500): None, (1, 9_999): None, (2, 1): None}


def test_copy_at_exactly_the_limit(spark):
    body = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(400))
    docs = spark.createDataFrame([(1, "?" * 100 + body[40:200] + "!" * 100), (2, "?" * 700 + body[1:80] + "!" * 100), (3, None), (4, "")], "d int, text string")
    got = windows.copy_pairs(docs, spark.createDataFrame([(9, body), (8, None)], "s int, text string"), "d", "s").collect()
    assert [(r["d"], r["s"]) for r in got] == [(1, 9)]


def test_copies_are_brute_force(spark):
    """Texts in several scripts, with forms that normalisation changes, against every window of every pair."""
    rng = random.Random(3)
    alphabet = "abc déß ﬁＡÉ 日本語\u3000\tΣς"
    make = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    sources = [(k, make(rng.randrange(50, 400))) for k in range(12)]
    docs = [(k, make(100) + sources[k % 12][1][k : k + rng.randrange(60, 300)].upper() + make(rng.randrange(0, 40_000))) for k in range(30)]
    norm = {("d", k): text.normalized(x) for k, x in docs} | {("s", k): text.normalized(x) for k, x in sources}
    want = {(d, s) for d, _ in docs for s, _ in sources if len(norm["d", d]) >= 80 and any(norm["s", s][p : p + 40] in norm["d", d] for p in range(0, len(norm["s", s]) - 39, 40))}
    got = windows.copy_pairs(spark.createDataFrame(docs, "d int, text string"), spark.createDataFrame(sources, "s int, text string"), "d", "s", limit=80).collect()
    assert len(want) > 10 and {(r["d"], r["s"]) for r in got} == want


def test_window_hashes():
    value = "añ日b" * 20_000
    h = rolling.window_hashes(value, 7)
    assert len(h) == len(value) - 6 and len(set(h.tolist())) == 4
    assert h[5] == rolling.window_hashes(value[5:12], 7)[0] and h[60_001] == rolling.window_hashes(value[60_001:60_008], 7)[0]
    assert len(rolling.window_hashes("abc", 7)) == 0


def test_bitmap(spark):
    places = [0, 1, 32_767, 32_768, (1 << 17) - 1]
    bits = rolling.bitmap(spark.createDataFrame([(p,) for p in places], "p long"), F.col("p"), 17)
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == places
    assert rolling.has_bits(bits, np.array([0, 2, 32_768])).tolist() == [True, False, True]


def test_deep_trees_have_no_cycles(spark):
    chain = [(k, k - 1 if k else None) for k in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2000), (3000, 9999)]
    got = references.cyclic(spark.createDataFrame(chain, "u int, up int"), "u", "up")
    assert sorted(r["u"] for r in got.collect()) == [2000, 2001, 2002, 2003]


def test_numbers_are_consecutive(spark):
    rows = spark.range(5000).selectExpr("id % 7 AS a", "id")
    got = sorted((r["n"], r["a"], r["id"]) for r in references.numbered(rows, ["a", "id"], "n", 9).collect())
    assert [x[0] for x in got] == list(range(1, 5001)) and [x[1:] for x in got] == sorted(x[1:] for x in got)


def test_needles_with_quotation_marks(spark):
    df = spark.createDataFrame([(r"a\Eb.c\Eb", r"\Eb"), ("x.y.z", ".")], "t string, w string")
    assert values(df.select(text.positions(F.col("t"), F.col("w")).alias("p")), "p") == [[1, 6], [1, 3]]


def test_headings_with_several_endings(spark):
    df = spark.createDataFrame([("One ##",), ("Two :tag:x: ##",), ("Three {#id}",), ("C# and &amp; {#a} :t: #",), ("Four # five",)], "t string")
    assert values(df.select(text.clean_heading(F.col("t")).alias("h")), "h") == ["One", "Two", "Three", "C# and &", "Four # five"]


def test_evidence_outside_the_text(spark):
    refs = spark.createDataFrame([(1, 0, 3, "x"), (1, 0, 99, "x"), (2, 0, 1, "x")], "doc int, char_start int, char_end int, span_sha256 string")
    got = [r["reason"] for r in catalog.verify_evidence(refs, spark.createDataFrame([(1, "abc")], "doc int, t string"), "doc", "t").orderBy("doc", "char_end").collect()]
    assert got == ["hash_mismatch", "out_of_bounds", "missing_source"]


def test_versions_compare_and_swap(spark, tmp_path):
    store = str(tmp_path / "store")
    plans.commit_version(spark.range(1), store, None, "a")
    with pytest.raises(RuntimeError):
        plans.commit_version(spark.range(2), store, None, "b")
    plans.commit_version(spark.range(2), store, "a", "b")
    (tmp_path / "store" / "LOCK").write_text("")
    with pytest.raises(FileExistsError):
        plans.commit_version(spark.range(3), store, "b", "c")
    assert plans.head(str(tmp_path / "none")) is None
    assert plans.head(store) == "b" and spark.read.parquet(f"{store}/v=b").count() == 2


def test_cycles_and_depth(spark):
    units = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4)], "u int, up int")
    assert sorted(r["u"] for r in references.cyclic(units, "u", "up").collect()) == [4, 5]


def test_grounded_pairs_are_brute_force(spark):
    texts = [(1, "an axis of ai, x.y z"), (2, "maintain"), (3, "人工知能だ"), (4, ""), (5, "état a.b"), (6, "the end of ai")]
    terms = ["ai", "axis of", "知能", "x.y", "état", "é", "of ai", "end o", "b"]
    docs = spark.createDataFrame(texts, "k int, t string")
    held = spark.createDataFrame([(x,) for x in terms], "w string")
    got = {(r["k"], r["w"]) for r in catalog.grounded_pairs(docs, "k", "t", held, "w").collect()}
    pairs = docs.crossJoin(held).where(text.grounded(F.col("t"), F.col("w")))
    assert got == {(r["k"], r["w"]) for r in pairs.collect()} and len(got) > 8


def test_grounded_pairs_of_odd_terms(spark):
    texts = [(1, "a" * 40 + " in, über-all x"), (2, "in,"), (3, None), (4, "über"), (4, "x in. 𝒳y"), (5, "𝒳"), (6, "pain, in.b" + " zz" * 9), (7, "r x"), (8, "y\n"), (9, "l’eau")]
    terms = ["a" * 40, "a" * 39, "in,", "in.", "ü", "übe", "𝒳", "𝒳y", "x", "zz zz", "r", "y\n", "l’eau", "", None]
    docs = spark.createDataFrame(texts, "k int, t string")
    held = spark.createDataFrame([(x, n) for n, x in enumerate(terms)], "w string, n int")
    got = sorted((r["k"], r["w"], r["n"]) for r in catalog.grounded_pairs(docs, "k", "t", held, "w").collect())
    pairs = docs.crossJoin(held).where(text.grounded(F.col("t"), F.col("w")))
    assert got == sorted((r["k"], r["w"], r["n"]) for r in pairs.collect()) and len(got) > 12


def test_grounded_terms_are_classes_and_members(spark):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["f04_grounded_terms"](spark, folder).toPandas()
    members, found = rows[rows["doc_id"].isna()], rows[rows["doc_id"].notna()]
    got = members.merge(found, on="class_id")
    term = F.lower(F.split(F.trim(F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1)), " ")[0])
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", term.alias("w")).where("length(w) > 0")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.lower("text").alias("t"))
    want = docs.crossJoin(pages.select("w").distinct()).where(text.grounded(F.col("t"), F.col("w"))).join(pages, "w").select("page_id", "doc_id")
    pairs = list(zip(got["page_id_x"].astype(int), got["doc_id_y"].astype(int), strict=True))
    assert len(members) == pages.count() and sorted(pairs) == sorted(map(tuple, want.collect()))


def test_titles_are_those_of_the_sql(spark, tmp_path):
    titles = ["a &amp; b&amp", "x &lt;y&gt", "C #", "a {#b}", "&amp;lt; &quot;q&quot; &#39;", "&nbsp;a &nbsp; b", "  two\t\nlines ", "", "&;&#;", "x :tag:"]
    rows = spark.createDataFrame([(k, f"<title>{x}</title>") for k, x in enumerate(titles)] + [(99, "none"), (100, None)], "page_id long, html string")
    rows.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = sorted(map(tuple, QUERIES["f05_clean_heading"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(SQL["f05_clean_heading"]).fetchall())
