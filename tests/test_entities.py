"""Names, terms, acronyms and addresses: what is meant and what only looks so."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import entities as en
from foliant.functions import text as tx
from foliant.operators import candidates, entities
from foliant.registry import QUERIES

BOOK = (
    "Ada Lovelace described the engine. Ada Lovelace walked. In New York nobody wrote. Machine Learning Alan Turing proposed a test. "
    "The AGI debate: AGI, WAGIX and HTTP, XIV, U.S.A. INTELLIGENCE. See https://Example.org/a/b?x=1. and 10.1234/AbC.5).\n"
    "「計算 模型」とは何か。山田太郎によると。本社会氏は。アラン・チューリングは「機械」を論じた。システムモデルは述べた。人工知能とは。"
)


def test_stop_lists_and_shapes(spark):
    row = spark.createDataFrame([(BOOK,)], "t string").select(en.english_names(F.col("t")).alias("n"), en.acronyms(F.col("t")).alias("a")).first()
    assert row["n"] == ["Ada Lovelace", "Ada Lovelace", "In New York", "Alan Turing"]
    assert row["a"] == ["AGI", "AGI", "WAGIX"]


@pytest.mark.parametrize(
    ("label", "after", "kanji", "plain", "vertical"),
    [
        ("山田太郎", "氏は述べた", True, True, True),
        ("山田", "氏は", True, False, True),
        ("山田太郎", "によれば", True, True, False),
        ("人工知能", "氏", True, False, False),
        ("各大臣", "氏", True, False, False),
        ("東京大学", "教授", True, True, False),
        ("チューリング", "は後に理論を提唱した", False, True, False),
        ("アラン・チューリング", "は後に理論を提唱した", False, True, True),
        ("アラン・チューリング", "は来た。彼は提唱した", False, True, False),
        ("エージェント", "は提唱した", False, False, False),
        ("チューリング", "の理論", False, True, False),
        ("チューリング", "博士", False, True, True),
        ("チューリング", "が走る", False, False, False),
    ],
)
def test_japanese_people(spark, label, after, kanji, plain, vertical):
    row = spark.createDataFrame([(label, after)], "l string, a string")
    got = row.select(en.japanese_person(F.col("l"), F.col("a"), kanji).alias("p"), en.japanese_person(F.col("l"), F.col("a"), kanji, True).alias("v")).first()
    assert (got["p"], got["v"]) == (plain, vertical)


def test_latin_people(spark):
    cases = [(" proposed a test", True), (" walked", False), ("は理論を論じた", True), ("は。", False), (" claims it", True), (" foundations", False)]
    rows = spark.createDataFrame(cases, "a string, w boolean")
    assert [r["g"] for r in rows.select(en.latin_person(F.col("a")).alias("g")).collect()] == [w for _, w in cases]


def test_labels_of_vertical_print(spark):
    rows = spark.createDataFrame([("計算模型",), ("意識の理論",), ("これは文である。",), ("x",), ("ひらがな",), ("自由エネルギー",)], "l string")
    got = rows.select(en.quoted_term_label(F.col("l")).alias("q"), en.defined_term_label(F.col("l")).alias("d")).collect()
    assert [(r["q"], r["d"]) for r in got] == [(True, True), (True, False), (False, False), (False, False), (False, False), (True, True)]


def test_character_classes(spark):
    rows = spark.createDataFrame([("あ",), ("ア",), ("漢",), ("a",), ("ab",), ("12",), ("x1",), ("ーー",)], "c string")
    got = rows.select(en.is_japanese(F.col("c")).alias("j"), en.is_kana(F.col("c")).alias("k"), en.is_kana(F.col("c"), True).alias("h"), en.is_horizontal(F.col("c")).alias("x")).collect()
    assert ["".join("jkhx"[k] for k, v in enumerate(r) if v) for r in got] == ["jkh", "jk", "j", "", "x", "", "x", ""]


def test_glyphs_are_joined_by_page(spark):
    page = "人\n工\n \nAI\nlab\n2\n知\f\n能\nｶ\n"
    row = spark.createDataFrame([(page,), (None,)], "t string").select(en.joined_glyphs("t").alias("j")).collect()
    assert [r["j"] for r in row] == ["人工AI lab2知\n能カ", None]


def test_terms_as_words_of_their_own(spark):
    rows = spark.createDataFrame([("ai maid ai, xai ai2 ai", "ai"), ("人工知能と知能", "知能"), ("aaa", "aa")], "t string, w string")
    assert [r["p"] for r in rows.select(en.bounded_positions(F.col("t"), F.col("w")).alias("p")).collect()] == [[0, 8, 20], [2, 5], []]


def test_mentions_and_items(spark):
    texts = spark.createDataFrame([(1, BOOK), (2, None), (3, "")], "doc int, t string")
    norm = tx.normalized(BOOK)
    found = entities.mentions(texts, "doc", "t")
    rows = found.collect()
    assert {r["doc"] for r in rows} == {1}
    got = {}
    for r in rows:
        got.setdefault((r["kind"], r["label"]), []).append(norm[r["char_start"] : r["char_end"]])
    assert got == {
        ("person", "Ada Lovelace"): ["ada lovelace"],
        ("person", "Alan Turing"): ["alan turing"],
        ("person", "山田太郎"): ["山田太郎"],
        ("person", "アラン・チューリング"): ["アラン・チューリング"],
        ("term", "計算 模型"): ["計算 模型"],
        ("term", "人工知能"): ["人工知能"],
        ("term", "AGI"): ["agi", "agi"],
        ("term", "WAGIX"): ["wagix"],
        ("reference", "Example.org/a/b"): ["https://example.org/a/b?x=1"],
        ("reference", "DOI 10.1234/AbC.5"): ["10.1234/abc.5"],
    }
    spans = spark.createDataFrame([(1, 0, 150, "CH-01"), (1, 150, len(norm), "CH-02")], "doc int, char_first int, char_last int, chapter_id string")
    listed = entities.items(found, spans).orderBy("place").collect()
    assert [r["kind"] for r in listed] == sorted([r["kind"] for r in listed], key=entities.KINDS.index)
    assert {(r["label"], r["chapter_id"], r["n_places"]) for r in listed} >= {("Ada Lovelace", "CH-01", 1), ("AGI", "CH-01", 2), ("人工知能", "CH-02", 1), ("DOI 10.1234/AbC.5", "", 1)}
    assert len({r["item_id"] for r in listed}) == len(listed)
    targets = entities.context_targets(entities.items(found, spans), 3).orderBy("target").collect()
    assert [r["target"] for r in targets] == [1, 2, 3] and all(r["kind"] == "person" for r in targets)


def test_texts_are_read_once_and_stay_in_their_task(spark, tmp_path):
    # Rows that were made of labels took their texts' views along to Python workers, and each kind read the texts anew.
    spark.createDataFrame([(1, BOOK)], "doc int, t string").write.parquet(str(tmp_path / "t"))
    plan = entities.mentions(spark.read.parquet(str(tmp_path / "t")), "doc", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Generate" not in plan and "ArrowEvalPython" not in plan


def test_places_of_labels_in_odd_texts(spark):
    odd = "Ａｄａ Ｌｏｖｅｌａｃｅ argued. x Ada  Lovelace wrote AI AI2 A I U S A. Alan Turing arguedé. ſee HTTPS://Ex.org/ſ). A B C「 計 算 」とは。ＡＩとは何か「x y」と呼ばれる。XAI AI"
    rows = entities.mentions(spark.createDataFrame([(1, odd), (2, " \n")], "doc int, t string"), "doc", "t").collect()
    norm = tx.normalized(odd)
    assert {(r["label"], norm[r["char_start"] : r["char_end"]]) for r in rows} >= {("Ada Lovelace", "ada lovelace"), ("計算", "計 算"), ("AI", "ai"), ("Ex.org/s", "https://ex.org/s")}
    compact = tx.compacted(norm)[0]
    assert sum(r["label"] == "AI" and r["reason"] == "uppercase_acronym_shape" for r in rows) == len(spark.createDataFrame([(compact,)], "t string").select(F.explode(en.bounded_positions(F.col("t"), F.lit("ai")))).collect())


ODD = "Ａｄａ Ｌｏｖｅｌａｃｅ argued. x Ada  Lovelace wrote AI AI2 A I U S A. Alan Turing arguedé. ſee HTTPS://Ex.org/ſ). A B C「 計 算 」とは。ＡＩとは何か「x y」と呼ばれる。XAI AI"


def _whole(spark, tmp_path, query):
    """What a query makes of BOOK, ODD, a text without a key and texts of nothing, and its plan."""
    rows = [(1, BOOK), (2, ODD), (3, None), (4, " \n"), (None, "Ada Lovelace wrote of AI.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return QUERIES[query](spark, str(tmp_path))


def _by_spans(spark, tmp_path):
    texts = spark.read.parquet(str(tmp_path / "documents.parquet"))
    spans = texts.select(F.col("doc_id").alias("doc"), F.lit(0).alias("char_first"), F.length(tx.normalize_text("text")).alias("char_last"), F.lit("CH-01").alias("chapter_id"))
    return entities.items(entities.mentions(texts, "doc_id", "text"), spans)


def test_context_targets_read_texts_once(spark, tmp_path):
    # Texts were normalised again for their lengths, and all mentions joined with them, dealt out four times and sorted before any was summed up.
    got = _whole(spark, tmp_path, "t05_context_targets")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Join" not in plan and "ArrowEvalPython" not in plan
    want = entities.context_targets(_by_spans(spark, tmp_path)).select("doc", "target", "kind", "label")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 9


def test_candidates_are_summed_up_where_mentions_are_found(spark, tmp_path):
    # All mentions were joined with their documents and windowed before any was summed up.
    got = _whole(spark, tmp_path, "m12_catalog_candidates")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and plan.count("Aggregate [") == 1 and not {x for x in ("Join", "Window", "ArrowEvalPython") if x in plan}
    want = candidates.from_catalog(_by_spans(spark, tmp_path), "run").select("doc", "candidate_id", "collection", "state", F.array_join("reasons", ","))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert {(r["doc"] is None, r["state"]) for r in got.collect()} == {(False, "ready"), (True, "quarantined")}


def test_places_of_a_label_go_together_into_a_catalogue(spark):
    # Each place was a row with the 80 characters behind it, of use or not, that was sorted in its task before it was summed up.
    texts = spark.createDataFrame([(1, BOOK), (2, ODD), (3, None), (4, "AI " * 300 + "Ａi AI")], "doc int, t string")
    by_place, summed = (entities.mentions(texts, "doc", "t", summed=x).withColumn("chapter_id", F.lit("CH-01")) for x in (False, True))
    assert sorted(map(str, entities.items(by_place).collect())) == sorted(map(str, entities.items(summed).collect()))
    rows = [r for r in summed.collect() if r["label"] == "AI" and r["doc"] == 4]
    assert [(r["char_start"], r["char_end"], r["starts"]) for r in rows] == [(0, 599, list(range(0, 600, 3)))]
    assert sum(len(r["starts"]) for r in summed.collect()) == by_place.count() > summed.count() + 199
    with pytest.raises(ValueError):
        entities.items(summed, spark.createDataFrame([(1, 0, 9, "CH-01")], "doc int, char_first int, char_last int, chapter_id string"))


@pytest.mark.parametrize("query", ["m12_catalog_candidates", "t05_context_targets"])
def test_catalogues_map_no_case_in_executors(spark, tmp_path, query):
    # The first upper() of an executor made some gigabytes of garbage, just when results were written.
    plan = _whole(spark, tmp_path, query)._jdf.queryExecution().optimizedPlan().toString()
    assert "upper(" not in plan and "lower(" not in plan


def test_ids_are_digits_in_capitals(spark):
    rows = [(1, "term", "AGI", "", 5, 8, "low", "uppercase_acronym_shape", "CH-01"), (1, "reference", "DOI 10.1/A", "https://doi.org/10.1/a", 9, 13, "high", "explicit_doi", None)]
    items = entities.items(spark.createDataFrame(rows, "doc int, kind string, label string, url string, char_start long, char_end long, confidence string, reason string, chapter_id string"))
    got = {r["collection"]: (r["candidate_id"], r["record_id"]) for r in candidates.from_catalog(items, "run").collect()}
    digits = lambda *x: hashlib.sha256("\0".join(x).encode()).hexdigest().upper()
    for name, own in (("glossary", ("term", "agi", "CH-01", "")), ("references", ("reference", "https://doi.org/10.1/a", "", "https://doi.org/10.1/a"))):
        item = f"CI-{digits(*own)[:20]}"
        assert got[name] == (f"CA-{digits('run', '1', item)[:20]}", f"{name[:3].upper()}-{digits(item)[:12]}")


def test_spellings_at_one_place_are_ordered(spark):
    # The label of an item was that of whichever row came first.
    rows = [(1, "reference", x, f"https://{x}", 5, 16, "high", "explicit_http_url") for x in ("ex.org/A", "ex.org/a")]
    spans = spark.createDataFrame([(1, 0, 99, "CH-01")], "doc int, char_first int, char_last int, chapter_id string")
    kinds = "doc int, kind string, label string, url string, char_start long, char_end long, confidence string, reason string"
    got = [entities.items(spark.createDataFrame(x, kinds).coalesce(1), spans).collect() for x in (rows, rows[::-1])]
    assert got[0] == got[1] and [r["label"] for r in got[0]] == ["ex.org/A"]


#: More places than an inventory takes of a label, and than a batch holds; who is meant is said behind the last ones alone.
MANY = "AI " * 9000 + "Ada Lovelace walked. " * 230 + "Ada Lovelace argued. " * 3 + "See https://Ex.org/a " * 260 + "and 10.1234/AbC.5 " * 270 + "「計算モデル」とは。" + "計算モデルと、" * 240


def test_mentions_are_all_there(spark, tmp_path):
    # Latin names, acronyms and addresses ended at a label's 200th place, whether it was meant or not, quoted and defined terms at their first.
    spark.createDataFrame([(1, BOOK), (2, MANY), (3, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, "<p>" + MANY)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {}
    for r in QUERIES["f12_mentions"](spark, str(tmp_path)).where("doc <> 'd1'").collect():
        got.setdefault((r["doc"], r["kind"], r["label"], r["reason"]), []).append((r["char_start"], r["char_end"]))
    looked_for = {
        ("person", "Ada Lovelace", "latin_multi_token_name_shape"): "ada lovelace(?= argued)",
        ("term", "AI", "uppercase_acronym_shape"): "(?<![a-z0-9])ai(?![a-z0-9])",
        ("term", "計算モデル", "quoted_definition_shape"): "計算モデル",
        ("reference", "Ex.org/a", "explicit_http_url"): "https://ex.org/a",
        ("reference", "DOI 10.1234/AbC.5", "explicit_doi"): "10.1234/abc.5",
    }
    texts = {"d2": tx.normalized(MANY), "p2": tx.normalized("<p>" + MANY)}
    want = {(doc, *k): [m.span() for m in re.finditer(x, norm)] for doc, norm in texts.items() for k, x in looked_for.items()}
    assert {k: sorted(x) for k, x in got.items()} == want and [len(x) for x in want.values()][:5] == [3, 9000, 241, 260, 270]


def test_catalogues_count_all_places(spark, tmp_path):
    # Names and acronyms were counted up to their 200th place and defined terms up to their first, which gave the order; who was meant behind a 200th place alone was no item.
    text = MANY + "AAA " * 201 + "ZZZ " * 205 + "Alan Turing wrote. " * 210 + "Jane Austen wrote. " * 220
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    # Jane Austen 220, Alan Turing 210, Ada Lovelace 3; AI 9000, 計算モデル 241, ZZZ 205, AAA 201.
    targets = QUERIES["t05_context_targets"](spark, str(tmp_path)).orderBy("target").collect()
    assert [(r["target"], r["label"]) for r in targets] == list(enumerate(["Jane Austen", "Alan Turing", "Ada Lovelace", "AI", "計算モデル", "ZZZ", "AAA"], 1))
    got = QUERIES["m12_catalog_candidates"](spark, str(tmp_path)).groupBy("collection").count().collect()
    assert {r["collection"]: r["count"] for r in got} == {"names": 3, "glossary": 4, "references": 2}
    summed = entities.mentions(spark.read.parquet(str(tmp_path / "documents.parquet")), "doc_id", "text", summed=True, most=None).withColumn("chapter_id", F.lit("CH-01"))
    sizes = {most: {r["label"]: (r["n_places"], len(r["places"])) for r in entities.items(summed, most=most).collect()} for most in (None, 7)}
    assert (sizes[None]["AI"], sizes[7]["AI"], sizes[None]["Ex.org/a"], sizes[7]["Ada Lovelace"]) == ((9000, 9000), (9000, 7), (260, 260), (3, 3))


def test_batches_hold_so_many_places():
    rows = [("x", None)] * 20000 + [("y", list(range(10000))), ("z", [1])]
    parts = list(entities._batches(rows))
    assert [x for part in parts for x in part] == rows and [len(x) for x in parts] == [8192, 8192, 3617, 1] and not list(entities._batches([]))


def test_compact_texts_are_those_of_any_white_space():
    for text in (BOOK, ODD, "A B C d ef g h", "x", "", "a - b . c 計 算 z", "は U S A が"):
        flat = tx.normalized(text)
        compact, offsets = entities._compact(flat)
        want, places = tx.compacted(flat)
        assert compact == want and (list(range(len(flat))) if offsets is None else offsets.tolist()) == places.tolist()
