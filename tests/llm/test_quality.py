import collections
import re

from pyspark.sql import functions as F

from foliant.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = collections.Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_measures_are_brute_force(spark, docs, odd_docs):
    extra = spark.createDataFrame([(900, "a b c a b c a b c"), (901, "a a a a"), (902, "x y z q x y z"), (903, "#|\n#|\nq")], "doc_id long, text string").selectExpr("doc_id", "text", "'k' AS source")
    rows = docs.select("doc_id", "text", "source").union(odd_docs.select("doc_id", "text", "source")).union(extra)
    want = collections.Counter((r["doc_id"], *brute(r["text"])) for r in rows.collect())
    got = quality.measures(rows).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want


def test_windows_whose_hashes_collide(spark, docs):
    # Sixteen hashes for all windows: most texts have different windows with the same one.
    rows = docs.select("text").limit(60).collect() + [("a b c a b c d e f a b c",), ("x y",), ("q q q q q",)]
    held = spark.createDataFrame([(r[0] or "",) for r in rows], "t string")
    got = held.select("t", F.expr(quality.repeated_words_sql("array_remove(split(t, '[ \t\n]+'), '')", place_bits=60)).alias("n")).collect()
    assert all(r["n"] == brute(r["t"])[4] for r in got)


def test_texts_of_over_a_million_words(spark):
    import random

    rng = random.Random(2)
    words = [f"v{rng.randrange(60)}" for _ in range(700_000)] + [f"u{k}" for k in range(400_000)]
    text = " ".join(words)
    got = quality.measures(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert got["n_words"] == 1_100_000 and got["n_repeat_words"] == brute(text)[4]


def test_bad_hosts_take_their_documents_along(spark):
    good, junk = " ".join(f"word{k}" for k in range(80)), "### " * 60
    rows = [(k, good if k < 50 or k % 20 == 0 else junk, "ok" if k < 50 else "bad") for k in range(100)] + [(200, good, "new")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k]["kept"] for k in range(50))
    assert not any(got[k]["kept"] for k in range(50, 100)) and got[60]["host_rejected"] and not got[60]["base_failed"]
    assert got[200]["kept"]  # one document says little about its host


def test_salted_join_gives_the_same(odd_docs, monkeypatch):
    key = lambda rows: sorted(map(str, rows.collect()))
    want = key(quality.judge(odd_docs, host_limit=0.1))
    monkeypatch.setattr(quality, "BROADCAST_HOSTS", -1)
    assert key(quality.judge(odd_docs, host_limit=0.1)) == want and len(want) == 9


def test_empty(no_docs):
    assert quality.judge(no_docs).count() == 0
