import random
import re

import numpy as np

import corpus_pipeline
from foliant.llm import common, copies, simhash


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def brute_first(rows):
    """The smallest doc_id of each component of pairs at 0.8 or more."""
    sets = {k: shingles(x) for k, x in rows}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = a, b
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                root[max(x, y)] = min(x, y)
    return {k for k in root if root[k] == k}


def altered(words, places, rng):
    out = list(words)
    for k in places:
        out[k] = f"new{rng.random()}"
    return " ".join(out)


def near_rows():
    """Copies altered in a few words, chains of them, a passage that all share, and short texts."""
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(1, ""), (2, " \n"), (3, "One two"), (4, "one  two"), (5, "one two three")]
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(60, 200))] + (passage.split() if base % 2 else [])
        for copy in range(6):
            rows.append((100 + base * 10 + copy, altered(words, rng.sample(range(len(words)), copy), rng)))
            words = rows[-1][1].split() if base % 3 == 0 else words
    return rows


def test_near_copies_are_brute_force(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_first(rows)
    assert {r["doc_id"] for r in copies.first_copies(docs).collect()} == want
    monkeypatch.setattr(copies, "SAMPLE_COUNT", 10**6)  # no frequent shingles: another order, the same pairs
    monkeypatch.setattr(copies, "BLOCK_SETS", 3)  # buckets in blocks
    monkeypatch.setattr(common, "HOT_SHARE", 400)
    assert {r["doc_id"] for r in copies.first_copies(docs).collect()} == want


def test_links_between_components():
    rng = np.random.default_rng(8)
    for _ in range(40):
        pool = rng.integers(0, 2**63, 14, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool, rng.integers(1, 14))) for _ in range(rng.integers(1, 25))]
        roots = np.unique(rng.integers(0, 12, len(sets)), return_inverse=True)[1]
        label = roots.copy()
        while True:
            before = label.copy()
            for i, x in enumerate(sets):
                for j, y in enumerate(sets):
                    both = len(np.intersect1d(x, y))
                    if roots[i] != roots[j] and 5 * both >= 4 * (len(x) + len(y) - both):
                        label[(roots == roots[i]) | (roots == roots[j])] = min(label[i], label[j])
            if (label == before).all():
                break
        assert copies.links_between(sets, roots).tolist() == label.tolist()


def test_sketches_leave_all_that_may_link():
    rng = np.random.default_rng(9)
    for _ in range(30):
        pool = rng.integers(0, 2**63, 90, dtype=np.uint64)
        sets = [np.unique(rng.choice(pool[: rng.integers(2, 90)], rng.integers(1, 80))) for _ in range(20)]
        sketches, sizes = [copies.sketch(x) for x in sets], np.array([len(x) for x in sets])
        roots = rng.integers(0, 6, len(sets))
        want = [any(roots[i] != roots[j] and copies.may_be_similar(sketches[i], sketches[j], sizes[i], sizes[j]) and 5 * min(sizes[i], sizes[j]) >= 4 * max(sizes[i], sizes[j]) for j in range(len(sets))) for i in range(len(sets))]
        assert copies.may_link(sketches, sizes, roots).tolist() == want


def test_spread_join(spark):
    rows = spark.createDataFrame([(k, 7 if k % 2 else k) for k in range(4000)] + [(9999, None)], "id long, k long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 4000, 3)] + [(7, "seven")], "k long, v string")
    assert common.hot_keys(rows, "k") == [7] and common.hot_keys(rows.limit(0), "k") == []
    for how in ("inner", "left_semi"):
        want = sorted(map(str, rows.join(table, "k", how).collect()))
        got = common.spread_join(rows, table, "k", how=how)
        assert sorted(map(str, got.select(rows.join(table, "k", how).columns).collect())) == want and len(want) > 2000


def test_stage_drops_copies_beyond_the_radius(spark):
    import corpus_pipeline

    rng = random.Random(9)
    words = [f"w{k}" for k in range(120)]
    rows = [(1, " ".join(words)), (2, altered(words, [20, 80], rng)), (3, altered(words, range(0, 120, 10), rng))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (int(simhash.fingerprints_of([x.encode()])[0]) for _, x in rows[:2])
    assert (a ^ b).bit_count() > simhash.RADIUS
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()) == [1, 3]


def test_odd_rows(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs, copies.first_copies(odd_docs))
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 6]
    assert copies.first_copies(no_docs).count() == 0


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(2)
    for n, m, both in ((1, 1, 1), (40, 50, 40), (900, 1000, 850), (1000, 1020, 1000), (70, 60, 0)):
        pool = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        x, y = pool[:n], np.concatenate([pool[:both], pool[n : n + m - both]])
        fits = copies.may_be_similar(copies.sketch(x), copies.sketch(y), n, m)
        assert fits or 5 * both < 4 * (n + m - both)
    assert not fits


def test_the_stage_follows_fingerprints_and_similar_sets(spark):
    # 1 and 2 have one fingerprint and few shingles in common; 2 and 3 have similar sets, as have 3 and 4; 5 is alone.
    said = "the quick brown fox jumps over a lazy dog while it rains hard " * 60
    tail = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    once = said.split()[:13]
    texts = [said + tail("a", 30), said + tail("b", 30), " ".join(once) + " " + tail("b", 30), " ".join(once[2:]) + " " + tail("b", 30), tail("z", 40)]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts, 1)], "doc_id long, text string")
    fps = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert fps[2] == 1
    assert {r["doc_id"] for r in copies.first_copies(docs).collect()} == {1, 2, 5}
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 5]


def test_near_copies_by_rounds_are_brute_force(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "TASK_EDGES", -1)  # as for tables of any size
    monkeypatch.setattr(copies, "FEW_ROWS", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 400)
    assert {r["doc_id"] for r in copies.first_copies(docs, simhash.near_duplicates(docs, 8)).collect()} == brute_first(rows)


def test_the_stage_takes_few_jobs_on_few_rows(spark):
    # Each job leaves threads and memory in the driver; on small tables many follow each other in seconds.
    docs = spark.createDataFrame(near_rows(), "doc_id long, text string")
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    assert corpus_pipeline.simhash_near_dedup(spark, docs, "").count() == len(brute_first(near_rows()))
    assert jobs() - before <= 110
