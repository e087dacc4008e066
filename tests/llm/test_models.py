import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from foliant.llm import backoff, registry, resample, templates, toxicity


@pytest.mark.parametrize("order", [2, 3])
def test_backoff_is_brute_force(docs, odd_docs, order):
    rows = docs.select("doc_id", "text").where("doc_id < 60").union(odd_docs.selectExpr("doc_id + 1000 AS doc_id", "text").where("doc_id NOT IN (1001, 1005)")).cache()
    held = {r["doc_id"]: re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode().lower()) for r in rows.collect()}
    grams = {k: collections.Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) for k, w in held.items()}
    total = sum(grams.values(), collections.Counter())
    words = sum(map(len, held.values()))
    got = {r["doc_id"]: r for r in backoff.score(rows, order=order, block_bytes=20_000, partition_grams=2_000).collect()}
    for k, w in held.items():
        count = lambda g, k=k: total[g] - grams[k][g]
        rest, score = words - len(w), 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if count(g):
                    score += math.log(factor * count(g) / (count(g[:-1]) if n > 1 else rest))
                    break
                factor *= backoff.BACKOFF if n > 1 else 1
            else:
                score += math.log(factor * backoff.UNKNOWN / max(rest, 1))
        assert got[k]["n_words"] == len(w) and got[k]["log_score"] == pytest.approx(score, rel=1e-9, abs=1e-9)


def test_packed_sets_and_numbers():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 20), (1, 1), (1, 64), (2, 3), (900, 10), (1024, 10), (5000, 30), (5000, 53), (777, 64)):
        values = np.unique(np.concatenate([rng.integers(0, 1 << bits, 2 * n, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**64, 2 * n, dtype=np.uint64), np.arange(n, dtype=np.uint64) % np.uint64(1 << min(bits, 62))]))
        assert (backoff.unpack_set(backoff.pack_set(values, bits), bits) == values).all()
    for values in ([], [0], [255, 0], [256, 3], [2**63, 1, 2**64 - 1]):
        assert backoff.unpack(backoff.pack(np.array(values, dtype=np.uint64))).tolist() == values


def test_backoff_odd_rows(odd_docs, no_docs):
    got = backoff.score(odd_docs).collect()
    assert len(got) == 9 and [r["n_words"] for r in got if r["doc_id"] is None] == [6]
    assert backoff.score(no_docs).count() == 0


def naive_segments(scores):
    """All maximal segments by repeatedly taking the best one, left and right of it."""
    def best(a, b):
        found = max(((sum(scores[i:j]), -(j - i), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if found[0] <= 0:
            return []
        i, j = -found[2], found[3]
        return best(a, i) + [(i, j, found[0])] + best(j, b)

    return best(0, len(scores))


def test_maximal_segments():
    rng = np.random.default_rng(5)
    for _ in range(300):
        scores = (rng.integers(-6, 6, rng.integers(0, 14)) + rng.random() * 0.9).tolist()
        scores = [x + 1e-3 * rng.random() for x in scores]
        got, want = toxicity.maximal_segments(scores), naive_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


TOXIC_LABELS = "doc_id long, quality int, toxic int"


def toxic_docs(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(160):
        words = [f"w{'abcdefghij'[x % 10]}{'klmnop'[x // 10]}x" for x in rng.integers(0, 60, rng.integers(5, 60))]
        if k % 5 == 0:
            for at in rng.integers(0, len(words), 4):
                words[at] = rng.choice(["vilest", "vilely", "horrid"])
        rows.append((k, " ".join(words)))
    labels = [(k, 1, int(k % 5 == 0)) for k, _ in rows if k % 4]
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), labels


def test_log_odds_are_brute_force(spark):
    rows, docs, labels = toxic_docs(spark)
    counted = toxicity.feature_counts(toxicity.sample_of_labels(docs, spark.createDataFrame(labels, TOXIC_LABELS)))
    got = dict(zip(*(x.tolist() for x in toxicity.clear_features(counted)[0]), strict=True))
    assert [len(x) for x, _ in toxicity.clear_features(counted, (None, 0, 1))][0] == len(got)
    held = dict(rows)
    sums = collections.defaultdict(lambda: [0, 0, 0])
    for k, _, y in labels:
        if zlib.crc32(str(k).encode()) % 4 == 2:
            continue
        found = collections.Counter(f for row in toxicity.token_features([held[k].encode()])[0].tolist() for f in row if f)
        for f, n in found.items():
            sums[f][1 - y] += min(n, toxicity.MOST_A_TEXT)
            sums[f][2] += y
    n1, n0 = sum(x[0] for x in sums.values()), sum(x[1] for x in sums.values())
    want = {}
    for f, (t, o, texts) in sums.items():
        prior = toxicity.PRIOR_LEAST + toxicity.PRIOR_STRENGTH * (t + o) / (n1 + n0)
        a, b = t + prior, o + prior
        odds = math.log(a / (n1 + toxicity.PRIOR_STRENGTH - a)) - math.log(b / (n0 + toxicity.PRIOR_STRENGTH - b))
        error = math.sqrt(1 / a + 1 / b)
        if texts >= toxicity.LEAST_TEXTS and odds >= max(toxicity.LEAST_ODDS, toxicity.LEAST_Z * error) and odds - toxicity.BOUND * error >= toxicity.LEAST_SCORE:
            want[f] = odds - toxicity.BOUND * error
    assert len(want) > 2 and got == pytest.approx(want)


def test_scores_are_brute_force(spark):
    rows, docs, labels = toxic_docs(spark)
    frame = spark.createDataFrame(labels, TOXIC_LABELS)
    model = toxicity.train(docs, frame)
    odds = dict(zip(model.features.tolist(), model.odds.tolist(), strict=True))
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, frame).collect()}
    for k, text in [*rows]:
        tokens = toxicity.token_features([text.encode()])[0].tolist()
        scores = [max([odds[f] for f in row if f in odds], default=model.miss) for row in tokens]
        segments = naive_segments(scores)
        above = [model.scale * s - model.log_k - math.log(len(tokens)) for _, _, s in segments]
        evidence = min(math.log1p(math.exp(max(above))), toxicity.MOST_EVIDENCE) if above else 0.0
        assert got[k]["score"] == pytest.approx(1 / (1 + math.exp(-(model.slope * evidence + model.offset))))
        clear = [x for x, s in zip(segments, above, strict=True) if s > 0]
        assert [(s["first"], s["end"]) for s in got[k]["segments"]] == [x[:2] for x in clear]
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k in held if got[k]["predicted"]} == {k for k in held if k % 5 == 0}


def test_chance_scale_is_the_root():
    scores, counts = np.array([2.0, 3.0]), np.array([4.0, 1.0])
    x = toxicity.chance_scale(scores, counts, 1000.0, -0.1)
    assert x > 0.01 and (counts * np.exp(x * scores)).sum() + 1000 * math.exp(-0.1 * x) == pytest.approx(1005)


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_toxicity_on_held_out_rows(spark, size):
    folder = f"/root/testdata/{size}"
    got = registry.op4_toxic_segments(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert ((held["predicted"] == 1) & (held["toxic"] == 1)).sum() >= 0.9 * (held["toxic"] == 1).sum()
    assert ((held["predicted"] == 1) & (held["toxic"] == 0)).sum() <= 0.01 * (held["toxic"] == 0).sum()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (7, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    scored = toxicity.score_documents(odd_docs, labels).collect()
    assert len(scored) == 9 and all(r["score"] == min(x["score"] for x in scored) for r in scored if r["doc_id"] in (2, 3, 4))
    assert toxicity.score_documents(odd_docs, labels.limit(0)).where("score < 0.01").count() == 9
    assert toxicity.score_documents(no_docs, labels).count() == 0


def test_resampling_keeps_good_documents(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r["doc_id"] for r in registry.op9_importance_resampling(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good, bad = ({r["doc_id"] for r in labels if r["quality"] == q} for q in (1, 0))
    assert len(good & kept) >= 0.98 * len(good) and len(bad & kept) <= 0.1 * len(bad)


def test_resampling_is_brute_force(docs, spark):
    """Log weights, noise and the k largest keys, computed document by document."""
    held = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    labels = [(k, int(k % 3 > 0), 0) for k in sorted(held) if k % 2]
    each = {k: collections.Counter(resample.features([x])[0].tolist()) for k, x in held.items()}
    good = {k for k, q, _ in labels if q}
    raw, target = collections.Counter(range(resample.BUCKETS)), collections.Counter(range(resample.BUCKETS))
    for k, grams in each.items():
        raw.update(grams)
        target.update(grams if k in good else {})
    n_raw, n_target = sum(raw.values()), sum(target.values())
    weight = {k: sum(n * (math.log(target[g] / n_target) - math.log(raw[g] / n_raw)) for g, n in grams.items()) for k, grams in each.items()}
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {}
    for seed in (1, 2, 3):
        noise = {k: float(resample.gumbel(np.array([k]), seed)[0]) for k in held}
        got = {r["doc_id"]: r for r in resample.weigh(docs, frame, seed=seed).collect()}
        k = sum(r["beyond_cut"] for r in got.values())
        assert 0 < k < len(held)
        order = sorted((x for x in held if each[x]), key=lambda x: -(weight[x] + noise[x]))  # noqa: B023
        kept[seed] = {x for x, r in got.items() if r["kept"]}
        assert kept[seed] == set(order[:k])
        for x, r in got.items():
            assert r["log_weight"] == pytest.approx(weight[x], rel=1e-9, abs=1e-9) and r["key"] == pytest.approx(weight[x] + noise[x], rel=1e-9, abs=1e-9)
    assert len({frozenset(x) for x in kept.values()}) > 1  # another seed keeps other documents


def test_noise_is_gumbel():
    x = resample.gumbel(np.arange(200_000))
    assert x.mean() == pytest.approx(0.5772, abs=0.01) and x.var() == pytest.approx(math.pi**2 / 6, abs=0.03)


def test_resampling_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = resample.weigh(odd_docs, labels)
    assert rows.count() == 9 and rows.where("kept AND n_grams = 0").count() == 0
    assert resample.keep(odd_docs, labels).columns == odd_docs.columns
    assert resample.keep(odd_docs, labels).where("doc_id IS NULL").count() == 1
    assert resample.weigh(no_docs, labels).count() == 0
    assert {r["kept"] for r in resample.weigh(odd_docs, labels.limit(0)).where("n_grams > 0").collect()} == {True}


def test_kth_largest(spark):
    keys = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 9, 7, 7, 3]], "key double")
    for k, want in ((1, 9), (2, 7), (4, 5), (7, 1)):
        least = resample._kth_largest(keys, k)
        assert keys.where(keys["key"] >= least).count() == sum(x >= want for x in [5, 1, 1, 9, 7, 7, 3])


ITEMS = [(9, "So Bob buys 10 apples and 20 pears at the small market near Berlin today."), (10, "So Bob buys 1 apples and 2 pears at the small market near Bob today."), (11, "tiny"), (12, None), (13, "quick brown foxes jumping")]


def test_templates(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    docs = [
        (1, "Pad. So Bob buys 10 apples and 20 pears at the small market near Berlin today."),
        (2, "Then Ann buys 3,000 apples and 5 pears at the small market near Rome today."),
        (3, "We saw Ann buys 30 apples and 5 pears at the small market near Ann today."),
        (4, None),
        (5, "the quick brown foxes jumping high"),
        (6, "So Bob sells apples, 10 of them, and has 20 pears. At the market."),
    ]
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in templates.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 9): "verbatim", (2, 9): "re-parameterised", (3, 10): "re-parameterised", (5, 13): "verbatim"}
    assert templates.decontaminate(odd_docs, items).count() == 9
    assert templates.leaks(no_docs, items).count() == 0
    assert templates.leaks(odd_docs, items.limit(0)).count() == 0


def kinds(spark, item, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["kind"] for r in templates.leaks(rows, spark.createDataFrame([(1, item)], "item_id int, text string")).collect()}
    return [found.get(k) for k in range(len(texts))]


def test_numbers_as_words_units_and_slots(spark):
    item = "So Bob buys 12 apples and 5 pears at the small market near the old Berlin station today."
    as_words = "So Ann buys ten apples and twenty five pears at the small market near the old Rome station today."
    unit = "So Ann buys 10 kg apples and 7 pears at the small market near the old Rome station today."
    equal = "So Ann buys 4 apples and 4 pears at the small market near the old Rome station today."
    clash = "So Ann buys 5 apples and 5 pears at the small market near the old Rome station today."  # 12 became 5, 5 stayed
    one_name = "So Ann buys 4 apples and 3 pears at the small market near the old Ann station today."
    assert kinds(spark, item, item, as_words, unit, equal) == ["verbatim", *["re-parameterised"] * 3]
    assert kinds(spark, item, clash, one_name) == [None, None]


def test_recall_of_re_parameterised_items(spark):
    """Items with numbers and names put in, planted with others in their place among the documents."""
    rng = random.Random(6)
    folder = "/root/testdata/sf0.01"
    names = ["Bob", "Ann", "Tom Hill", "Mary", "Oskar", "Lea Maria", "Paul"]

    def filled(words, slots):
        out, k = [], 0
        for at, w in enumerate(words):
            out.append(w)
            if at % 7 == 3 and not w.endswith("."):
                out.append(slots[k])
                k += 1
        return " ".join(out)

    items, planted = [], []
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        words = r["text"].split()
        of_kind = [rng.random() < 0.6 for _ in words]
        first = [str(rng.randrange(2, 900)) if x else rng.choice(names) for x in of_kind]
        renamed = dict(zip(names, rng.sample(["Ida", "Emil Braun", "Jo", "Karl", "Rosa Luise", "Max", "Nele"], len(names)), strict=True))
        renumbered = {x: rng.choice([str(rng.randrange(1000, 9000)), f"{rng.randrange(2, 90)}.5", f"{rng.randrange(1001, 1999)} kg"]) for x in first}
        items.append((r["item_id"], filled(words, first)))
        planted.append((r["item_id"], filled(words, [renumbered[x] if x.isdigit() else renamed[x] for x in first])))
    docs = [r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").limit(400).collect()]
    rows = [(k, x) for k, x in enumerate(docs)]
    for item_id, text in planted:
        k = rng.randrange(len(docs))
        rows.append((10_000 + item_id, docs[k][: len(docs[k]) // 2] + " " + text + " " + docs[k][len(docs[k]) // 2 :]))
    got = {(r["doc_id"], r["item_id"]) for r in templates.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(10_000 + k, k) for k, _ in planted}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_templates_find_every_embedded_item(spark):
    folder = "/root/testdata/sf0.01"
    norm = lambda x: " ".join(re.findall(r"\w+", x.lower()))
    items = {r["item_id"]: norm(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()}
    want = {(r["doc_id"], k) for r in spark.read.parquet(f"{folder}/documents.parquet").collect() for k, x in items.items() if x in norm(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in registry.op2_template_decontamination(spark, folder).collect()}
    assert want == got


def test_query_looks_beyond_bigrams(spark, docs):
    known = {r["doc_id"]: r["log_score"] for r in backoff.score(docs, order=3).collect()}
    got = {r["doc_id"]: r["log_score"] for r in registry.op3_stupid_backoff(spark, "/root/testdata/sf0.001").collect()}
    assert got == pytest.approx(known)
    assert got != pytest.approx({r["doc_id"]: r["log_score"] for r in backoff.score(docs, order=2).collect()})
