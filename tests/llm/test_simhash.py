import re

import numpy as np
import pytest
import xxhash

from foliant.llm import simhash


def brute_fp(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    s = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum((2 * sum(h >> b & 1 for h in s) > len(s)) << b for b in range(64))


def brute_roots(values):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 2):
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(values))]


def test_bucket_is_brute_force():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    flips = [b ^ np.uint64(1 << int(x)) ^ np.uint64(1 << int(y)) for b in base[:20] for x, y in rng.integers(0, 64, (8, 2))]
    three = [b ^ np.uint64(0b111 << 20) for b in base[20:30]]
    values = np.unique(np.concatenate([base, np.array(flips, dtype=np.uint64), np.array(three, dtype=np.uint64)]))
    assert simhash.bucket_roots(values).tolist() == brute_roots(values)


@pytest.mark.parametrize("bucket_rows", [simhash.BUCKET_ROWS, 2])
def test_components_are_brute_force(docs, odd_docs, bucket_rows):
    rows = docs.select("doc_id", "text").union(odd_docs.selectExpr("doc_id + 1000 AS doc_id", "text").where("doc_id IS NOT NULL"))
    held = rows.collect()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(rows, bucket_rows).collect()}
    fp = {r["doc_id"]: brute_fp(r["text"]) for r in held}
    assert all(int(got[k]["fingerprint"], 16) == v for k, v in fp.items())
    ids = sorted(fp)
    roots = brute_roots(np.array([fp[k] for k in ids], dtype=np.uint64))
    assert all(got[k]["component_id"] == ids[r] for k, r in zip(ids, roots, strict=True))


def test_keep_one_of_each(odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 5, 6]
    assert simhash.near_duplicates(odd_docs).count() == 9
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("task_edges", [simhash.TASK_EDGES, -1])
def test_components_of_edges(spark, monkeypatch, task_edges):
    monkeypatch.setattr(simhash, "TASK_EDGES", task_edges)
    rng = np.random.default_rng(6)
    chain = [(k + 1, k) for k in range(-40, 0)]
    edges = [*chain, (5, 5), *((1000, 1001 + k) for k in range(50)), *((2000 + int(a), 2000 + int(b)) for a, b in rng.integers(0, 90, (60, 2)))]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == root and len(got) == len(root)
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
