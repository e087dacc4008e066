"""Quality classifier by importance resampling (operator 9).

Two generative models of hashed n-grams: one of target text (documents
labelled of good quality), one of the raw corpus (every document). A document's
log weight is the sum of log target - log raw over its n-grams. An n-gram is a
token (run of letters, digits or other marks, lower-cased) or a pair of
neighbouring shapes: a mark is its own shape, letters have their case, and a
token that equals the one before has the shape "again".

Documents are sampled without replacement by Gumbel top-k: to each log weight
standard Gumbel noise (fixed by seed and doc_id) is added, and the k largest
stay, which draws k documents in proportion to their weights. k is a share of the
corpus: as many documents as lie beyond the cut on the log weight per n-gram that
tells the labelled rows of either class apart best (column ``beyond_cut``;
whether a document lies there doesn't decide about it). The k-th largest is
found by counting in bins that are refined, so neither keys nor documents are
collected.

Bounds: the target model and the boundary are fitted to at most
``TRAIN_ROWS`` labelled documents a class (a documented parameter; the first by
hash of doc_id); the raw model counts the whole corpus, and every document is
scored on its whole text.

Defined results: null and empty texts have log weight 0 and no tokens; they are
rejected; rows that repeat a doc_id get the same noise (of several labelled texts
with one doc_id the least weight per n-gram counts for the cut), and ties at the
k-th key are kept together; without labelled rows of both classes every document with a
token is kept; an empty table gives no rows; a null label counts as none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialise, spare_name, text_of
from foliant.llm.words import Runs, chunks, ids_of, mix, sums_by, texts_of

#: Hash buckets of each model.
BUCKETS = 1 << 14
#: Labelled documents of each class that are used to fit.
TRAIN_ROWS = 10_000
SEED = 17

_AGAIN, _LOWER, _TITLE, _UPPER, _DIGITS = (np.uint64(x) for x in (11, 12, 13, 14, 15))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some texts in order, and how many each text has."""
    runs = Runs(texts)
    if not len(runs.starts):
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    token = runs.hashes()
    upper = np.concatenate([[0], np.cumsum((runs.raw >= 65) & (runs.raw <= 90))])
    capitals, size = upper[runs.ends] - upper[runs.starts], runs.ends - runs.starts
    shape = np.where(capitals == 0, _LOWER, np.where(capitals * 2 > size, _UPPER, _TITLE))
    shape[(runs.kind == 1) & (size == 1)] = _LOWER
    shape[runs.kind == 2] = _DIGITS
    marks = runs.kind == 3
    shape[marks] = token[marks]
    again = np.zeros(len(token), dtype=bool)
    again[1:] = token[1:] == token[:-1]
    first = runs.first[:-1][runs.counts > 0]
    again[first] = False
    shape[again] = _AGAIN
    before = np.concatenate([[np.uint64(1)], shape[:-1]])
    before[first] = 1  # no text follows on another
    pair = mix(mix(shape) + before * np.uint64(0x9E3779B97F4A7C15))
    both = np.stack([token, pair], axis=1).ravel()
    return (both >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), 2 * runs.counts


def sample_of_labels(labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and good (0 or 1) of at most ``most`` labelled documents a class."""
    each = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).where("doc_id IS NOT NULL AND good IS NOT NULL").groupBy("doc_id").agg(F.min("good").alias("good"))
    first = [each.where(F.col("good") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for k in (0, 1)]
    return first[0].unionByName(first[1])


def gumbel(doc_ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Standard Gumbel noise fixed by doc_id and seed."""
    with np.errstate(over="ignore"):
        bits = mix(mix(doc_ids.astype(np.int64).view(np.uint64)) + np.uint64(seed))
    u = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def _boundary(values: np.ndarray, good: np.ndarray) -> float:
    """The cut on the log weight per token with the fewest errors, each class weighted alike."""
    if not (good == 1).any() or not (good == 0).any():
        return float("-inf")
    order = np.argsort(values, kind="stable")
    v, g = values[order], good[order]
    kept_bad = (g == 0).sum() - np.concatenate([[0], np.cumsum(g == 0)])
    lost_good = np.concatenate([[0], np.cumsum(g == 1)])
    errors = kept_bad / max(1, (g == 0).sum()) + lost_good / max(1, (g == 1).sum())
    at = int(errors.argmin())
    if at == 0:
        return float("-inf")
    # As near to the rejected side as can be: documents between the classes stay.
    return float(v[at - 1] + (v[min(at, len(v) - 1)] - v[at - 1]) * 0.25)


def _kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest key by counts in bins that are refined; k is 1 or more."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    for _ in range(8):
        width = (high - low) / 1024
        if not width > 1e-12:
            break
        at = F.least(F.lit(1023), F.floor((F.col("key") - F.lit(low)) / F.lit(width)))
        counts = {r["at"]: r["count"] for r in keys.where(F.col("key").between(low, high)).groupBy(at.alias("at")).count().collect()}
        for b in range(1023, -1, -1):
            if above + counts.get(b, 0) >= k:
                break
            above += counts.get(b, 0)
        low, high = low + b * width, low + (b + 1) * width
    return low


def weigh(docs: DataFrame, labels: DataFrame, seed: int = SEED, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, n_grams, log_weight, key (perturbed), beyond_cut and kept of every row."""
    sample = materialise(sample_of_labels(labels, train_rows), "resample-labels")
    marked = text_of(docs).join(F.broadcast(sample), "doc_id", "left")  # at most 2 * train_rows rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            texts, good = texts_of(batch), np.array([x == 1 for x in batch.column(2).to_pylist()], dtype=bool)
            for first, last in chunks(texts):
                at, n = features(texts[first:last])
                raw += np.bincount(at, minlength=BUCKETS)
                target += np.bincount(at[np.repeat(good[first:last], n)], minlength=BUCKETS)
        there = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(raw[there]), pa.array(target[there])], ["bucket", "raw", "target"])

    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in marked.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most BUCKETS rows
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    spread = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            total, n = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            for first, last in chunks(texts):
                at, n[first:last] = features(texts[first:last])
                total[first:last] = sums_by(n[first:last], spread.value[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n), pa.array(total)], ["doc_id", "good", "n_grams", "log_weight"])

    scored = materialise(marked.mapInArrow(score, "doc_id long, good int, n_grams long, log_weight double"), "resample-scores")
    per = F.col("log_weight") / F.greatest(F.col("n_grams"), F.lit(1))
    known = scored.where("good IS NOT NULL AND n_grams > 0").groupBy("doc_id", "good").agg(F.min(per).alias("per")).toPandas()  # at most 2 * train_rows rows
    cut = _boundary(known["per"].to_numpy(), known["good"].to_numpy())

    def noise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(2).to_numpy() + gumbel(ids_of(batch), seed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], ["doc_id", "n_grams", "log_weight", "beyond_cut", "key"])

    beyond = (F.col("n_grams") > 0) & (per >= F.lit(cut if np.isfinite(cut) else -1e300))
    keyed = scored.select("doc_id", "n_grams", "log_weight", beyond.alias("beyond_cut")).mapInArrow(noise, "doc_id long, n_grams long, log_weight double, beyond_cut boolean, key double")
    keys = materialise(keyed, "resample-keys")
    k = keys.where("beyond_cut").count()
    least = _kth_largest(keys.where("n_grams > 0"), k) if k else float("inf")
    return keys.select("doc_id", "n_grams", "log_weight", "key", "beyond_cut", ((F.col("n_grams") > 0) & (F.col("key") >= F.lit(least))).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the sample holds, all columns; rows without a doc_id, which can't be told apart, stay."""
    key = spare_name(docs, "sampled_id")
    kept = weigh(docs, labels).where("kept").select(F.col("doc_id").alias(key)).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    known = docs.join(kept.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col(key), "left_semi").select(*columns)
    return known.unionByName(docs.where("doc_id IS NULL").select(*columns))
