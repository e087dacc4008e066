"""Toxicity by maximum-scoring segments (operator 4).

Tokens are runs of letters, lower-cased. A token's features are the token and its
first 4, 5 and 6 bytes (so that forms of a stem that no label covers are met).
A feature's count is the number of times it occurs, at most ``MOST_A_TEXT`` a
document. Its log-odds between toxic and other labelled documents are taken with
an informative Dirichlet prior (the features' overall frequencies); a feature
that ``LEAST_TEXTS`` toxic documents have and whose log-odds are clear scores
their lower bound, ``BOUND`` standard errors below. Every other token scores the
log-likelihood ratio of meeting none, which is a little below zero.

Per document one linear scan finds all maximal-scoring segments. A segment with
score S is expected K n exp(-lambda S) times by chance in n tokens. Lambda starts
from the positive root of the expected exponential of a token's score in other
text and is fitted, with K, to the segments there (texts without any included). The
log of one plus the inverse of that number, for the segment least expected, is
the document's evidence (0 where there is none, at most ``MOST_EVIDENCE``), and a logistic curve turns it
into a probability: under chance the best score of a text follows the
extreme-value law, so long texts need a better one.

Chance and curve are fitted to labelled documents too, each scored by features
that weren't learnt from its own fold (of ``FOLDS``), so they hold for new texts.
Only labelled rows whose crc32(doc_id as text) mod 4 is not 2 are used, at most
``TRAIN_ROWS`` a class (a documented parameter; the first by hash of doc_id); the
constants below were chosen by cross-validation within such rows. What is
collected are the clear features of that sample. Scores use the text alone;
every document is scanned whole.

Defined results: null and empty texts, and all others without a segment, have
the lowest score there is; without labelled rows of both classes every score is
0; a null doc_id isn't held out; repeated rows are scored each (of several
labelled texts with one doc_id the first by hash is learnt from); an empty table
gives no rows; contradictory labels of a doc_id count as toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import materialise, text_of
from foliant.llm.words import Runs, chunks, mix, texts_of

TRAIN_ROWS = 10_000
#: Bytes of the prefixes that are features.
PREFIXES = (4, 5, 6)
#: The most times that a document counts for a feature, and how many toxic documents must have it.
MOST_A_TEXT, LEAST_TEXTS = 3, 2
#: Least log-odds of a feature, their least ratio to their standard error, standard errors taken off, and what must be left.
LEAST_ODDS, LEAST_Z, BOUND, LEAST_SCORE = 2.0, 2.5, 1.5, 1.5
PRIOR_STRENGTH, PRIOR_LEAST = 500.0, 0.5
FOLDS = 4
#: Evidence beyond which a text is no likelier to be toxic: one in so many e-folds by chance.
MOST_EVIDENCE = 20.0
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def token_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes, a row per token and a column per kind, and tokens per text."""
    runs = Runs(texts, wanted=(1,))
    kinds = [runs.hashes()]
    for k in PREFIXES:
        at = mix(runs.hashes(k) + np.uint64(k))
        at[runs.ends - runs.starts < k] = 0
        kinds.append(at)
    return np.stack(kinds, axis=1) if len(runs.starts) else np.zeros((0, 1 + len(PREFIXES)), dtype=np.uint64), runs.counts


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last + 1, score) in one pass.

    Candidates are kept with the running sums before and after them; a new one
    swallows back to the latest with a smaller sum before, while that makes it larger.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last + 1, sum before, sum after
    total = 0.0
    for k, x in enumerate(scores):
        before = total
        total += x
        if x <= 0:
            continue
        first, left = k, before
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j -= 1
            if j < 0 or found[j][3] >= total:
                found.append((first, k + 1, left, total))
                break
            first, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right in found]


class Scorer:
    """Scores of tokens, the segments of texts and what they say."""

    def __init__(self, features: np.ndarray, odds: np.ndarray, miss: float = -1e-3, scale: float = 1.0, log_k: float = 0.0, slope: float = 0.0, offset: float = -40.0):
        order = np.argsort(features)
        self.features, self.odds = features[order], odds[order]
        self.miss, self.scale, self.log_k, self.slope, self.offset = miss, scale, log_k, slope, offset
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(features >> np.uint64(44)).astype(np.int64)] = True

    def token_scores(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the tokens with a toxic feature, and their scores (the largest of theirs)."""
        hit = np.zeros(len(features), dtype=bool)
        for k in range(features.shape[1]):
            hit |= self.maybe[(features[:, k] >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(hit)
        if not len(at) or not len(self.features):
            return np.zeros(0, dtype=np.int64), np.zeros(0)
        mine = features[at]
        place = np.minimum(np.searchsorted(self.features, mine), len(self.features) - 1)
        best = np.where(self.features[place] == mine, self.odds[place], 0.0).max(axis=1)
        return at[best > 0], best[best > 0]

    def segments(self, texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
        """Per text the number of tokens and its maximal segments (token places)."""
        for first, last in chunks(texts):
            features, counts = token_features(texts[first:last])
            at, score = self.token_scores(features)
            begin = 0
            cuts = np.searchsorted(at, np.concatenate([[0], np.cumsum(counts)]))
            for k, n in enumerate(counts.tolist()):
                a, b = cuts[k], cuts[k + 1]
                places = (at[a:b] - begin).tolist()
                begin += n
                # The stretch of misses between two hits is one item: the scan visits hits alone.
                items: list[float] = []
                where: list[int] = []
                previous = -1
                for p, s in zip(places, score[a:b].tolist(), strict=True):
                    items += [self.miss * (p - previous - 1), s]
                    where += [previous + 1, p]
                    previous = p
                yield n, [(where[x], where[y - 1] + 1, s) for x, y, s in maximal_segments(items)]

    def significances(self, n: int, segments: list[tuple[int, int, float]]) -> list[float]:
        """Log of the inverse of how often each segment is expected by chance in n tokens; above 0 it is a significant one."""
        chance = self.log_k + np.log(max(n, 1))
        return [self.scale * s - chance for _, _, s in segments]

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        return float(min(np.logaddexp(0.0, max(self.significances(n, segments), default=-np.inf)), MOST_EVIDENCE))

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -40, 40))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and offset of a logistic curve, by Newton steps with a small ridge."""
    centre, scale = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - centre) / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(2)
        step = np.linalg.solve(h, z.T @ (y - p) - 0.05 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    slope = max(0.0, w[0] / scale)
    return slope, float(w[1] - slope * centre)


def chance_scale(scores: np.ndarray, counts: np.ndarray, misses: float, miss: float) -> float:
    """The positive root x of the mean of exp(x * score) = 1 over some scores and a number of misses."""
    total = counts.sum() + misses

    def mean(x: float) -> float:
        return float((counts * np.exp(np.minimum(x * scores, 700))).sum() + misses * np.exp(x * miss)) / total - 1

    low, high = 1e-6, 1.0
    while mean(high) < 0 and high < 64:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return high


def sample_of_labels(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, toxic, fold and text of the rows that are learnt from, written to the shared folder."""
    each = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = [each.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows) for k in (0, 1)]
    sample = materialise(first[0].unionByName(first[1]), "toxicity-labels")
    rows = text_of(docs).join(F.broadcast(sample), "doc_id")  # at most 2 * train_rows rows
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    held = one.select("doc_id", "toxic", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"), "text")
    # Some megabytes that are worked on several times: a file for each core, which adaptive execution would put into one.
    return materialise(held.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id"), "toxicity-sample")


def feature_counts(rows: DataFrame) -> DataFrame:
    """Per feature and fold: toxic and other (times it occurs, so many a document at most), texts (toxic documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, toxic, fold = texts_of(batch), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for a, b in chunks(texts):
                features, counts = token_features(texts[a:b])
                if not len(features):
                    continue
                doc = np.repeat(np.arange(a, b), counts * features.shape[1])
                flat = features.ravel()
                kinds, at = np.unique(flat, return_inverse=True)
                pair, n = np.unique(doc * len(kinds) + at, return_counts=True)
                n = np.minimum(n, MOST_A_TEXT)
                label, kind = toxic[pair // len(kinds)], pair % len(kinds)
                key, place = np.unique(fold[pair // len(kinds)] * len(kinds) + kind, return_inverse=True)
                sums = [np.bincount(place, weights=w, minlength=len(key)).astype(np.int64) for w in (n * (label == 1), n * (label == 0), label == 1)]
                real = kinds[key % len(kinds)] != 0  # a token shorter than a prefix has none
                yield pa.RecordBatch.from_arrays([pa.array(x[real]) for x in (kinds[key % len(kinds)].view(np.int64), (key // len(kinds)).astype(np.int32), *sums)], ["feature", "fold", "toxic", "other", "texts"])

    found = rows.select("text", "toxic", "fold").mapInArrow(run, "feature long, fold int, toxic long, other long, texts long")
    return found.groupBy("feature", "fold").agg(*[F.sum(x).alias(x) for x in ("toxic", "other", "texts")])


def clear_features(counted: DataFrame, without: tuple[int | None, ...] = (None,)) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and scores of the clear features, learnt from all folds (None) or from all but one, for each of ``without``; one pass for all."""
    names = ("toxic", "other", "texts")
    sums = {(r["fold"], x): int(r[x] or 0) for r in counted.groupBy("fold").agg(*[F.sum(x).alias(x) for x in names]).collect() for x in names}
    inside = lambda x, k: F.col(x) if k is None else F.when(F.col("fold") != k, F.col(x)).otherwise(0)
    each = counted.groupBy("feature").agg(*[F.sum(inside(x, k)).alias(f"{x}{i}") for i, k in enumerate(without) for x in names])
    found = []
    for i, k in enumerate(without):
        n1, n0 = (sum(n for (fold, y), n in sums.items() if y == x and fold != k) for x in ("toxic", "other"))
        toxic, other = F.col(f"toxic{i}"), F.col(f"other{i}")
        prior = F.lit(PRIOR_LEAST) + PRIOR_STRENGTH * (toxic + other) / F.lit(float(max(1, n1 + n0)))
        a, b = toxic + prior, other + prior
        odds = F.log(a / (n1 + PRIOR_STRENGTH - a)) - F.log(b / (n0 + PRIOR_STRENGTH - b))
        error = F.sqrt(1 / a + 1 / b)
        clear = (F.col(f"texts{i}") >= LEAST_TEXTS) & (odds >= LEAST_ODDS) & (odds >= LEAST_Z * error) & (odds - BOUND * error >= LEAST_SCORE) & F.lit(n1 > 0 and n0 > 0)
        found.append(F.when(clear, F.struct(F.lit(i).alias("set"), (odds - BOUND * error).alias("score"))))
    best = each.select("feature", F.inline(F.array_compact(F.array(*found)))).toPandas()  # features of the bounded sample
    parts = [best[best["set"] == i] for i in range(len(without))]
    return [(x["feature"].to_numpy(dtype=np.int64).view(np.uint64), x["score"].to_numpy(dtype=np.float64)) for x in parts]


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Scorer:
    """Fit features, chance and curve to the labelled rows that aren't held out."""
    rows = sample_of_labels(docs, labels, train_rows)
    counted = materialise(feature_counts(rows), "toxicity-counts")
    (features, odds), *apart = clear_features(counted, (None, *range(FOLDS)))
    if {r["toxic"] for r in rows.select("toxic").distinct().collect()} != {0, 1} or not len(features):
        return Scorer(np.zeros(0, dtype=np.uint64), np.zeros(0))

    def each_fold(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes], pa.Array]]:
        """Texts and labels of a batch by fold, a chunk at a time."""
        texts, fold = texts_of(batch), batch.column(2).to_numpy()
        for k in range(FOLDS):
            mine = np.flatnonzero(fold == k)
            part = [texts[x] for x in mine.tolist()]
            for first, last in chunks(part):
                yield k, part[first:last], batch.column(1).take(pa.array(mine[first:last]))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(*x) for x in apart]
        for batch in batches:
            for k, texts, toxic in each_fold(batch):
                found, counts = token_features(texts)
                at, score = scorers[k].token_scores(found)
                cuts = np.searchsorted(at, np.concatenate([[0], np.cumsum(counts)]))
                yield pa.RecordBatch.from_arrays([toxic, pa.array(counts), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(score, pa.float64()))], ["toxic", "n", "scores"])

    met = materialise(rows.select("text", "toxic", "fold").mapInArrow(hits, "toxic int, n long, scores array<double>"), "toxicity-hits", rows=2 * train_rows)
    sums = {r["toxic"]: (r["n"] or 0, r["hits"] or 0) for r in met.groupBy("toxic").agg(F.sum("n").alias("n"), F.sum(F.size("scores")).alias("hits")).collect()}
    chance = met.where("toxic = 0").select(F.explode("scores").alias("s")).groupBy(F.round("s", 1).alias("s")).count().toPandas()  # a row a tenth
    rate = {k: (h + 0.5) / (n + 1.0) for k, (n, h) in sums.items()}
    # Half a hit of the mean score stands for what no other text happens to have.
    values = np.append(chance["s"].to_numpy(dtype=float), odds.mean())
    times = np.append(chance["count"].to_numpy(dtype=float), 0.5)
    misses = max(1.0, sums[0][0] - sums[0][1])
    drift = float((values * times).sum() / misses)
    scorer = Scorer(features, odds, min(-1e-3, float(np.log1p(-rate[1]) - np.log1p(-rate[0])), -2 * drift))
    scorer.scale = chance_scale(values, times, misses, scorer.miss)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(*x, scorer.miss) for x in apart]
        for batch in batches:
            for k, texts, toxic in each_fold(batch):
                got = list(scorers[k].segments(texts))
                yield pa.RecordBatch.from_arrays([toxic, pa.array([n for n, _ in got], pa.int64()), pa.array([[s for _, _, s in found] for _, found in got], pa.list_(pa.float64()))], ["toxic", "n", "scores"])

    known = rows.select("text", "toxic", "fold").mapInArrow(segments, "toxic int, n long, scores array<double>").toPandas()  # at most 2 * train_rows rows
    n, y = known["n"].to_numpy(dtype=float), known["toxic"].to_numpy(dtype=float)
    by_chance = np.concatenate([np.zeros(0), *known["scores"][y == 0]])
    beyond = by_chance - odds.min()  # every segment scores so much
    # The root as one observation more: how fast the tail of segments by chance falls, as it was met.
    scorer.scale = float((len(beyond) + 1) / (np.maximum(beyond, 0).sum() + 1 / scorer.scale))
    scorer.log_k = float(np.log((len(by_chance) + 0.5) / max(1.0, n[y == 0].sum())) + scorer.scale * odds.min())
    x = np.array([scorer.evidence(int(k), [(0, 0, s) for s in found]) for k, found in zip(n, known["scores"], strict=True)])
    scorer.slope, scorer.offset = _logistic(x, y)
    return scorer


def score_documents(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score, segments (first and last + 1 of their tokens, score; the significant ones in order), held_out, predicted."""
    scorer = train(docs, labels, train_rows)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            mine = shared.value
            scores, clear = [], []
            for n, found in mine.segments(texts_of(batch)):
                scores.append(mine.score(mine.evidence(n, found)))
                clear.append([dict(zip(("first", "end", "score"), x, strict=True)) for x, s in zip(found, mine.significances(n, found), strict=True) if s > 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(clear, pa.list_(segment))], ["doc_id", "score", "segments"])

    out = text_of(docs).mapInArrow(run, "doc_id long, score double, segments array<struct<first:long,end:long,score:double>>")
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
