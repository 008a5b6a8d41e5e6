"""Toxic passages by maximum-scoring segments of token log-odds.

Training counts hashed token features of labelled texts and turns them into log-odds between toxic and
clean text, shrunk by a Dirichlet prior that follows the features' overall frequency. A token scores the
log-odds of its most telling feature (the word or its first bytes), less a drift that makes ordinary
text score below zero; features whose log-odds are not significant score nothing but the drift. A linear
scan (Ruzzo and Tompa) finds every maximal-scoring segment. Log-odds make the segment score
exponentially distributed in clean text, so the best of n tokens exceeds s with probability about
n * exp(-s); a passage counts as toxic when that is at most SIGNIFICANCE, and s - ln(n) is comparable
between texts of all lengths. A logistic curve over it and over the sum of the significant passages,
fitted by cross-fitting, gives the final score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import held_out, settle

BUCKETS = 1 << 18
#: Labelled rows used for training at most, those with the smallest hash of their id. All are used
#: below that; the bound keeps the list of ids that is sent to every task small.
MAX_LABELLED = 100_000
PRIOR = 0.02  # weight of the prior, as a share of all training tokens
MIN_Z = 3.0
DRIFT = 1.0
SIGNIFICANCE = 0.01
THRESHOLD = 0.7
PREFIXES = (4, 5)
WORD_CACHE = 400_000

# every ASCII character but letters and digits separates tokens
_SEPARATE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_SEPARATE).split()


def features(word: bytes) -> list[int]:
    """Buckets of the word and of its first bytes."""
    whole = [zlib.crc32(word) % BUCKETS]
    return whole + [zlib.crc32(b"%d^%s" % (n, word[:n])) % BUCKETS for n in PREFIXES if len(word) > n]


class Model(NamedTuple):
    odds: np.ndarray  # per bucket, 0 where not significant
    z: np.ndarray


def log_odds(counts: np.ndarray) -> Model:
    """Model from token counts, one row for clean and one for toxic text."""
    total = counts.sum()
    if not counts[0].sum() or not counts[1].sum():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS))
    strength = PRIOR * total
    prior = strength * (counts.sum(0) + 0.01) / (total + 0.01 * BUCKETS)
    clean, toxic = counts[0] + prior, counts[1] + prior
    odds = np.log(toxic / (counts[1].sum() + strength - toxic)) - np.log(clean / (counts[0].sum() + strength - clean))
    z = odds / np.sqrt(1 / toxic + 1 / clean)
    return Model(np.where(z >= MIN_Z, odds, 0.0), np.where(z >= MIN_Z, z, 0.0))


class Scanner:
    """Finds the segments of one text after another; keeps the scores of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def word(self, word: bytes) -> float:
        score = self.known.get(word)
        if score is None:
            if len(self.known) >= WORD_CACHE:
                self.known.clear()
            best = max(features(word), key=lambda b: self.model.z[b])
            score = self.known[word] = float(self.model.odds[best])
        return score

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of tokens, and (first token, end, score) of every maximal-scoring segment."""
        words = tokens(text)
        known = self.known.get
        hits = []
        for at, word in enumerate(words):
            score = known(word)
            if score is None:
                score = self.word(word)
            if score > DRIFT:
                hits.append((at, score - DRIFT))
        return len(words), maximal_segments(hits)


def maximal_segments(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments, given the tokens that score above zero; the others score -DRIFT.

    Each candidate keeps the total before it and after it. A new one is joined to the nearest earlier
    candidate that starts lower, as long as that one ends lower too. Every candidate is linked to its nearest earlier one that
    starts lower, and the search goes along the links, which makes the whole linear in the hits.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, end, total before, total after, link
    total, reached = 0.0, 0
    for at, score in hits:
        total -= DRIFT * (at - reached)
        first, left = at, total
        total += score
        reached = at + 1
        right = total
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                break
            first, left, before = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = before
        found.append((first, at + 1, left, right, j))
    return [(a, b, right - left) for a, b, left, right, _ in found]


def evidence(length: int, segments: list[tuple[int, int, float]]) -> tuple[float, float, list[tuple[int, int, float]]]:
    """Length-corrected score of the best segment, log of the total of the significant ones, and those."""
    need = math.log(max(length, 1)) - math.log(SIGNIFICANCE)
    significant = [s for s in segments if s[2] >= need]
    best = max((s[2] for s in segments), default=0.0)
    corrected = best - math.log(max(length, 1)) if best else -12.0
    return max(corrected, -12.0), math.log1p(sum(s[2] for s in significant)), significant


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts per fold, label and bucket of one task; at most 4 * BUCKETS rows."""
    sums = np.zeros((4, BUCKETS), np.int64)
    for batch in batches:
        words = [Counter() for _ in range(4)]
        for text, fold, toxic in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "toxic"))):
            words[2 * fold + toxic].update(tokens(text))
        for part, counter in enumerate(words):
            for word, n in counter.items():
                for bucket in features(word):
                    sums[part, bucket] += n
    part, bucket = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[part, bucket])], ["part", "bucket", "n"]
    )


def labelled_ids(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """doc_id, toxic, fold of the rows to learn from: not held out, one row per equal text."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id"), 3, 1))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = settle(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit), "toxicity-labels")
    texts = docs.select("doc_id", F.xxhash64("text").alias("same")).join(F.broadcast(known), "doc_id")
    one = texts.groupBy("same", "toxic").agg(F.min("doc_id").alias("doc_id"))
    fold = F.pmod(F.xxhash64(F.col("same"), F.lit(7)), F.lit(2)).cast("int")
    return settle(one.select("doc_id", "toxic", fold.alias("fold")), "toxicity-training")


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge-penalised logistic curve; the last weight is the constant.

    Newton steps, each halved until the penalised loss falls.
    """
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [0.01])
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + w @ ridge @ w / 2
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


class Trained(NamedTuple):
    model: Model
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Trained:
    """The scorer, from labelled rows that are not held out.

    What reaches the driver is bounded: 4 * BUCKETS counts and two numbers per labelled row, of which
    there are at most `limit`. Without rows of both labels every score is one half.
    """
    ids = F.broadcast(labelled_ids(docs, labels, limit))
    chosen = docs.select("doc_id", "text").join(ids, "doc_id")
    counts = chosen.select("text", "fold", "toxic").mapInArrow(counted, "part int, bucket int, n bigint")
    counts = counts.groupBy("part", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((4, BUCKETS))
    table[counts.column("part").to_numpy(), counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    model = log_odds(table[:2] + table[2:])
    # each half is scored by the model of the other half
    halves = docs.sparkSession.sparkContext.broadcast([log_odds(table[2:]), log_odds(table[:2])])

    def cross_fit(batches):
        scanners = [Scanner(m) for m in halves.value]
        for batch in batches:
            rows = [
                evidence(*scanners[fold].segments(text))[:2]
                for text, fold in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()),
                 batch.column("toxic")], ["best", "total", "toxic"],
            )

    seen = chosen.select("text", "fold", "toxic").mapInArrow(cross_fit, "best double, total double, toxic int").toArrow()
    x = np.column_stack([seen.column("best").to_numpy(), seen.column("total").to_numpy()])
    y = seen.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Trained(model, np.zeros(3))
    # equal weight for both labels, so that 0.5 lies between them whatever their shares are
    return Trained(model, logistic(*balanced(x, y)))


def balanced(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeat the rarer label's rows a whole number of times so that both weigh about the same."""
    few = 1.0 if y.sum() * 2 < len(y) else 0.0
    times = max(1, round((y != few).sum() / max(1, (y == few).sum())))
    repeat = np.where(y == few, times, 1)
    return np.repeat(x, repeat, axis=0), np.repeat(y, repeat)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, predicted and `passages` of every row of `docs` (doc_id, text).

    passages lists (first token, end token, score) of the significant segments. Labels, languages,
    sources and ids are never inputs of a score. A null text is an empty one and is scored as such;
    rows with null or repeated ids are scored like others; an empty table gives no rows.
    """
    found = scan(docs, labels, ["doc_id"])
    return found.select("kept.*", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")


def scan(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """`kept` (the columns of `keep` as one structure, so that no name can clash), score and passages of every row."""
    trained = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    frame = docs.select(F.struct(*keep).alias("kept"), F.col("text").alias("scan"))
    passages = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))

    def scored(batches):
        model, weights = trained.value
        scanner = Scanner(model)
        for batch in batches:
            rows = [evidence(*scanner.segments(text)) for text in batch.column("scan").to_pylist()]
            linear = [weights[0] * r[0] + weights[1] * r[1] + weights[2] for r in rows]
            score = 1 / (1 + np.exp(-np.clip(np.array(linear, float), -30, 30)))
            spans = [[dict(zip(("first", "stop", "score"), s)) for s in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("kept"), pa.array(score), pa.array(spans, passages)], ["kept", "score", "passages"]
            )

    kept = frame.schema["kept"].dataType.simpleString()
    return frame.mapInArrow(scored, f"kept {kept}, score double, passages array<struct<first bigint, stop bigint, score double>>")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with all their columns, whatever these are called."""
    scored = scan(docs, labels, docs.columns)
    return scored.filter(F.col("score") < THRESHOLD).select("kept.*")


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_toxicity(docs, labels)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", "predicted",
        F.size("passages").cast("bigint").alias("n_passages"),
    )
