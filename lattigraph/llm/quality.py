"""Quality classifier (operator 4): positive-unlabelled learning.

A linear scorer is trained to minimise the non-negative unbiased risk

    prior * E_p[l(s)] + max(0, E_u[l(-s)] - prior * E_p[l(-s)]),   l(z) = log(1 + exp(-z)),

with trusted positives (label 1), unlabelled web text and an estimated class prior. When the second term is
negative the step goes against it, as in the published algorithm. Label 0 is never used.

The prior is estimated from positives and unlabelled text alone (best bin): a scorer fitted on one half of both scores the
other; above a score c lie shares p(c) of the positives and u(c) of the unlabelled, so the prior is at most about u(c) / p(c), and
the c is taken at which this bound, widened by the error of both shares, is smallest. Both halves take turns.

Learning rows are those whose crc32(doc_id as text) mod 5 is not 0. At most ``sample`` positives and ``sample`` unlabelled
documents, drawn by a hash of their id, are used for fitting: a documented bound. Of rows with one id one text is
used. Scoring covers every text.

Features come from the whole text alone: shares of its bytes, hashed shares of byte pairs, and a few counts of
words and lines. labels, lang, source and doc_id are no features.

Defined results: a null text counts as empty; an empty text has zero features and so the bias's score;
repeated rows are scored each; with no positives every score is one half; an empty table yields no rows;
``filter_quality`` keeps the input's columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table

THRESHOLD = 0.3
SAMPLE = 8_000
PAIRS = 256
STATS = 12
SIZE = 256 + PAIRS + STATS
SMOOTH = 32.0


def features(text: str | None) -> np.ndarray:
    """The feature vector of one text, of its whole length."""
    out = np.zeros(SIZE, np.float32)
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    out[:256] = np.sqrt(counts / (n + SMOOTH))
    if n > 1:
        pairs = (raw[:-1].astype(np.uint16) << np.uint16(8)) | raw[1:]
        hashed = (pairs * np.uint16(0x9E3B)) >> np.uint16(8)
        out[256 : 256 + PAIRS] = np.sqrt(np.bincount(hashed, minlength=PAIRS) / (n + SMOOTH))
    words = text.split()
    lines = text.split("\n")
    k = len(words) + 8.0
    repeats = sum(map(str.__eq__, words, words[1:])) if len(words) > 1 else 0
    out[256 + PAIRS :] = (
        np.log1p(len(words)) / 10,
        np.log1p(n) / 12,
        len(set(words)) / k,
        repeats / k,
        (len(lines) - len(set(lines))) / (len(lines) + 2.0),
        np.log1p(n / len(lines)) / 8,
        counts[65:91].sum() / (n + SMOOTH),
        counts[48:58].sum() / (n + SMOOTH),
        counts[97:123].sum() / (n + SMOOTH),
        (counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()) / (n + SMOOTH),
        counts[128:].sum() / (n + SMOOTH),
        (n / k) / 20,
    )
    return out


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.stack([features(t) for t in texts]) if texts else np.zeros((0, SIZE), np.float32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.03, decay: float = 1e-3) -> Model:
    """Minimise the non-negative risk with Adam over the whole sample."""
    if not len(positive) or not len(unlabelled):
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(SIZE, np.float32), float(np.log(p / (1 - p))), np.zeros(SIZE, np.float32), np.ones(SIZE, np.float32))
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 0.01
    xp, xu = (positive - mean) / scale, (unlabelled - mean) / scale
    w, b = np.zeros(SIZE, np.float32), 0.0
    m, v = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for t in range(1, steps + 1):
        grad = risk(xp, xu, w, b, prior)[2] + np.append(decay * w, 0.0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return Model(w, b, mean, scale)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled, by the best bin of either half; ``doubt`` is the chance that errors exceed
    their bounds."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    found = []
    for k in (0, 1):
        model = fit(positive[k::2], unlabelled[k::2], 0.5)
        p, u = np.sort(model.score(positive[1 - k :: 2])), np.sort(model.score(unlabelled[1 - k :: 2]))
        c = np.unique(p)
        above_p, above_u = 1 - np.searchsorted(p, c) / len(p), 1 - np.searchsorted(u, c) / len(u)
        error = sum((np.log(4 / doubt) / (2 * len(x))) ** 0.5 for x in (p, u))
        best = np.argmin((above_u + error) / above_p)
        found.append(above_u[best] / above_p[best])
    return float(min(max(np.mean(found), 0.01), 0.99))


def risk(positive: np.ndarray, unlabelled: np.ndarray, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray]:
    """The two terms of the risk of scores x @ w + b, and the gradient by (w, b) of the step: of their sum where the second is not
    negative, else of the second with its sign changed."""
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda p: -np.log(np.maximum(p, 1e-12)).mean()
    sp, su = sigmoid(positive @ w + b), sigmoid(unlabelled @ w + b)
    negative = loss(1 - su) - prior * loss(1 - sp)
    # d l(s) = -(1 - p), d l(-s) = p
    cp, cu = -prior * sp / len(sp), su / len(su)
    if negative < 0:
        cp, cu = -cp, -cu
    else:
        cp = cp - prior * (1 - sp) / len(sp)
    return prior * loss(sp), negative, np.append(positive.T @ cp + unlabelled.T @ cu, cp.sum() + cu.sum())


def held_out():
    """Whether a row is kept from learning."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on learning rows of ``docs``; ``sample`` bounds what is gathered."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    def draw(df: DataFrame, salt: int) -> DataFrame:
        return df.select("doc_id").dropDuplicates().orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(sample)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    chosen = draw(known.where("quality = 1"), 1).withColumn("positive", F.lit(1)).unionByName(draw(text.where(~held_out()), 2).withColumn("positive", F.lit(0)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                x = _matrix(some.column(1).to_pylist()).astype("<f2")
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "positive", "x"])

    # the drawn ids are bounded by 2 * sample, so they may be broadcast
    one = text.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text"))
    rows = one.select("doc_id", "text", "positive").mapInArrow(vectors, "doc_id long, positive int, x binary").collect()
    rows.sort(key=lambda r: (r.positive, r.doc_id, r.x))
    take = lambda k: np.stack([np.frombuffer(r.x, "<f2").astype(np.float32) for r in rows if r.positive == k]) if any(r.positive == k for r in rows) else np.zeros((0, SIZE), np.float32)
    positive, unlabelled = take(1), take(0)
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                s = model.score(_matrix(some.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def filter_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                yield some.filter(pa.array(model.score(_matrix(some.column(place).to_pylist())) >= threshold))

    return docs.mapInArrow(work, docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
