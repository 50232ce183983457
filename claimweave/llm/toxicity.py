"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

From a bounded sample of labelled texts, the texts of each label that have an n-gram are counted; the smoothed ratio of the
two shares, as a logarithm, scales the n-gram's column. The columns that tell the labels apart best are kept, and a
logistic regression with a ridge penalty is fitted on the scaled binary features. Every whole text is then scored with one
table of weights: the sum over its distinct n-grams.

Defined results: null and empty texts are scored like any text, by the intercept alone; if the labels at hand do not hold
both kinds, every score is the smoothed share of label 1; null ids are never held out; repeated rows each have their
score; a very long text is cut into overlapping parts; an empty table gives no rows; further columns are not inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from claimweave.llm.char_grams import BITS, in_groups
from claimweave.llm.common import text_of, workers
from claimweave.llm.labelled import FIT_ROWS, fit_sample, held_out

MODULUS, HELD = 5, 0
#: Columns of the regression; smoothing of the counts; least texts an n-gram is in; ridge; rounds of descent.
COLUMNS, SMOOTHING, LEAST_TEXTS, RIDGE, ROUNDS = 20_000, 1.0, 3, 3e-5, 300
THRESHOLD = 0.5


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label per bucket, summed over the partition."""
    counts = np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        texts, labels = batch.column(0).to_pylist(), np.asarray(batch.column(1))
        for a, b, buckets, owners in in_groups(texts):
            for label in (0, 1):
                counts[label] += np.bincount(buckets[labels[a:b][owners] == label], minlength=1 << BITS)
    there = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[0, there]), pa.array(counts[1, there])], names=["bucket", "n0", "n1"])


def _rows_of(columns: np.ndarray):
    """Each text's label and its columns."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.full(1 << BITS, -1, dtype=np.int32)
        number[columns] = np.arange(len(columns))
        for batch in batches:
            texts, labels = batch.column(0).to_pylist(), batch.column(1)
            for a, b, buckets, owners in in_groups(texts, number >= 0):
                bounds = np.searchsorted(owners, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays([labels.slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(number[buckets]))], names=["label", "at"])

    return rows


def descend(x_rows: np.ndarray, x_cols: np.ndarray, scale: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic regression on binary features times ``scale``: accelerated gradient descent."""
    n, total = len(scale), weight.sum()
    w, b, w_at, b_at, t = np.zeros(n), 0.0, np.zeros(n), 0.0, 1.0
    parts = [slice(at, at + 1_000_000) for at in range(0, len(x_rows), 1_000_000)]  # bounds the temporary arrays
    norm = sum((np.bincount(x_rows[at], weights=scale[x_cols[at]] ** 2, minlength=len(y)) for at in parts), np.ones(len(y)))
    step = 4.0 / (np.average(norm, weights=weight) + 4 * ridge)
    for _ in range(rounds):
        u, z = w_at * scale, np.full(len(y), b_at)
        for at in parts:
            z += np.bincount(x_rows[at], weights=u[x_cols[at]], minlength=len(y))
        wrong = weight * (1 / (1 + np.exp(-z)) - y) / total
        gradient = ridge * w_at
        for at in parts:
            gradient += np.bincount(x_cols[at], weights=wrong[x_rows[at]], minlength=n) * scale
        w_new, b_new, t_new = w_at - step * gradient, b_at - step * wrong.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        w_at, b_at = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, b


class ToxicityModel:
    """A table of weights by n-gram bucket, and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)

    def scores(self, texts: list[str]) -> np.ndarray:
        out = [np.zeros(0)]
        for a, b, buckets, owners in in_groups(texts, self.weights != 0):
            out.append(np.bincount(owners, weights=self.weights[buckets], minlength=b - a))
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out) + self.intercept, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, modulus: int = MODULUS, held: int = HELD) -> ToxicityModel:
    """Learns ``labels.toxic`` from about ``rows`` texts of each label that are not held out."""
    sample, counts = fit_sample(workers(docs), labels, "toxic", modulus, held, rows)
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    share = np.log((n1 + 1) / (n0 + 1))
    have = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if not have.get(0) or not have.get(1):
        return ToxicityModel(np.zeros(1 << BITS), share)
    sums = sample.mapInArrow(_label_counts, "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = F.log((F.col("n1") + SMOOTHING) / (have[1] + 2 * SMOOTHING)) - F.log((F.col("n0") + SMOOTHING) / (have[0] + 2 * SMOOTHING))
    p, q = F.col("n1") / have[1], F.col("n0") / have[0]
    both = (F.col("n1") + F.col("n0")) / (have[0] + have[1])
    telling = F.pow(p - q, F.lit(2)) / (both * (F.lit(1.0) - both) + F.lit(1e-9))
    best = sums.where(F.col("n0") + F.col("n1") >= LEAST_TEXTS).select("bucket", ratio.alias("ratio"), telling.alias("telling"))
    best = best.orderBy(F.desc("telling"), "bucket").limit(COLUMNS).collect()  # at most COLUMNS rows of numbers
    columns, scale = np.array([r.bucket for r in best], dtype=np.int64), np.array([r.ratio for r in best])
    table = sample.mapInArrow(_rows_of(columns), "label int, at array<int>").toArrow()  # the bounded sample as column numbers
    y = table.column("label").combine_chunks().to_numpy(zero_copy_only=False).astype(float)
    lists = table.column("at").combine_chunks()
    sizes = np.diff(np.asarray(lists.offsets))
    x_rows, x_cols = np.repeat(np.arange(len(y), dtype=np.int32), sizes), np.asarray(lists.flatten())
    # both labels weigh the same, whatever their shares: the threshold then lies midway between them
    w, b = descend(x_rows, x_cols, scale, y, np.where(y == 1, 1 / y.sum(), 1 / (len(y) - y.sum())))
    weights = np.zeros(1 << BITS)
    weights[columns] = w * scale
    return ToxicityModel(weights, b)


def scorer(model: ToxicityModel):
    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()), type=pa.float64())

    return score


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    score = scorer(fit(docs, labels))
    rows = docs.select("doc_id", held_out(MODULUS, HELD).alias("held_out"), score(text_of()).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    score = scorer(fit(docs, labels))
    return docs.withColumn("__score", score(text_of())).where(F.col("__score") < THRESHOLD).drop("__score")
