"""Quality: a generalised additive model with pairwise interactions.

The features describe the form of a text and are cut into bins at quantiles of a bounded sample. Shallow trees of one feature
each are boosted in cycles over the features, each a step on the gradient of the logistic loss, so what is learnt of a
feature is one lookup table over its bins. Then the pairs of features whose residuals call for it most get
tables over both features' bins, boosted the same way. A score is the sum of one entry per table.

Defined results: null and empty texts are scored by the same tables (their features are zeros); if the labels at hand do
not hold both kinds, every score is the smoothed share of label 1; null ids are never held out; repeated rows each have
their score; a very long text is read whole; an empty table gives no rows; further columns are not inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from claimweave.llm import shingle_arrays as A
from claimweave.llm.common import text_of, workers
from claimweave.llm.labelled import FIT_ROWS, fit_sample, held_out
from claimweave.llm.text_features import NAMES, features

MODULUS, HELD = 4, 2
BINS, PAIR_BINS, PAIRS = 32, 8, 10
CYCLES, PAIR_CYCLES, RATE, LEAVES, SHRINK = 300, 100, 0.05, 3, 5.0
THRESHOLD = 0.7


@dataclass
class QualityModel:
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    intercept: float

    def add_up(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a], side="right"), np.searchsorted(self.pair_cuts[b], x[:, b], side="right")]
        return total

    def scores(self, texts: list[str]) -> np.ndarray:
        parts = [self.add_up(features(texts[a:b])) for a, b in A.groups(texts)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *parts]), -500, 500)))


def _quantiles(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="nearest"))


def _tree(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    """Leaf value of every bin of a tree of ``LEAVES`` leaves over ordered bins: the best cuts, one after the other."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    bounds = [0, len(gradient)]

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + SHRINK)

    for _ in range(LEAVES - 1):
        best, where = 1e-12, None
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                c = np.arange(a + 1, b)
                gains = worth(a, c) + worth(c, b) - worth(a, b)
                k = int(np.argmax(gains))
                if gains[k] > best:
                    best, where = gains[k], int(c[k])
        if where is None:
            break
        bounds = sorted([*bounds, where])
    out = np.zeros(len(gradient))
    for a, b in zip(bounds, bounds[1:]):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + SHRINK)
    return out


def boost(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Fits the tables on feature rows and labels."""
    cuts = [_quantiles(x[:, j], BINS) for j in range(x.shape[1])]
    binned = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    intercept = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    score = np.full(len(y), intercept)
    for _ in range(CYCLES):
        for j, at in enumerate(binned):
            p = 1 / (1 + np.exp(-score))
            step = RATE * _tree(np.bincount(at, weights=y - p, minlength=len(tables[j])), np.bincount(at, weights=p * (1 - p), minlength=len(tables[j])))
            tables[j] += step
            score += step[at]
    pair_cuts = [_quantiles(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(pair_cuts)]
    p = 1 / (1 + np.exp(-score))

    def cells(a: int, b: int) -> tuple[np.ndarray, int]:
        wide = len(pair_cuts[b]) + 1
        return coarse[a] * wide + coarse[b], (len(pair_cuts[a]) + 1) * wide

    def call(a: int, b: int) -> float:
        at, n = cells(a, b)
        g, h = np.bincount(at, weights=y - p, minlength=n), np.bincount(at, weights=p * (1 - p), minlength=n)
        return float((g ** 2 / (h + SHRINK)).sum())

    every = [(a, b) for a in range(x.shape[1]) for b in range(a)]
    chosen = sorted(every, key=lambda ab: -call(*ab))[:PAIRS]
    pair_tables = {ab: np.zeros(cells(*ab)[1]) for ab in chosen}
    for _ in range(PAIR_CYCLES):
        for ab in chosen:
            at, n = cells(*ab)
            p = 1 / (1 + np.exp(-score))
            step = RATE * np.bincount(at, weights=y - p, minlength=n) / (np.bincount(at, weights=p * (1 - p), minlength=n) + SHRINK)
            pair_tables[ab] += step
            score += step[at]
    pairs = [(a, b, pair_tables[a, b].reshape(len(pair_cuts[a]) + 1, -1)) for a, b in chosen]
    return QualityModel(cuts, tables, pair_cuts, pairs, intercept)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, labels = batch.column(0).to_pylist(), batch.column(1)
        for a, b in A.groups(texts):
            x = features(texts[a:b])
            yield pa.RecordBatch.from_arrays([labels.slice(a, b - a), *[pa.array(x[:, j]) for j in range(x.shape[1])]], names=["label", *NAMES])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, modulus: int = MODULUS, held: int = HELD) -> QualityModel:
    """Learns ``labels.quality`` from about ``rows`` texts of each label that are not held out."""
    sample, counts = fit_sample(workers(docs), labels, "quality", modulus, held, rows)
    numbers = sample.mapInArrow(_feature_rows, "label int, " + ", ".join(f"{n} double" for n in NAMES)).toArrow()  # the bounded sample as numbers
    y = numbers.column("label").combine_chunks().to_numpy(zero_copy_only=False).astype(float)
    if not len(y) or y.min() == y.max():
        share = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
        return QualityModel([], [], [], [], share)
    x = np.column_stack([numbers.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in NAMES])
    order = np.lexsort((*x.T, y))  # the same model whatever the order of the rows
    return boost(x[order], y[order])


def scorer(model: QualityModel):
    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts.to_pylist()), type=pa.float64())

    return score


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    score = scorer(fit(docs, labels))
    rows = docs.select("doc_id", held_out(MODULUS, HELD).alias("held_out"), score(text_of()).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
