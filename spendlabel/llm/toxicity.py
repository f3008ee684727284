"""Toxicity by non-negative positive-unlabelled learning.

Positives are documents confirmed toxic; everything else is only unlabelled, never
assumed clean. A linear model g on hashed word features is fitted in numpy under the
class-prior-corrected risk

    R = p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)]),   l(z) = log(1 + exp(-z)),

where p is the prior of the toxic class. When the corrected negative part falls below
zero (the model begins to fit the unlabelled rows as all clean), that part is stepped
back instead, as in the non-negative estimator. Features are those whose presence differs
most between positives and unlabelled text. The score is sigmoid(g).

The fit uses at most ``POSITIVES`` + ``UNLABELLED`` rows (hash order of the id); scoring
reads every whole text in the tasks, with the model (at most ``FEATURES`` weights) in the
function's closure.

Edge cases. Null or empty text: scored as a text without words (the model's bias). Null
id: scored; held_out false. Null label: not a positive. No positive at all: every score is
the prior. Repeated rows and ties: one row each, equal texts get equal scores. Repeated
labels of one id: positive if any says so. Empty table: empty result. Extra columns are
ignored (``toxicity``) or passed through (``reject_toxic``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_rows, ship
from .learn import Adam, WordScores, bounded_sample, fold, sampled_features, sigmoid, word_weights

POSITIVES, UNLABELLED = 2_000, 4_000
FEATURES, STEPS, RATE, L2 = 4_000, 300, 0.1, 1e-4
#: Least standardised difference between positives and unlabelled rows of a feature.
Z_LEAST = 3.5
FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7


@dataclass
class Model:
    features: np.ndarray
    weights: np.ndarray
    bias: float


def nn_pu(x, positive: np.ndarray, prior: float, d: int, steps: int = STEPS, rate: float = RATE,
          l2: float = L2) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk; ``positive`` marks the P rows."""
    w, opt = np.zeros(d + 1), Adam(d + 1, rate)
    w[d] = np.log(prior / (1 - prior))
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    for _ in range(steps):
        s = sigmoid(g := x.dot(w[:d]) + w[d])
        soft = np.logaddexp(0, g)  # l(-g)
        negative = soft[~positive].sum() / n_u - prior * soft[positive].sum() / n_p
        # derivative of l(g) is s - 1, of l(-g) is s
        of_neg = np.where(positive, -prior * s / n_p, s / n_u)
        coef = np.where(positive, prior * (s - 1) / n_p, 0) + of_neg if negative >= 0 else -of_neg
        grad = np.append(x.dot_t(coef, d), coef.sum())
        grad[:d] += l2 * w[:d]
        w = opt.step(w, grad)
    return w[:d], float(w[d])


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT,
        prior: float | None = None) -> Model:
    """Model from confirmed positives of ``labels`` (doc_id, toxic) and unlabelled ``docs``,
    both without the held-out fold. ``prior``: None takes the share of positives among the
    labelled training rows."""
    mine = F.coalesce(fold("doc_id", folds), F.lit(held_out)) != held_out
    lab = labels.where(mine).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_pos = lab.agg(F.count("toxic"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(0.9, max(1e-3, n_pos / max(1, n))) if prior is None else prior
    if not n_pos:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    pos = bounded_sample(docs, lab.where("toxic = 1").select("doc_id"), POSITIVES)
    unl = bounded_sample(docs, docs.where(mine).select("doc_id").distinct(), UNLABELLED)
    sample = pos.select(F.lit(1).alias("positive"), "text").unionByName(unl.select(F.lit(0).alias("positive"), "text"))
    marks, x = sampled_features(sample, "positive")
    positive = np.array(marks) == 1
    p, u = x.presence(positive), x.presence(~positive)
    a, b = p / max(1, positive.sum()), u / max(1, (~positive).sum())
    mid = (p + u) / len(marks)
    z = np.abs(a - b) / np.sqrt(np.maximum(mid * (1 - mid), 1e-9) * (1 / max(1, positive.sum()) + 1 / max(1, (~positive).sum())))
    z[p + u < 3] = 0
    best = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    best = best[z[best] > Z_LEAST]
    w, bias = nn_pu(x.keep(best), positive, prior, len(best))
    return Model(best, w, bias)


def toxicity(docs: DataFrame, model: Model, folds: int = FOLDS, held_out: int = HELD_OUT,
             threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"))
    features, weights, bias = model.features, model.weights, model.bias

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordScores(features, weights)
        for b in batches:
            g = np.array([bias + sum(n * table[w] for w, n in word_weights(t).items())
                          for t in column(b, "text").to_pylist()], float)
            s = sigmoid(g)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), column(b, "held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    return rows.select(F.col("doc_id").cast("long"), "text", "held_out").mapInArrow(
        score, "doc_id long, held_out boolean, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (all columns) without the documents scored at or above ``threshold``."""
    ship(docs.sparkSession)
    features, weights, bias = model.features, model.weights, model.bias

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordScores(features, weights)
        for b in batches:
            g = np.array([bias + sum(n * table[w] for w, n in word_weights(t).items())
                          for t in column(b, "text").to_pylist()], float)
            yield b.filter(pa.array(sigmoid(g) < threshold))

    return map_rows(docs, clean, docs.schema)
