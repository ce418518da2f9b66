"""Quality classifier: naive Bayes support vectors.

Features: indicators of character 1- to 3-grams and of n-grams over the stream "word equals
the word before", scaled by class log-count ratios. A linear model with hinge loss and L2
penalty is fitted by dual coordinate descent; a two-parameter sigmoid turns its margin into a
score between 0 and 1. Learning reads at most TRAIN_DOCS labelled documents; every document is
scored, whole.

Defined results: as for toxicity (null text, null ids, repeated rows, extra columns, missing
classes and empty tables).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nbfeatures as nb
from .common import fold, held_out, table

ORDERS = (1, 2, 3)
REPEATS = (2, 4, 8)
THRESHOLD = 0.3
FOLDS, HELD = 5, 0
COST = 0.1
EPOCHS = 30


def features(text: str) -> Iterator[np.ndarray]:
    yield from nb.char_ngrams(text, ORDERS)
    yield nb.repeat_ngrams(text, REPEATS)


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """L2-regularised hinge loss: each step solves the dual for one row exactly. Returns w over
    the scaled features and the bias, which is learned as a constant feature."""
    sign = np.where(y == 1, 1.0, -1.0)
    w, b, a = np.zeros(len(scale)), 0.0, np.zeros(len(y))
    vals = [scale[x] for x in rows]
    diag = np.array([v @ v + 1 for v in vals])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(y)):
            g = sign[i] * (w[rows[i]] @ vals[i] + b) - 1
            new = min(max(a[i] - g / diag[i], 0.0), cost)
            if new != a[i]:
                d = (new - a[i]) * sign[i]
                w[rows[i]] += d * vals[i]
                b += d
                moved = max(moved, abs(d))
                a[i] = new
        if moved < 1e-4 * cost:
            break
    return w, b


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid by Newton steps on smoothed targets."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([margin, np.ones(len(y))])
    k = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ k, -60, 60)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * len(y) * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - t) + 1e-6 * len(y) * k)
        k = k - np.clip(step, -1, 1)
    return float(max(k[0], 0.0)), float(k[1])


def fit_support_vectors(t: nb.Training) -> nb.Model:
    if len(set(t.y.tolist())) < 2:
        return nb.constant(t.y)
    w, b = dual_coordinate_descent(t.lists, t.scale, t.y)
    margin = np.array([w[x] @ t.scale[x] + b for x in t.lists])
    return t.model(w, float(b), *sigmoid_fit(margin, t.y))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = nb.TRAIN_DOCS) -> nb.Model:
    rows = nb.training_rows(docs, labels, label, fold(F.col("doc_id"), FOLDS) != HELD, bound)
    return fit_support_vectors(nb.gather(rows, features))


def score_quality(docs: DataFrame, model: nb.Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted."""
    out = docs.withColumn("score", nb.score_column(docs, model, features))
    return out.withColumn("held_out", held_out(F.col("doc_id"), FOLDS, HELD)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")
