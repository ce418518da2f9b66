"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features: indicators of the 3- to 5-grams of the lower-cased text, scaled by their log-count
ratio; a logistic model with an L2 penalty is fitted to them. Learning reads at most
TRAIN_DOCS labelled documents; every document is scored, whole.

Defined results: null or empty text has no n-gram and gets the bias's score; repeated rows are
scored each for itself; a null doc_id counts as not held out and isn't learned from; extra
columns pass through, and one named as a result column is replaced; with fewer than two
classes among the labels every text gets the smoothed share of label 1; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nbfeatures as nb
from .common import fold, held_out, table

ORDERS = (3, 4, 5)
THRESHOLD = 0.7
FOLDS, HELD = 3, 1
PENALTY = 1e-4
STEPS = 300
RATE = 0.02


def features(text: str) -> Iterator[np.ndarray]:
    yield from nb.char_ngrams(f" {text.lower()} ", ORDERS)


def fit_logistic(t: nb.Training) -> nb.Model:
    """Gradient descent with per-weight rates on the mean log-loss; features are r of present buckets."""
    y, scale = t.y, t.scale
    if len(set(y.tolist())) < 2:
        return nb.constant(y)
    col = np.concatenate(t.lists)
    row = np.repeat(np.arange(len(y), dtype=np.int32), [len(x) for x in t.lists])
    val = scale[col]
    n, d = len(y), len(scale)
    w, mean, power = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)  # the last is the bias
    for k in range(1, STEPS + 1):
        z = np.bincount(row, val * w[col], n) + w[d]
        e = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / n
        g = np.append(np.bincount(col, val * e[row], d) + PENALTY * w[:d], e.sum())
        mean = 0.9 * mean + 0.1 * g
        power = 0.99 * power + 0.01 * g * g
        rate = RATE * (1 - (k - 1) / STEPS)
        w -= rate * (mean / (1 - 0.9**k)) / (np.sqrt(power / (1 - 0.99**k)) + 1e-9)
    return t.model(w[:d], float(w[d]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = nb.TRAIN_DOCS) -> nb.Model:
    rows = nb.training_rows(docs, labels, label, fold(F.col("doc_id"), FOLDS) != HELD, bound)
    return fit_logistic(nb.gather(rows, features))


def score_toxicity(docs: DataFrame, model: nb.Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted."""
    out = docs.withColumn("score", nb.score_column(docs, model, features))
    return out.withColumn("held_out", held_out(F.col("doc_id"), FOLDS, HELD)).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")
