"""Hashed indicator features scaled by naive Bayes log-count ratios, for linear classifiers.

Features are n-gram indicators hashed into DIM buckets: present or absent in a text, whatever
its length. A bucket's ratio is r = log((p + a) / |p|) - log((q + a) / |q|) with p and q the
numbers of positive and negative training texts that hold it. Buckets whose share differs
between the classes by less than Z_MIN standard errors get weight 0, which keeps long texts
from drifting on noise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, cut, release, small_batches, tidy, utf8, word_hashes

BITS = 22
DIM = 1 << BITS
PIECE = 1 << 20  # characters worked on at a time, so a very long text needs bounded memory
TRAIN_DOCS = 8_000  # bound on labelled training documents, smallest hash of doc_id first
TRAIN_TASKS = 32  # tasks that read their features
CHUNK = 1 << 16  # neighbouring buckets counted under one key
MIN_DF = 5
Z_MIN = 4.0
ALPHA = 1.0


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = h * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    return (h >> U(64 - BITS)).astype(np.int32)


def char_ngrams(text: str, orders: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of the whole text, in pieces, repeats included."""
    c = codepoints(text).astype(U)
    top = max(orders)
    for at in range(0, max(len(c), 1), PIECE):
        part = c[at : at + PIECE + top - 1]
        h = np.zeros(len(part), U)
        for n in range(1, top + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] << U(13)) ^ (h[: len(part) - n + 1] >> U(51)) ^ (part[n - 1 :] * U(0x2545F4914F6CDD1D))
            if n in orders:
                # the last piece's start positions only: others begin in the next piece
                yield _bucket(h[:PIECE] + U(n))


def repeat_ngrams(text: str, orders: tuple[int, ...]) -> np.ndarray:
    """Buckets of n-grams over the stream "word equals the word before": one bucket per order
    and number of equalities among n neighbours, when any."""
    out = []
    w = word_hashes(utf8(text))
    same = (w[1:] == w[:-1]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(same)])
    for n in orders:
        if len(same) >= n and (hits := np.unique(total[n:] - total[:-n])).size:
            out.append(_bucket(hits.astype(U) + U(1 << 40) * U(n)))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


Features = Callable[[str], Iterator[np.ndarray]]


def present(text: str | None, features: Features) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    seen = [np.unique(codes) for codes in features(text or "")]
    return np.unique(np.concatenate(seen)).astype(np.int32) if seen else np.zeros(0, np.int32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * (bias + sum of weights of present buckets) + shift)))"""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, text: str | None, features: Features) -> float:
        hits = []
        for codes in features(text or ""):
            hits.append(np.unique(codes[self.weights[codes] != 0]))
        found = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int32)
        return float(self.bias + self.weights[found].sum(dtype=np.float64))

    def score(self, text: str | None, features: Features) -> float:
        z = self.slope * self.margin(text, features) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, bound: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, text, y of at most `bound` labelled ids of docs for which `learn` (over doc_id) holds;
    labels of ids that aren't in docs don't use up the bound. An id labelled both ways counts as
    1. The id list is bounded and broadcast. Rows that share an id are one training document, the
    least of their texts, so repeats don't pass the bound; they are merged map-side before any
    shuffle."""
    ids = (
        labels.filter(F.col(label).isNotNull() & F.coalesce(learn, F.lit(False)))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    wanted = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return wanted.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).repartition(TRAIN_TASKS)


@dataclass
class Training:
    """What a linear model is fitted to. lists: of each training text, its buckets whose ratio
    isn't 0, as places in `buckets`; scale: the ratios."""

    lists: list[np.ndarray]
    y: np.ndarray
    buckets: np.ndarray
    scale: np.ndarray

    def model(self, w: np.ndarray, *rest: float) -> Model:
        """The weights w of the scaled features, and the rest of a Model."""
        weights = np.zeros(DIM, np.float32)
        weights[self.buckets] = w * self.scale
        return Model(weights, *rest)


def log_count_ratio(neg: np.ndarray, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """r of buckets that neg and pos of the n[0] and n[1] texts of each class hold; 0 where the
    classes don't differ clearly."""
    ratio = np.log((pos + ALPHA) / (n[1] + 2 * ALPHA)) - np.log((neg + ALPHA) / (n[0] + 2 * ALPHA))
    share = (pos + neg) / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
    clear = (neg + pos >= MIN_DF) & (np.abs(pos / n[1] - neg / n[0]) >= Z_MIN * error)
    return np.where(clear, ratio, 0).astype(np.float32)


def bucket_ratios(rows: DataFrame, features: Features, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets whose r isn't 0, ascending, and r. Counted on the executors: each task packs its
    counts by chunks of buckets, and only these buckets reach the driver."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros((2, DIM), np.int32)
        for p in parts:
            for t, k in zip(p["text"], p["y"], strict=True):
                df[k][present(t, features)] += 1
        for at in range(0, DIM, CHUNK):
            neg, pos = df[:, at : at + CHUNK]
            held = np.flatnonzero(neg + pos).astype(np.int32)
            if held.size:
                yield pd.DataFrame({"at": [at], "held": [held.tobytes()], "neg": [neg[held].tobytes()], "pos": [pos[held].tobytes()]})
        tidy()

    def ratios(p: pd.DataFrame) -> pd.DataFrame:
        df = np.zeros((2, CHUNK), np.int64)
        for held, *counts in zip(p["held"], p["neg"], p["pos"], strict=True):
            for k in (0, 1):
                df[k][np.frombuffer(held, np.int32)] += np.frombuffer(counts[k], np.int32)
        r = log_count_ratio(df[0], df[1], n)
        used = np.flatnonzero(r)
        return pd.DataFrame({"buckets": [(used + p["at"].iloc[0]).astype(np.int32).tobytes()], "r": [r[used].tobytes()]})

    counts = rows.select("text", "y").mapInPandas(count, "at int, held binary, neg binary, pos binary")
    got = counts.groupBy("at").applyInPandas(ratios, "buckets binary, r binary").collect()
    buckets = np.frombuffer(b"".join(x["buckets"] for x in got), np.int32)
    r = np.frombuffer(b"".join(x["r"] for x in got), np.float32)
    order = np.argsort(buckets)
    return buckets[order], r[order]


def gather(rows: DataFrame, features: Features) -> Training:
    """What the training rows say. Texts and buckets of ratio 0 stay on the executors, which go
    through the texts twice: to count buckets, then to list those of each text."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = cut(rows, "training")  # else the documents are read for each pass
    n = np.zeros(2)
    for x in rows.groupBy("y").count().collect():
        n[x["y"]] = x["count"]
    buckets, scale = bucket_ratios(rows, features, n) if n.all() else (np.zeros(0, np.int32), np.zeros(0, np.float32))
    shared = spark.sparkContext.broadcast(buckets)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.full(DIM, -1, np.int32)
        place[shared.value] = np.arange(len(shared.value), dtype=np.int32)
        for p in parts:
            found = (place[present(t, features)] if len(shared.value) else place[:0] for t in p["text"])
            yield pd.DataFrame({"doc_id": p["doc_id"], "y": p["y"], "f": [k[k >= 0].tobytes() for k in found]})
        tidy()

    got = rows.mapInPandas(read, "doc_id long, y int, f binary").collect()
    shared.destroy()
    release(rows, spark)
    got.sort(key=lambda r: r["doc_id"])  # the same model whatever the order of tasks
    return Training([np.frombuffer(r["f"], np.int32) for r in got], np.array([r["y"] for r in got], np.int64), buckets, scale)


def constant(y: np.ndarray) -> Model:
    """Without both classes: the smoothed share of label 1 for every text."""
    p = (y.sum() + 1) / (len(y) + 2)
    return Model(np.zeros(DIM, np.float32), float(np.log(p / (1 - p))))


def score_column(docs: DataFrame, model: Model, features: Features) -> Column:
    """Scores of docs.text; only the text goes to Python and the model is broadcast once (16 MB)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in parts:
            yield pd.Series([m.score(t, features) for t in texts], dtype="float64")
        tidy()

    return score(F.col("text").cast("string"))
