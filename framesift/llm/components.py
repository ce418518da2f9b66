"""Connected components by alternating large-star and small-star steps on DataFrames; few edges are
followed on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def _star(arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """arcs u, v in the directions that a step needs: each (u, v) with m, the least of u and
    its v. The minimum is aggregated map-side; a node of very many arcs is met by a join that
    AQE can split. Also the table of minima, to be dropped after use."""
    least = cut(arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
    return arcs.join(least, "u"), least


FEW_EDGES = 1 << 18  # at most so many edges are brought to the driver (16 bytes each)


def _followed(u: np.ndarray, v: np.ndarray) -> pa.Table:
    """node, comp by hooking larger roots to smaller ones and shortening paths."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return pa.table({"node": nodes, "comp": nodes[root]})
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, comp (the least node of its component) for every node of `edges` (u, v longs)."""
    e = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    if e.count() <= FEW_EDGES:
        got = e.toArrow()
        drop(e)
        found = _followed(got["u"].to_numpy(), got["v"].to_numpy())
        return cut(edges.sparkSession.createDataFrame(found), "cc-followed")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, least = _star(both)
        large = met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = cut(large.distinct(), "cc-large")
        drop(e, least)
        met, least = _star(large)  # here every u > v
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct(), "cc-small")
        drop(large, least)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)
