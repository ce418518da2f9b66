"""Exact top-k search: KD-trees per shard with best-first traversal.

Vectors become integer points floor(1024 x). Candidates are dealt to shards and queries to blocks,
both of bounded size, and every shard meets every block in a task of its own: nothing is
collected by the driver, and the plan has the same form for any number of queries. A shard is
cut into KD-trees: median splits on the widest side, tight bounding boxes. A query walks a tree
best first: the bound of a box is the largest inner product a point in it can have, and the walk
ends when no open box can beat the kth score. That kth score is propagated from tree to tree of
a shard, and a pilot shard, searched before the others, gives every shard a starting value, so
that shards return only what can still rank. A grouped top-k merges them.

Defined results: vectors that are null or hold a null or non-finite component take no part,
nor do rows with a null vec_id; components beyond a long are clipped to it; vectors meet only
vectors of their own length, however long; a repeated row is a candidate as often as it occurs
and one query; ties go to the smaller vec_id; scores beyond a long are clipped to it; extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, table

SCALE = 1024
TREE_ROWS = 8192  # candidates of one tree
LEAF_ROWS = 256
SHARD_ROWS = 1 << 16  # candidates of one shard
BLOCK_ROWS = 1 << 13  # queries of one block
CELL_BYTES = 64 << 20  # bound on a shard's and on a block's numbers
EVERY = 100
K = 10
_LONG = (1 << 63) - 1


def product(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """a @ b of integers held as doubles; where doubles can't hold it, through Python integers and
    clipped to a long."""
    if exact:
        return a @ b
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b), -_LONG - 1, _LONG)


class Tree:
    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> None:
        """Nodes in arrays: boxes lo and hi, the smallest id below, children or a row range."""
        self.lo: list[np.ndarray] = []
        self.hi: list[np.ndarray] = []
        self.least: list[int] = []
        self.kids: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        order = np.arange(len(ids))
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = order[a:b]
            part = rows[own]
            me = len(self.lo)
            self.lo.append(part.min(axis=0))
            self.hi.append(part.max(axis=0))
            self.least.append(int(ids[own].min()))
            self.kids.append(None)
            self.span.append((a, b))
            if parent >= 0:
                left, right = self.kids[parent] or (0, 0)
                self.kids[parent] = (me, right) if side == 0 else (left, me)
            if b - a > leaf and (width := self.hi[me] - self.lo[me]).max(initial=0) > 0:
                axis, mid = int(width.argmax()), (b - a) // 2
                order[a:b] = own[np.argpartition(part[:, axis], mid)]
                self.kids[me] = (0, 0)
                stack.append((a + mid, b, me, 1))
                stack.append((a, a + mid, me, 0))
        self.ids, self.rows = ids[order], rows[order]
        self.top = float(np.abs(rows).max(initial=0))
        self.box_hi, self.box_lo = np.array(self.hi), np.array(self.lo)

    def bounds(self, q: np.ndarray, exact: bool) -> np.ndarray:
        """[query, node]: the most a point in the box can score."""
        return product(np.maximum(q, 0), self.box_hi.T, exact) + product(np.minimum(q, 0), self.box_lo.T, exact)

    def search(self, q: np.ndarray, own: int, bound: np.ndarray, best: list[tuple], k: int, exact: bool) -> None:
        """Best-first walk; `best` is a min-heap of (score, -id) carried on from other trees. With
        no k entries yet its floor is whatever the caller put in front."""
        heap = [(-bound[0], self.least[0], 0)]
        while heap:
            up, least, node = heapq.heappop(heap)
            if len(best) >= k and (-up, -least) <= best[0]:
                if -up < best[0][0]:
                    return  # nor can any box still open
                continue
            if (kids := self.kids[node]) is not None:
                for x in kids:
                    if len(best) < k or (bound[x], -self.least[x]) > best[0]:
                        heapq.heappush(heap, (-bound[x], self.least[x], x))
                continue
            a, b = self.span[node]
            score = product(self.rows[a:b], q, exact)
            ids = self.ids[a:b]
            ok = ids != own
            if len(best) >= k:
                ok &= score >= best[0][0]
            for i in np.flatnonzero(ok):
                x = (score[i], -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, x)
                elif x > best[0]:
                    heapq.heapreplace(best, x)


def integer_points(df: DataFrame) -> DataFrame:
    """vec_id, v array<double> of whole numbers; only rows that take part."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * F.lit(float(SCALE))).cast("double"))
    fine = F.forall(
        F.col("embedding").cast("array<double>"),
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )
    return df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")
    )


def _by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: places in the column, and the vectors as rows."""
    lists = vectors.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    start = np.cumsum(size) - size
    return {
        int(d): (at := np.flatnonzero(size == d), flat[start[at][:, None] + np.arange(d)].astype(float)) for d in np.unique(size)
    }


RESULT = "slot long, query_id long, vec_id long, score long"


def _cell(k: int):
    """applyInArrow body: trees over a shard, every query of a block against each."""

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if shard.num_rows and block.num_rows:
            ids, own, slot = (t[c].to_numpy() for t, c in ((shard, "vec_id"), (block, "vec_id"), (block, "slot")))
            floor_score, floor_id = block["floor_score"].to_pylist(), block["floor_id"].to_pylist()
            candidates = _by_length(shard["v"])
            for dim, (mine, q) in _by_length(block["v"]).items():
                if dim not in candidates:
                    continue
                place, rows = candidates[dim]
                best: list[list[tuple]] = [[] for _ in mine]
                for at in range(0, len(place), TREE_ROWS):
                    tree = Tree(ids[place[at : at + TREE_ROWS]], rows[at : at + TREE_ROWS])
                    exact = tree.top * float(np.abs(q).max(initial=0)) * dim < 2.0**52
                    for a in range(0, len(mine), 256):
                        bound = tree.bounds(q[a : a + 256], exact)
                        for j, i in enumerate(mine[a : a + 256]):
                            if floor_id[i] is not None and (bound[j][0], -tree.least[0]) < (floor_score[i], -floor_id[i]):
                                continue  # the kth of the pilot is better than all of this tree
                            tree.search(q[a + j], int(own[i]), bound[j], best[a + j], k, exact)
                for i, heap in zip(mine, best, strict=True):
                    least = None if floor_id[i] is None else (floor_score[i], -floor_id[i])
                    out += [(int(slot[i]), int(own[i]), -x[1], int(x[0])) for x in heap if least is None or x >= least]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({c.split()[0]: pa.array(x, pa.int64()) for c, x in zip(RESULT.split(", "), columns, strict=True)})

    return run


def _met(shards: DataFrame, blocks: DataFrame, cells: int, k: int) -> DataFrame:
    """Partial results of every (shard, block) that has both."""
    a, b = (df.repartition(cells, "shard", "block").groupBy("shard", "block") for df in (shards, blocks))
    return a.cogroup(b).applyInArrow(_cell(k), RESULT)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK_ROWS, shard: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query. Both inputs have vec_id and
    v as integer_points() gives them."""
    sc = candidates.sparkSession.sparkContext
    rows = cut(candidates.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "candidates")
    asked = cut(queries.select("vec_id", "v").distinct().withColumn("slot", F.monotonically_increasing_id()), "queries")
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_queries = asked.count()
    fits = max(1, CELL_BYTES // (8 * max(longest or 1, 1)))
    shards = max(1, -(-n // min(shard, fits)), min(-(-n // TREE_ROWS), sc.defaultParallelism))
    blocks = max(1, -(-n_queries // min(block, fits)))
    asked = asked.withColumn("block", F.pmod("slot", F.lit(blocks)))
    nothing = {"floor_score": F.lit(None).cast("long"), "floor_id": F.lit(None).cast("long")}
    pilot = rows.filter(F.pmod(F.xxhash64("row"), F.lit(-(-n // min(TREE_ROWS, fits)) or 1)) == 0)

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    first = _met(
        pilot.select("vec_id", "v", F.lit(0).cast("long").alias("shard"), each(blocks).alias("block")),
        asked.select("vec_id", "v", "slot", "block", F.lit(0).cast("long").alias("shard")).withColumns(nothing),
        blocks,
        k,
    )
    floors = _ranked(first, k).filter((F.col("rank") == k) & (F.abs("score") < 1 << 62)).select("slot", F.col("score").alias("floor_score"), F.col("vec_id").alias("floor_id"))
    asked = cut(asked.join(floors, "slot", "left"), "asked")
    found = _met(
        rows.select("vec_id", "v", F.pmod("row", F.lit(shards)).alias("shard"), each(blocks).alias("block")),
        asked.withColumn("shard", each(shards)),
        shards * blocks,
        k,
    )
    best = cut(_ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top-k")
    drop(rows, asked)
    return best


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = integer_points(table(spark, sf_dir, "embeddings"))
    return top_k(points, points.filter(F.col("vec_id") % EVERY == 0))


def _valid(c: str) -> str:
    return f"list_bool_and(list_transform({c}, lambda x: x IS NOT NULL AND isfinite(x)))"


ORACLE = f"""
WITH p AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND coalesce({_valid('embedding')}, true)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM p q JOIN p c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % {EVERY} = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
