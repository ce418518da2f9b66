"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code point order, null last, weigh 3, 1, 2, repeating, and share BUDGET times all
sizes; a target stops at CAP times its source's size and the excess is shared again by weight.
In closed form: with sources by rising CAP * size / weight, those below the common water level
are full and the others get weight times the level.

A document's expected copies are target / source size; the whole part is taken as it is, the
fraction is rounded. Documents meet in pairs and one randomly gives words to the other until
one fraction is 0 or 1, which keeps each pair's expected words; the other goes on. Every
(source, hash bucket) group leaves at most one residual; residuals meet in groups of FAN_IN
buckets, level by level, until a source has one. That last one is rounded to the nearer side,
not drawn: so a source's words differ from its target by at most half that document, at the
price of a bias in the chance of this one document. Groups take large documents first, which
tends to leave a small one.

Draws and buckets are hashes of the seed, the ids and, for rows that are equal in ids, size and
source, their number among the equal ones; so reruns agree up to swaps of such rows, and
buckets have a bounded expected size however many rows share an id or have none.

Defined results: null text has size 0 and takes 0; a source of size 0 has target 0; rows that
repeat are documents each; a null doc_id is hashed as null; very long texts count whole; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U, cut, mix64, table, word_count

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2.0
GROUP_DOCS = 4096
FAN_IN = 64
SEED = 31


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """sizes (source, source_size) with target. Windows run over one row a source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), (rank - 1) % len(weights))
    rows = sizes.select("source", "source_size", w.alias("w")).withColumn("full", F.col("source_size") * cap)
    by_level = Window.orderBy(F.col("full") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * budget)
    level = (F.col("total") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level)
    open_ = F.col("full") / F.col("w") >= F.col("level")
    water = F.max(F.when(open_, F.col("level"))).over(everything)  # the level of the first that stays open
    target = F.least(F.col("full"), F.coalesce(F.col("w") * water, F.col("full")))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def pivot(draws: np.ndarray, size: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, int]:
    """Round fractions p of documents by pairs, in the order given. draws: a number from 0 to 1 for
    each document, used when it meets what is left of those before. Returns the fractions, all
    0 or 1 but at most one, and its index (-1: none)."""
    p = p.copy()
    last = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if last < 0:
            last = j
            continue
        i = last
        mi, mj = size[i] * p[i], size[j] * p[j]
        to_i, to_j = min(size[i] - mi, mj), min(size[j] - mj, mi)
        if draws[j] * (to_i + to_j) < to_j:  # i gains with probability to_j / (to_i + to_j)
            i_full, j_empty = size[i] - mi <= mj, mj <= size[i] - mi
            p[i], p[j] = (1.0 if i_full else (mi + to_i) / size[i]), (0.0 if j_empty else (mj - to_i) / size[j])
        else:
            j_full, i_empty = size[j] - mj <= mi, mi <= size[j] - mj
            p[j], p[i] = (1.0 if j_full else (mj + to_j) / size[j]), (0.0 if i_empty else (mi - to_j) / size[i])
        last = next((x for x in (i, j) if 0.0 < p[x] < 1.0), -1)
    return p, last


def _level(t: pa.Table) -> pa.Table:
    key = t["key"].to_numpy().view(U)
    size = t["size"].to_numpy().astype(float)
    order = np.lexsort((key, -size))  # large documents first, so that a small one is left over
    p = t["p"].to_numpy().copy()
    with np.errstate(over="ignore"):
        draws = (mix64(key[order] + U(SEED + int(t["level"][0].as_py()))) >> U(11)).astype(float) * 2.0**-53
    p[order], _ = pivot(draws, size[order], p[order])
    return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p))


def number_equals(rows: DataFrame) -> DataFrame:
    """rows (row, c, ...) with nth: the number of a row among those of equal c, from 0. Rows of one c
    are numbered inside each part of the table (the upper bits of `row`) and the parts' numbers
    added up, so a c that very many rows share isn't sorted in one task."""
    part = F.shiftright("row", 33)
    counts = rows.groupBy("c", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    shared = cut(counts.groupBy("c").agg(F.sum("n").alias("n")).filter("n > 1").select("c"), "equals")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(shared, "c").select("c", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("c", "part").orderBy("row")) - 1
    several = rows.join(shared, "c").select("row", "c", part.alias("part")).withColumn("inside", inside)
    numbered = several.join(starts, ["c", "part"]).select("row", (F.col("start") + F.col("inside")).alias("nth"))
    return rows.join(cut(numbered, "numbers"), "row", "left").withColumn("nth", F.coalesce("nth", F.lit(0)))


def mix(sized: DataFrame, ids: tuple[str, ...] = ("doc_id",), group_docs: int = GROUP_DOCS, fan_in: int = FAN_IN, carry: tuple[str, ...] = ()) -> DataFrame:
    """sized (ids, carry, size, source) with source_size, target and copies, one row per row. `ids`
    seed the draws; `carry` columns are handed on."""
    both = (*ids, *carry)
    sized = sized.select(
        F.struct(*both).alias("id"),
        F.col("size").cast("long").alias("size"),
        F.col("source").cast("string").alias("source"),
        F.xxhash64(*ids, "size", F.coalesce("source", F.lit("")), F.col("source").isNull()).alias("c"),
        F.monotonically_increasing_id().alias("row"),
    )
    sized = cut(sized, "sizes")
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_source = cut(by_source, "source-sizes")
    goal = targets(by_source).withColumnRenamed("source", "s")
    counts = by_source.select(F.col("source").alias("of"), F.ceil(F.col("n") / group_docs).alias("groups"))
    known = cut(goal.join(counts, F.col("s").eqNullSafe(F.col("of"))).drop("of"), "goals")
    rows = number_equals(sized).join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.xxhash64("c", "nth", F.lit(SEED))
    rows = rows.withColumn("whole", F.floor(share)).withColumn("p", F.when(F.col("size") > 0, share - F.floor(share)).otherwise(0.0))
    rows = rows.withColumn("key", key).withColumn("g", F.pmod("key", "groups")).drop("groups", "c", "row", "nth")
    rows = rows.withColumn("level", F.lit(0))
    most = known.agg(F.max("groups")).first()[0] or 0
    done = []
    width = int(most)
    while True:
        grouped = rows.groupBy("source", "g").applyInArrow(_level, rows.schema)
        rows = cut(grouped, "mix-level")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rows.filter(~open_))
        rows = rows.filter(open_)
        if width <= 1:
            break
        width = -(-width // fan_in)
        rows = rows.withColumn("g", F.floor(F.col("g") / fan_in)).withColumn("level", F.col("level") + 1)
    out = rows.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0))
    for part in done:
        out = out.unionByName(part)
    return out.select("id.*", "size", "source", "source_size", "target", (F.col("whole") + F.col("p")).cast("int").alias("copies"))


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", word_count(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(sized_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def targets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the operator's result that SQL can express: all but the words taken."""
    return query(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


#: Targets as the level L at which the sum of least(full, w * L) is the budget, looked for between
#: the levels at which sources become full.
TARGETS_ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS full_size,
         [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST)) - 1) % 3 + 1] AS w
  FROM d GROUP BY source
), b AS (SELECT 1.5 * sum(source_size) AS budget FROM s),
k AS (  -- words given out when the level is where source k becomes full
  SELECT k.full_size / k.w AS level, sum(least(s.full_size, s.w * k.full_size / k.w)) AS given,
         sum(CASE WHEN s.full_size / s.w < k.full_size / k.w THEN 0 ELSE s.w END) AS open_w
  FROM s k, s GROUP BY k.source, k.full_size, k.w
), l AS (
  SELECT min_by(level - (given - budget) / open_w, level) AS level FROM k, b WHERE given >= budget
)
SELECT doc_id, size::BIGINT AS size, source_size, round(least(full_size, w * level), 6) AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l
"""
