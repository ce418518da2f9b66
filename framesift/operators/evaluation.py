"""Ranking and preference metrics, and the integrity rules of labelled sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import vectors as V
from . import knn

TIE = 1e-6
DEPTH = 10


def preference_metrics(margins: DataFrame, *sets: list[str]) -> DataFrame:
    """n, wins, losses, ties, accuracy (wins / n), tie_rate, over all rows and over each grouping
    set, from column `margin`. `grouping` tells the sets apart."""
    columns = [c for s in sets for c in s]
    aggs = (
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("margin") > TIE).alias("wins"),
        F.count_if(F.col("margin") < -TIE).alias("losses"),
        F.count_if(F.abs("margin") <= TIE).alias("ties"),
    )
    if columns:
        out = margins.groupingSets([[], *[[F.col(c) for c in s] for s in sets]], *[F.col(c) for c in columns]).agg(*aggs, F.grouping_id().alias("grouping"))
    else:
        out = margins.agg(*aggs)
    return out.filter("n > 0").withColumn("accuracy", F.col("wins") / F.col("n")).withColumn("tie_rate", F.col("ties") / F.col("n"))


def ranking_rows(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, precision_at_10 (over the constant 10), top1, random_expected, from matches
    (query_id, image_id, rank) and labels (id, label)."""
    n = labels.agg(F.count(F.lit(1)).alias("_n"))
    sized = labels.withColumn("_same", F.count(F.lit(1)).over(Window.partitionBy("label"))).join(F.broadcast(n))  # one row
    q = sized.select(F.col("id").alias("query_id"), F.col("label").alias("_ql"), ((F.col("_same") - 1) / (F.col("_n") - 1)).alias("random_expected"))
    c = labels.select(F.col("id").alias("image_id"), F.col("label").alias("_cl"))
    hit = F.when(F.col("_ql") == F.col("_cl"), 1).otherwise(0)
    met = matches.filter(F.col("rank") <= DEPTH).join(q, "query_id").join(c, "image_id")
    return met.groupBy("query_id").agg(
        (F.sum(hit) / F.lit(float(DEPTH))).alias("precision_at_10"),
        F.max(F.when(F.col("rank") == 1, hit)).cast("int").alias("top1"),
        F.first("random_expected").alias("random_expected"),
    )


def manifest_violations(manifest: dict, images: DataFrame, pairs: DataFrame, version: str, files: dict[str, str]) -> list[str]:
    """What is wrong with a manifest: its status, generator version, the checksums of its label files
    (`files`: as they are now), or its counts."""
    found = []
    if manifest.get("status") != "complete" or manifest.get("config", {}).get("generator_version") != version:
        found.append("incomplete or of another version")
    if manifest.get("files") != files:
        found.append("label files changed")
    n = images.count()
    if not n or n != manifest.get("image_count") or pairs.count() != manifest.get("pair_count"):
        found.append("counts differ")
    return found


def label_violations(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """rule, n for the rules that images (id, path, split, family_id, layout_id, subject,
    appearance, geometry) and pairs (split, query, positive, negative) break. A path must stay
    inside images/<split>/."""
    found = []

    def rule(name: str, df: DataFrame) -> None:
        found.append(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n"))

    rule("repeated id", images.groupBy("id").count().filter("count > 1"))
    rule("repeated path", images.groupBy("path").count().filter("count > 1"))
    rule("unknown split", images.filter("split not in ('dev', 'test') or split is null"))
    inside = S.is_contained(F.col("path")) & F.col("path").startswith(F.concat(F.lit("images/"), F.col("split"), F.lit("/")))
    rule("path outside its split", images.filter(~F.coalesce(inside, F.lit(False))))
    rule("family in two splits", images.groupBy("family_id").agg(F.countDistinct("split").alias("k")).filter("k > 1"))
    rule("layout with two geometries", images.groupBy("layout_id").agg(F.countDistinct("split", "geometry").alias("k")).filter("k > 1"))
    rule("geometry in two splits", images.groupBy("geometry").agg(F.countDistinct("split").alias("k")).filter("k > 1"))
    ids = images.select("id")
    for side in ("query", "positive", "negative"):
        rule(f"pair with unknown {side}", pairs.join(ids, pairs[side] == ids["id"], "left_anti"))

    def of(side: str) -> DataFrame:
        return images.select(*(F.col(c).alias(f"{side}_{c}") for c in ("id", "split", "layout_id", "subject", "appearance")))

    met = pairs.join(of("query"), F.col("query") == F.col("query_id"))
    met = met.join(of("positive"), F.col("positive") == F.col("positive_id")).join(of("negative"), F.col("negative") == F.col("negative_id"))
    rule("pair across splits", met.filter("not (split = query_split and split = positive_split and split = negative_split)"))
    rule("positive of another layout or the same subject", met.filter("positive_layout_id <> query_layout_id or positive_subject = query_subject"))
    rule("negative of the same layout or another look", met.filter("negative_layout_id = query_layout_id or negative_subject <> query_subject or negative_appearance <> query_appearance"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.filter("n > 0")


SMALLEST_SPLIT = DEPTH + 1


def split_of(rows: DataFrame, split: str) -> list[tuple[str, DataFrame]]:
    """(name, rows) of the splits asked for: dev, test, or all for both."""
    if split not in ("dev", "test", "all"):
        raise ValueError("split must be dev, test or all")
    return [(s, rows.filter(F.col("split") == s)) for s in (("dev", "test") if split == "all" else (split,))]


def evaluate_split(images: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rankings, pair outcomes and metrics of one split from images (id string, layout_id,
    embedding) and its pairs. Candidates are numbered in id order, which decides ties; the query
    itself is left out, and another picture of its layout is a hit."""
    if images.limit(SMALLEST_SPLIT).count() < SMALLEST_SPLIT or pairs.isEmpty():
        raise ValueError(f"a split needs {SMALLEST_SPLIT} images at least, and pairs")
    numbered = images.select("id", "layout_id", "embedding").withColumn("number", F.row_number().over(Window.orderBy("id")).cast("long"))  # a benchmark's images
    v = numbered.select(F.col("number").alias("id"), "embedding")
    matches = knn.top_k(v, v, DEPTH, exclude_self=True)
    rows = ranking_rows(matches, numbered.select(F.col("number").alias("id"), F.col("layout_id").alias("label")))
    names = numbered.select("number", F.col("id").alias("name"))
    rankings = rows.join(names, rows["query_id"] == names["number"]).select(F.col("name").alias("query"), "precision_at_10", "top1", "random_expected")

    def side(role: str) -> DataFrame:
        return images.select(F.col("id").alias(role), F.col("embedding").alias(f"{role}_vector"))

    met = pairs
    for role in ("query", "positive", "negative"):
        met = met.join(side(role), role)
    score = {r: V.dot(F.col("query_vector"), F.col(f"{r}_vector")) for r in ("positive", "negative")}
    outcomes = met.select(*pairs.columns, *(c.alias(f"{r}_score") for r, c in score.items()))
    outcomes = outcomes.withColumn("margin", F.col("positive_score") - F.col("negative_score"))
    return rankings, outcomes, preference_metrics(outcomes, ["change"], ["positive_change"])
