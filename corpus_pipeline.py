"""A training-corpus pipeline: quality, toxicity, near duplicates, mixture, pieces.

Each stage reads the documents its predecessor kept, whole, and all but the last return the
columns of documents. run() writes every stage as Parquet in the scratch folder and reads it
again, so no stage is computed twice and a lost executor costs one stage's tasks at most; what
a stage writes besides its result is deleted when the result is written. Empty tables give empty
results in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.llm import mixing, nbfeatures, ngram_join, pieces, quality_classifier, toxicity
from framesift.llm.common import cut, drop, scratch_scope, table, unused, word_count


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts get the bias's
    score; null ids aren't learned from; rows that repeat are judged alike; other columns pass
    through, whatever their names; without two classes of labels all texts are judged alike."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "quality_score")
    scored = docs.withColumn(score, nbfeatures.score_column(docs, model, quality_classifier.features))
    return scored.filter(F.col(score) >= quality_classifier.THRESHOLD).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; odd rows as in keep_quality()."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "toxic_score")
    scored = docs.withColumn(score, nbfeatures.score_column(docs, model, toxicity.features))
    return scored.filter(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of rows linked by shingle similarity: the least by doc_id (null last),
    then hash of the text, then the other columns. Rows count one by one, so rows that share an
    id fall into groups by their texts, and rows without an id are compared like others. Rows
    without a word are linked with nothing and all stay."""
    found = ngram_join.linked_rows(docs).filter("n > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least")
    first = cut(found.groupBy("comp").agg(least).select("least.doc_id", "least.text_hash"), "kept-rows")
    text_hash, nth, kept_id, kept_hash = (unused(docs, x) for x in ("text_hash", "nth", "kept_id", "kept_hash"))
    first = first.select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash))
    worded = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rest = [F.col(f"`{f.name}`") for f in docs.schema if f.name not in ("doc_id", "text") and "map<" not in f.dataType.simpleString()]
    among_equals = Window.partitionBy("doc_id", text_hash).orderBy(*rest, F.lit(0))
    single = docs.filter(worded).withColumn(text_hash, F.xxhash64(F.col("text").cast("string")))
    single = single.withColumn(nth, F.row_number().over(among_equals)).filter(F.col(nth) == 1)
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(text_hash) == F.col(kept_hash))
    kept = single.join(first, same, "left_semi").drop(text_hash, nth)
    return kept.unionByName(docs.filter(~worded))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mixture takes it: not at all, once or twice. Rows count one by one,
    also where they share an id or have none; null and empty texts have size 0 and are not taken
    unless their source's share is whole. Draws are seeded by id and text."""
    number, copies = unused(docs, "number"), unused(docs, "copies")
    numbered = cut(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    sized = numbered.select(
        F.col(number).alias("number"),
        "doc_id",
        F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
        word_count(F.col("text").cast("string")).alias("size"),
        F.col("source").cast("string").alias("source"),
    )
    taken = mixing.mix(sized, ids=("doc_id", "text_hash"), carry=("number",)).filter("copies > 0")
    taken = cut(taken.select(F.col("number").alias(number), F.col("copies").alias(copies)), "copies")
    out = numbered.join(taken, number)
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(number, copies)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, sampled piece_ids, their number, and whether they decode to the text.
    Null text gives null pieces, empty text none; draws are seeded by doc_id, null being a seed of
    its own, so rows that repeat are cut alike; other columns are left out, whatever their names."""
    out = pieces.encode_documents(docs.select("doc_id", "source", "lang", "text"))
    return out.select(
        "doc_id",
        "source",
        "lang",
        "piece_ids",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Learned, sampled and randomly rounded stages are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before = docs
        with scratch_scope(spark) as kept:
            docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            kept.append(docs)
        if i:
            drop(before)
    return docs
