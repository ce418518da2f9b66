"""Quality rules [native]: hashed n-gram log-likelihood ratio with base rules.

Each word 1-gram and 2-gram of a text is hashed into a fixed number of buckets. Two
multinomials over the buckets are estimated: one over trusted documents (label 1, a bounded
sample in hash order), one over the whole raw corpus. A document's score is the mean over its
n-grams of log p_target - log p_raw; it is kept when the base rules hold and the score reaches
a fixed threshold. DataFrame functions only, no Python on the executors.

Plan: two scans. The first explodes bucket numbers and counts them (partial aggregation leaves
at most BUCKETS rows a task); the second joins the bounded weight table by broadcast and sums
by row, also map-side. Texts are never shuffled.

Defined results: null or empty text has no words and fails the base rules; rows that repeat
are scored each for itself; a null doc_id is kept as null; very long texts count whole; extra columns are ignored; without
trusted documents the score is null and the base rules alone decide; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table, words_of

ORDER_BUCKETS = 1 << 16  # buckets for each n-gram order; two orders
TRUSTED_DOCS = 20_000  # bound on trusted documents, smallest hash of doc_id first
SMOOTHING = 1.0
THRESHOLD = -0.25  # mean log-ratio a kept document must reach

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"


def _repeat_words(windows: Column) -> Column:
    """Words covered by 5-word windows that occur twice or more in an array of window hashes."""

    def covered(pairs: Column) -> Column:
        again = F.filter(
            pairs,
            lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"]),
        )
        at = F.sort_array(F.transform(again, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            at,
            start,
            lambda acc, p: F.struct(
                (p + 5).alias("end"), (acc["n"] + 5 - F.greatest(F.lit(0), acc["end"] - p)).alias("n")
            ),
            lambda acc: acc["n"],
        )

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    bound = F.transform(F.array(ordered), covered)  # binds the sorted array once
    distinct = F.size(F.array_distinct(windows)) == F.size(windows)
    return F.when(distinct, F.lit(0)).otherwise(F.coalesce(F.get(bound, F.lit(0)), F.lit(0))).cast("long")


def base_features(docs: DataFrame) -> DataFrame:
    """doc_id, text-free features, the base verdict and word hashes `hs`, one row per input row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w)).alias("hs"),
    )
    hashed = hashed.withColumn("bs", bigrams(F.col("hs")))
    windows = F.transform(
        F.slice("bs", F.lit(1), F.greatest(F.size("hs") - 4, F.lit(0))),
        lambda b, i: F.xxhash64(b, F.get("bs", i + 2), F.get("hs", i + 4)),
    )
    seen = hashed.select(
        "rid",
        "doc_id",
        F.size("hs").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        "hs",
        "bs",
    )
    out = seen.withColumn("n_repeat_words", _repeat_words(F.col("windows"))).drop("windows")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def bigrams(hs: Column) -> Column:
    """Hashes of neighbouring pairs of an array of word hashes."""
    return F.transform(
        F.slice(hs, F.lit(1), F.greatest(F.size(hs) - 1, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(hs, i + 1))
    )


def bucket_of(h: Column, i: Column, ones: Column) -> Column:
    """Bucket of the i-th hash of an array of `ones` 1-gram hashes followed by 2-gram hashes."""
    return (F.shiftrightunsigned(h, 48) + F.when(i < ones, 0).otherwise(ORDER_BUCKETS)).cast("int")


def bucket_weights(docs: DataFrame, trusted_ids: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """bucket int, w double: log p_target - log p_raw, written to scratch (at most 2 * ORDER_BUCKETS
    rows). Empty without trusted n-grams. `trusted_ids` must be bounded; it is broadcast."""
    hs = F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))
    hashed = docs.select(F.col("doc_id").alias("_d"), hs.alias("hs")).withColumn("bs", bigrams(F.col("hs")))
    flagged = hashed.join(
        F.broadcast(trusted_ids.select(F.col("doc_id").alias("_t"), F.lit(1).alias("hit"))),
        F.col("_d") == F.col("_t"),
        "left",
    )
    counts = (
        flagged.select("hit", F.posexplode(F.concat("hs", "bs")).alias("i", "h"), (F.size("hs")).alias("ones"))
        .select("hit", bucket_of(F.col("h"), F.col("i"), F.col("ones")).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("hit").alias("t"), F.count(F.lit(1)).alias("r"))
    )
    counts = cut(counts, "llr-counts")
    total = counts.agg(F.sum("t").alias("t"), F.sum("r").alias("r")).first()
    if not total["t"]:
        return counts.select("bucket", F.lit(0.0).alias("w")).limit(0)
    size = 2 * ORDER_BUCKETS
    shift = F.log(F.lit((total["r"] + smoothing * size) / (total["t"] + smoothing * size)))
    return counts.select("bucket", (F.log(F.col("t") + smoothing) - F.log(F.col("r") + smoothing) + shift).alias("w"))


def score_rules(docs: DataFrame, weights: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The base features, `llr` (mean log-ratio; null without words or weights) and `kept`."""
    carried = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    spread = base_features(docs).select(
        "rid", *carried, F.size("hs").alias("ones"), F.posexplode_outer(F.concat("hs", "bs")).alias("i", "h")
    )
    spread = spread.withColumn("b", bucket_of(F.col("h"), F.col("i"), F.col("ones")))
    joined = spread.join(F.broadcast(weights), F.col("b") == F.col("bucket"), "left")
    scored = joined.groupBy("rid").agg(
        *(F.first(c).alias(c) for c in carried), F.sum("w").alias("s"), F.count("w").alias("n")
    )
    llr = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
    kept = ~F.col("base_failed") & F.coalesce(llr >= threshold, F.lit(True))
    return scored.select(*carried, llr.alias("llr"), kept.alias("kept"))


def trusted_sample(labels: DataFrame, bound: int = TRUSTED_DOCS) -> DataFrame:
    """At most `bound` ids labelled quality 1 and never 0, smallest hash first."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return known.filter("q = 1").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = bucket_weights(docs, trusted_sample(table(spark, sf_dir, "labels")))
    return score_rules(docs, weights)


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the operator's result that SQL can express: all but the verdict."""
    carried = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return query(spark, sf_dir).select(*carried)


BASE_ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d)
), g AS (
  SELECT rid, i, concat_ws(chr(1), w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS g,
         lead(w, 4) OVER o AS fifth
  FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
), again AS (
  SELECT rid, i FROM g WHERE fifth IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 5)) FROM again) GROUP BY rid
), words AS (
  SELECT rid, count(*) AS n, sum(length(w)) AS chars FROM w GROUP BY rid
), lines AS (
  SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), f AS (
  SELECT doc_id, coalesce(words.n, 0)::BIGINT AS n_words, coalesce(chars, 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN lines USING (rid) LEFT JOIN words USING (rid) LEFT JOIN covered USING (rid)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f
"""
