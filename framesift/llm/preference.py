"""Chat formatting [native]: preference pairs with a shared prompt and masked completions.

A pair is two turn sequences, chosen and rejected. Their longest common prefix of turns (equal
role and text at the same turn number) is rendered once, as the prompt; what follows is
rendered for each side as its completion. Each rendered turn carries the span that counts for
training: an assistant turn's text and end mark within a completion, nothing elsewhere.

The form is relational, one row a rendered turn, so a conversation of any length never has to
meet in one task: turns of the two sides meet by (pair, turn), and the first difference of a
pair is a minimum, aggregated map-side. assemble() joins the rows to whole strings where pairs
fit a row. DataFrame functions only.

Defined results: rows with a null pair or turn are left out; of rows with the same pair and
turn the least (role, text) counts; null role or text compare as equal to null and render as
empty; equal sides are all prompt, with empty completions; a side without rows gives only the
other's completion; very long texts are rendered whole; extra columns are ignored; empty tables
give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _side(turns: DataFrame, side: int) -> DataFrame:
    kept = turns.filter("pair_id is not null and turn is not null")
    return kept.select("pair_id", "turn", F.lit(side).alias("side"), F.struct("role", "text").alias("t"))


def header(role: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit("\n"))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, part (prompt, chosen, rejected), turn, role, rendered, mask_start, mask_end from
    two tables of (pair_id, turn, role, text). The mask is a half-open range of characters of
    `rendered`; an empty one trains nothing."""
    both = _side(chosen, 0).unionByName(_side(rejected, 1))
    met = both.groupBy("pair_id", "turn").agg(
        F.min(F.when(F.col("side") == 0, F.col("t"))).alias("c"), F.min(F.when(F.col("side") == 1, F.col("t"))).alias("r")
    )
    met = cut(met.withColumn("same", F.col("c").eqNullSafe(F.col("r"))), "met-turns")
    split = met.groupBy("pair_id").agg(F.min(F.when(~F.col("same"), F.col("turn"))).alias("split"))
    rows = met.join(split, "pair_id")
    shared = F.col("split").isNull() | (F.col("turn") < F.col("split"))

    def part(name: str, t: Column) -> Column:
        return F.struct(F.lit(name).alias("part"), t["role"].alias("role"), t["text"].alias("text"))

    parts = F.when(shared, F.array(part("prompt", F.col("c")))).otherwise(
        F.filter(
            F.array(F.when(F.col("c").isNotNull(), part("chosen", F.col("c"))), F.when(F.col("r").isNotNull(), part("rejected", F.col("r")))),
            lambda x: x.isNotNull(),
        )
    )
    out = rows.select("pair_id", "turn", F.explode(parts).alias("p")).select("pair_id", "turn", "p.*")
    head, body = header(F.col("role")), F.concat(F.coalesce("text", F.lit("")), F.lit(CLOSE))
    trained = (F.col("part") != "prompt") & F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False))
    start = F.length(head)
    return out.select(
        "pair_id",
        "part",
        "turn",
        "role",
        F.concat(head, body, F.lit("\n")).alias("rendered"),
        start.alias("mask_start"),
        F.when(trained, start + F.length(body)).otherwise(start).alias("mask_end"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected and the masks of both completions as spans of their
    strings, for pairs that fit a row."""
    one = segments.groupBy("pair_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "rendered", "mask_start", "mask_end"))).alias("s"))

    def text(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: x["rendered"]), "")

    def spans(s: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("m"))

        def step(acc: Column, x: Column) -> Column:
            span = F.struct((acc["at"] + x["mask_start"]).alias("start"), (acc["at"] + x["mask_end"]).alias("end"))
            grown = F.when(x["mask_end"] > x["mask_start"], F.concat(acc["m"], F.array(span))).otherwise(acc["m"])
            return F.struct((acc["at"] + F.length(x["rendered"])).alias("at"), grown.alias("m"))

        return F.aggregate(s, first, step, lambda acc: acc["m"])

    def of(part: str, value: Column) -> Column:
        return F.max(F.when(F.col("part") == part, value))

    one = one.select("pair_id", "part", text(F.col("s")).alias("text"), spans(F.col("s")).alias("mask"))
    return one.groupBy("pair_id").agg(
        *(F.coalesce(of(p, F.col("text")), F.lit("")).alias(p) for p in ("prompt", "chosen", "rejected")),
        of("chosen", F.col("mask")).alias("chosen_mask"),
        of("rejected", F.col("mask")).alias("rejected_mask"),
    )


def stale_reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from plain conversations: chosen is a conversation up to its last
    assistant turn; in rejected that turn repeats the assistant's turn before it, or else the
    first user turn, or nothing. Conversations without an assistant turn give no pair."""
    turns = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text").filter("pair_id is not null and turn is not null")
    spoken = F.col("role") == TRAINED_ROLE
    order = F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))
    ends = turns.groupBy("pair_id").agg(F.max(F.when(spoken, F.col("turn"))).alias("last"), F.min(F.when(F.col("role") == "user", order)).alias("asked"))
    chosen = cut(turns.join(ends.select("pair_id", "last"), "pair_id").filter("turn <= last"), "chosen-turns")
    before = chosen.filter(spoken & (F.col("turn") < F.col("last"))).groupBy("pair_id").agg(F.max(order).alias("before"))
    asked = F.when(F.col("asked.turn") <= F.col("last"), F.col("asked.text"))
    reply = (
        ends.filter("last is not null")
        .join(before, "pair_id", "left")
        .select("pair_id", F.col("last").alias("turn"), F.lit(TRAINED_ROLE).alias("role"), F.coalesce("before.text", asked, F.lit("")).alias("text"))
    )
    rejected = chosen.filter("turn < last").drop("last").unionByName(reply)
    return chosen.drop("last"), rejected


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rendered turn of every pair, with its part and mask: in order of turns, the prompt and
    both completions as they are fed to training."""
    return preference_segments(*stale_reply_pairs(table(spark, sf_dir, "conversations")))


ORACLE = f"""
WITH t AS (
  SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), c AS (
  SELECT * FROM (SELECT *, max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY pair_id) AS last FROM t)
  WHERE turn <= last
), f AS (
  SELECT pair_id, last AS turn, 'assistant' AS role,
         coalesce(arg_max(text, turn) FILTER (role = 'assistant' AND turn < last),
                  arg_min(text, turn) FILTER (role = 'user'), '') AS text
  FROM c GROUP BY pair_id, last
), r AS (
  SELECT pair_id, turn, role, text FROM c WHERE turn < last UNION ALL SELECT * FROM f
), m AS (
  SELECT c.pair_id, c.turn, c.role AS c_role, c.text AS c_text, r.role AS r_role, r.text AS r_text,
         (c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text) AS same
  FROM c JOIN r ON c.pair_id = r.pair_id AND c.turn = r.turn
), p AS (
  SELECT *, coalesce(turn < min(CASE WHEN NOT same THEN turn END) OVER (PARTITION BY pair_id), true) AS shared FROM m
), s AS (
  SELECT pair_id, turn, 'prompt' AS part, c_role AS role, c_text AS text FROM p WHERE shared
  UNION ALL SELECT pair_id, turn, 'chosen', c_role, c_text FROM p WHERE NOT shared
  UNION ALL SELECT pair_id, turn, 'rejected', r_role, r_text FROM p WHERE NOT shared
), g AS (
  SELECT pair_id, turn, part, role,
         '{OPEN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{CLOSE}' || chr(10) AS rendered,
         length('{OPEN}' || coalesce(role, '') || chr(10))::INTEGER AS mask_start,
         length('{OPEN}' || coalesce(role, '') || chr(10))
           + CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(coalesce(text, '') || '{CLOSE}') ELSE 0 END AS mask_end
  FROM s
)
SELECT pair_id, part, turn, role, rendered, mask_start, mask_end::INTEGER AS mask_end FROM g
"""
