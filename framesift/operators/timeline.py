"""Frame timelines: validity, shots, sampling targets and nearest-frame lookup.

Frames are (video_id, frame_number, ts); windows partition by video, so videos spread over
tasks. Ordering always has an explicit key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut


def _by_frame():
    return Window.partitionBy("video_id").orderBy("frame_number")


def usable_times(frames: DataFrame, fps: float) -> DataFrame:
    """ts as given if, over the whole video, all are finite, the first is not negative and they
    rise strictly; frame_number / fps for all frames otherwise. Adds `timestamp_source`."""
    before = F.lag("ts").over(_by_frame())
    good = F.col("ts").isNotNull() & ~F.isnan("ts") & (F.abs("ts") < float("inf")) & F.when(before.isNull(), F.col("ts") >= 0).otherwise(F.col("ts") > before)
    marked = frames.withColumn("_good", F.coalesce(good, F.lit(False)))
    every = F.min(F.col("_good")).over(Window.partitionBy("video_id"))
    return (
        marked.withColumn("timestamp_source", F.when(every, "presentation").otherwise("frame_rate"))
        .withColumn("ts", F.when(every, F.col("ts")).otherwise(F.col("frame_number") / F.lit(float(fps))))
        .drop("_good")
    )


def final_gap(frames: DataFrame, fps: float) -> DataFrame:
    """video_id, gap: the median of the last 30 frame gaps, or 1 / fps for a single frame."""
    rev = Window.partitionBy("video_id").orderBy(F.desc("frame_number"))
    gaps = frames.withColumn("_r", F.row_number().over(rev)).filter("_r <= 31")
    gaps = gaps.withColumn("_g", F.col("ts") - F.lag("ts").over(_by_frame()))
    return gaps.groupBy("video_id").agg(F.coalesce(F.percentile("_g", 0.5), F.lit(1.0 / fps)).alias("gap"))


def gap_stats(frames: DataFrame) -> DataFrame:
    gaps = frames.withColumn("_g", F.col("ts") - F.lag("ts").over(_by_frame())).filter("_g is not null")
    return gaps.groupBy("video_id").agg(
        F.count("_g").alias("n_gaps"),
        F.min("_g").alias("min_gap"),
        F.percentile("_g", 0.5).alias("median_gap"),
        F.percentile("_g", 0.95).alias("p95_gap"),
        F.max("_g").alias("max_gap"),
        F.min(F.col("_g") > 0).alias("increasing"),
    )


def shot_ids(frames: DataFrame, cut: Column) -> DataFrame:
    """frames with shot_id from 1: a new shot starts at each frame where `cut` holds (not at the
    first frame)."""
    first = F.row_number().over(_by_frame()) == 1
    starts = F.when(~first & F.coalesce(F.col("_cut"), F.lit(False)), 1).otherwise(0)
    numbered = frames.withColumn("_cut", cut).withColumn("_s", starts)
    return numbered.withColumn("shot_id", F.sum("_s").over(_by_frame()) + 1).drop("_cut", "_s")


def shots(numbered: DataFrame, fps: float) -> DataFrame:
    """video_id, shot_id, start_frame, end_frame (exclusive), start_seconds, end_seconds. A shot
    ends where the next begins; the last ends a final gap after its last frame."""
    each = numbered.groupBy("video_id", "shot_id").agg(
        F.min("frame_number").alias("start_frame"), (F.max("frame_number") + 1).alias("end_frame"), F.min("ts").alias("start_seconds"), F.max("ts").alias("_last")
    )
    after = F.lead("start_seconds").over(Window.partitionBy("video_id").orderBy("shot_id"))
    each = each.join(final_gap(numbered, fps), "video_id")
    return each.withColumn("end_seconds", F.coalesce(after, F.col("_last") + F.col("gap"))).drop("_last", "gap")


def targets(shots_: DataFrame, interval_seconds: float | None = None) -> DataFrame:
    """video_id, shot_id, target: the midpoint, and with an interval every step of it inside the
    shot, never more steps than frames."""
    base = shots_.withColumn("_mid", (F.col("start_seconds") + F.col("end_seconds")) / 2)
    if interval_seconds is None:
        return base.select("video_id", "shot_id", F.col("_mid").alias("target"))
    if not (interval_seconds > 0 and math.isfinite(interval_seconds)):
        raise ValueError("the interval must be a positive finite number of seconds")
    length = F.col("end_seconds") - F.col("start_seconds")
    spacing = F.greatest(F.lit(float(interval_seconds)), length / F.greatest(F.lit(1), F.col("end_frame") - F.col("start_frame")))
    steps = (F.ceil(length / F.col("_sp")) - 1).cast("int")
    base = base.withColumn("_sp", spacing).withColumn("_n", steps)
    walk = F.when(F.col("_n") >= 1, F.sequence(F.lit(1), F.col("_n"))).otherwise(F.array().cast("array<int>"))
    points = F.concat(F.array("_mid"), F.transform(walk, lambda s: F.col("start_seconds") + s * F.col("_sp")))
    return base.select("video_id", "shot_id", F.explode(points).alias("target"))


def nearest_frames(numbered: DataFrame, wanted: DataFrame) -> DataFrame:
    """video_id, shot_id, frame_number, ts: for each target the nearest frame of its shot, ties to
    the lower number, each frame once; times may repeat or fall back. Frames without a time are
    the farthest, and equally near to a target that has none. Targets and frames are merged in
    time order, once forwards and once backwards, and the frame met last is carried along, so
    cost doesn't grow with shot length times targets."""
    frames = numbered.groupBy("video_id", "shot_id", "ts").agg(F.min("frame_number").alias("frame_number"))
    frames = frames.select("video_id", "shot_id", "ts", F.struct("ts", "frame_number").alias("f"), F.lit(False).alias("is_target"))
    points = wanted.select("video_id", "shot_id", F.col("target").alias("ts"), F.lit(None).cast(frames.schema["f"].dataType).alias("f"), F.lit(True).alias("is_target"))
    shot = Window.partitionBy("video_id", "shot_id")
    seen = F.last("f", True)
    both = frames.unionByName(points)
    both = both.withColumn("a", seen.over(shot.orderBy("ts", "is_target").rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("b", seen.over(shot.orderBy(F.desc("ts"), F.desc("is_target")).rowsBetween(Window.unboundedPreceding, 0)))
    both = both.filter("is_target and (a is not null or b is not null)")
    before, after = F.col("ts") - F.col("a.ts"), F.col("b.ts") - F.col("ts")
    nearer = F.when(before < after, F.col("a")).when(after < before, F.col("b"))
    lower = F.when(F.col("a.frame_number") <= F.col("b.frame_number"), F.col("a")).otherwise(F.col("b"))
    pick = F.when(F.col("ts").isNull(), F.col("a")).when(before.isNull(), F.coalesce("b", "a")).when(after.isNull(), F.col("a")).otherwise(F.coalesce(nearer, lower))
    return both.withColumn("p", pick).select("video_id", "shot_id", "p.frame_number", "p.ts").distinct()


BLOCK_FRAMES = 1 << 20  # frames of a video of which one task holds the cuts


def enforce_min_gap(cuts: DataFrame, min_frames: int) -> DataFrame:
    """(video_id, frame_number) cuts at least `min_frames` after the last accepted one, or after
    the video's start. Blocks of a video run in parallel: each states, for every cut that may be
    its first accepted one, the frame from which the next block may accept; these few rows are
    followed from block to block, and then each block accepts its own cuts."""
    step, size = max(1, min_frames), max(BLOCK_FRAMES, min_frames)
    kind = cuts.schema["video_id"].dataType.simpleString()
    block = F.floor(F.col("frame_number") / F.lit(size)).cast("long")
    # floor of a quotient of doubles can't err below 2**53 frames
    cuts = cut(cuts.select("video_id", F.col("frame_number").cast("long").alias("frame_number")).filter("frame_number is not null").withColumn("block", block), "cuts")

    def following(c: np.ndarray) -> np.ndarray:
        return np.searchsorted(c, c + step)

    def summary(p: pd.DataFrame) -> pd.DataFrame:
        c = np.unique(p["frame_number"].to_numpy())
        until, after = (c + step).tolist(), following(c).tolist()
        for i in range(len(c) - 1, -1, -1):
            if after[i] < len(c):
                until[i] = until[after[i]]
        k = np.searchsorted(c, int(p["block"].iloc[0]) * size + step) + 1
        return pd.DataFrame({"video_id": p["video_id"].iloc[0], "block": p["block"].iloc[0], "first": c[:k], "until": until[:k]})

    def chain(p: pd.DataFrame) -> pd.DataFrame:
        at, rows = min_frames, []
        for block, q in p.sort_values(["block", "first"]).groupby("block"):
            rows.append((p["video_id"].iloc[0], block, at))
            k = np.searchsorted(q["first"].to_numpy(), at)
            at = int(q["until"].iloc[k]) if k < len(q) else at
        return pd.DataFrame(rows, columns=["video_id", "block", "at"])

    def accept(p: pd.DataFrame) -> pd.DataFrame:
        c = np.unique(p["frame_number"].to_numpy())
        after, kept = following(c).tolist(), []
        i = int(np.searchsorted(c, p["at"].iloc[0]))
        while i < len(c):
            kept.append(i)
            i = after[i]
        return pd.DataFrame({"video_id": p["video_id"].iloc[0], "frame_number": c[kept]})

    starts = cuts.groupBy("video_id", "block").applyInPandas(summary, f"video_id {kind}, block long, first long, until long")
    starts = starts.groupBy("video_id").applyInPandas(chain, f"video_id {kind}, block long, at long")
    met = cuts.join(starts, ["video_id", "block"])
    return met.groupBy("video_id", "block").applyInPandas(accept, f"video_id {kind}, frame_number long")


def consistent_times(decoded: DataFrame, scanned: DataFrame, fps: float) -> DataFrame:
    """Frames whose decoded time differs from the scanned one by more than max(2 ms, half a frame)."""
    both = decoded.alias("d").join(scanned.alias("s"), ["video_id", "frame_number"])
    return both.filter(F.abs(F.col("d.ts") - F.col("s.ts")) > max(0.002, 0.5 / fps)).select("video_id", "frame_number")
