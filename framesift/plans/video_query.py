"""From a video and an index to matches: shots, query frames, descriptors, top k, report."""

from __future__ import annotations

import json
import os
import time
from datetime import UTC, datetime
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import descriptor, knn, timeline
from ..sources import index_store, media, png, sinks, video

RESULTS = (
    "status string, index struct<path:string,sha256:string>, "
    "shots array<struct<id:bigint,queries:array<struct<frame_number:bigint,timestamp_seconds:double>>>>"
)


def grey_of(pixels: Column, width: Column, height: Column) -> Column:
    """Grey bytes of a column of RGB bytes."""

    @F.pandas_udf("binary")
    def run(px: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([png.grey(np.frombuffer(a, np.uint8).reshape(y, x, 3)).tobytes() for a, x, y in zip(px, w, h, strict=True)])

    return run(pixels, width, height)


def png_of(pixels: Column, width: Column, height: Column) -> Column:
    """Native-size PNG of a column of RGB bytes."""

    @F.pandas_udf("binary")
    def run(px: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([png.encode(np.frombuffer(a, np.uint8).reshape(y, x, 3)) for a, x, y in zip(px, w, h, strict=True)])

    return run(pixels, width, height)


def query_frames(spark: SparkSession, videos: dict[str, str], encoder: descriptor.SpatialDescriptor, interval: float | None = None, threshold: float = video.CUT_SCORE, min_frames: int = video.MIN_SHOT_FRAMES, reader=video.default_reader) -> tuple[DataFrame, DataFrame]:
    """(shots, query frames with embedding, quality, size and picture) of the videos. The scan is kept in memory or on
    executors' disks, as both the shots and the frames come from it."""
    scanned = video.scan(spark, videos, reader).persist()
    fps = scanned.agg(F.max("fps")).first()[0]
    numbered, shots = video.shots(scanned, fps, threshold, min_frames)
    wanted = timeline.nearest_frames(numbered, timeline.targets(shots, interval)).persist()
    pixels = video.read_selected(wanted.select("video_id", "frame_number"), videos, reader)
    late = timeline.consistent_times(pixels.filter("ts is not null").select("video_id", "frame_number", "ts"), numbered, fps)
    sources = numbered.select("video_id", "timestamp_source").distinct().filter("timestamp_source = 'presentation'")
    if late.join(sources, "video_id", "left_semi").limit(1).count():
        raise ValueError("frames were decoded at other times than scanned")
    size = (F.col("width"), F.col("height"))
    rows = pixels.withColumn("grey", grey_of(F.col("pixels"), *size)).withColumn("picture", png_of(F.col("pixels"), *size)).drop("ts", "pixels")
    rows = rows.withColumn("embedding", descriptor.descriptor_column(F.col("grey"), *size, encoder))
    rows = rows.withColumn("quality", descriptor.quality_column(F.col("grey"), *size)).drop("grey")
    rows = wanted.join(rows, ["video_id", "frame_number"]).withColumn("zero_vector", V.zero_at_query(F.col("embedding")))
    return shots, rows.select("*", "quality.*").drop("quality")


def write_thumbnails(spark: SparkSession, matches: DataFrame, images: DataFrame, root: str, output: str) -> list[dict]:
    """Small pictures of the matched images, each once; those that can't be made are returned with why."""
    scanned = media.scan(spark, root)
    plan = media.thumbnail_plan(matches, images, scanned.select(*media.KEY)).persist()
    wanted = plan.filter("error is null").select("relative_path", "thumbnail")
    small = media.thumbnails(scanned.join(F.broadcast(wanted.select("relative_path")), "relative_path", "left_semi")).persist()
    sinks.write_files(small.filter("error is null").join(wanted, "relative_path").select("thumbnail", "content"), output, "thumbnail", "content")
    failed = plan.filter("error is not null").select("relative_path", "error").unionByName(small.filter("error is not null").select("relative_path", "error"))
    return [r.asDict() for r in failed.orderBy("relative_path").collect()]


def run(spark: SparkSession, path: str, index: str, output: str, top_k: int = 10, interval: float | None = None, threshold: float = video.CUT_SCORE, min_frames: int = video.MIN_SHOT_FRAMES, reader=video.default_reader) -> dict:
    """Writes results.json, report.html, the frames' vectors, and the status last."""
    knn.check_k(top_k)
    if not os.path.isfile(path):
        raise ValueError(f"no video {path}")
    index_store.ensure_separate(index, output)
    sinks.empty_folder(output)
    began = time.time()
    before = video.unchanged({"video": path})
    manifest, images, vectors = index_store.open_index(spark, index)
    sinks.mark_incomplete(output)
    encoder = descriptor.SpatialDescriptor(**manifest["descriptor"]["parameters"])
    shots, frames = query_frames(spark, {Path(path).name: path}, encoder, interval, threshold, min_frames, reader)
    scanned_at = time.time()
    frames.withColumn("source_sha256", F.sha2("picture", 256)).write.parquet(f"{output}/frames")
    frames = spark.read.parquet(f"{output}/frames").drop("picture")
    encoded_at = time.time()
    matches = knn.top_k(frames.select(F.col("frame_number").alias("id"), "embedding"), vectors, top_k)
    report = knn.nested_report(matches, images)
    met = frames.join(report, frames["frame_number"] == report["query_id"]).drop("query_id", "embedding", "source_sha256")
    nested = met.groupBy("shot_id").agg(
        F.sort_array(F.collect_list(F.struct("frame_number", F.col("ts").alias("timestamp_seconds"), "width", "height", "zero_vector", "matches"))).alias("queries")
    )
    rows = shots.join(nested, "shot_id", "left").orderBy("shot_id").withColumnRenamed("shot_id", "id").drop("video_id")
    if video.unchanged({"video": path}) != before:
        raise ValueError("the video changed meanwhile")
    errors = write_thumbnails(spark, matches, images, manifest["images_root"], output) if manifest.get("images_root") else []
    results = {
        "schema_version": 1,
        "status": "complete",
        "video": {"path": str(Path(path).resolve())},
        "index": {"path": str(Path(index).resolve()), "sha256": index_store.index_digest(manifest), "descriptor": manifest["descriptor"]},
        "top_k": top_k,
        "interval_seconds": interval,
        "shots": [json.loads(r) for r in rows.toJSON().collect()],  # of one video
        "thumbnail_errors": errors,
        "timings_seconds": {"scan": round(scanned_at - began, 3), "frames": round(encoded_at - scanned_at, 3), "total": round(time.time() - began, 3)},
        "created_at": datetime.now(UTC).isoformat(),
    }
    results["shot_count"] = len(results["shots"])
    results["query_count"] = sum(len(s.get("queries", [])) for s in results["shots"])
    flat = matches.join(images.select(F.col("id").alias("image_id"), "relative_path"), "image_id").orderBy("query_id", "rank")
    page = sinks.render_page(f"Matches of {Path(path).name}", [("Shots", shots.orderBy("shot_id")), ("Matches", flat)], [f"{results['shot_count']} shots, {results['query_count']} query frames"])
    sinks.write_text(f"{output}/report.html", page)
    sinks.write_json(f"{output}/results.json", results)
    sinks.mark_complete(output, "results.json")
    return {k: results[k] for k in ("shot_count", "query_count")}
