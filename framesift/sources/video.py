"""Frames of videos as DataFrames: scan with change scores, selected frames with their pixels.

A video is decoded front to back by one task; videos run in parallel. The reader is a plug-in, a
function from a path to (frames a second, iterator of (seconds or None, RGB pixels)). Plain Y4M is
read without any library, other files by OpenCV where it is installed.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline
from ..operators.descriptor import shrunk

#: Change score of a cut, least frames of a shot, and the longest side compared.
CUT_SCORE = 27.0
MIN_SHOT_FRAMES = 15
COMPARE_SIDE = 320

Frames = Iterator[tuple[float | None, np.ndarray]]
Reader = Callable[[str], tuple[float, Frames]]
SCANNED = "video_id string, frame_number long, ts double, fps double, width int, height int, change double"
SELECTED = "video_id string, frame_number long, ts double, width int, height int, pixels binary"


def y4m_reader(path: str) -> tuple[float, Frames]:
    """YUV4MPEG2, 8 bits: 4:2:0, 4:4:4 or grey. A file that ends inside a frame is an error."""
    with open(path, "rb") as f:
        head = f.readline().split()
    if not head or head[0] != b"YUV4MPEG2":
        raise ValueError(f"{path} is no plain video")
    tags = {t[:1]: t[1:].decode() for t in head[1:]}
    w, h = int(tags[b"W"]), int(tags[b"H"])
    over, under = (int(x) for x in tags.get(b"F", "0:1").split(":"))
    fps = over / under if under else math.nan
    kind = tags.get(b"C", "420")
    if not kind.startswith(("420", "444", "mono")) or "p1" in kind:
        raise ValueError(f"{path}: colour space {kind}")
    cw, ch = (w, h) if kind.startswith("444") else ((w + 1) // 2, (h + 1) // 2) if kind.startswith("420") else (0, 0)

    def frames() -> Frames:
        with open(path, "rb") as f:
            f.readline()
            n = 0
            while mark := f.readline():
                data = f.read(w * h + 2 * cw * ch)
                if not mark.startswith(b"FRAME") or len(data) < w * h + 2 * cw * ch:
                    raise ValueError(f"{path} is truncated after {n} frames")
                planes = np.frombuffer(data, np.uint8).astype(float)
                y = planes[: w * h].reshape(h, w)
                u = v = np.zeros((h, w))
                if cw:
                    both = planes[w * h :].reshape(2, ch, cw) - 128
                    u, v = (np.repeat(np.repeat(c, -(-h // ch), 0), -(-w // cw), 1)[:h, :w] for c in both)
                luma = (y - 16) * 255 / 219
                rgb = np.stack([luma + 1.596 * v, luma - 0.392 * u - 0.813 * v, luma + 2.017 * u], axis=2)
                yield n / fps, np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
                n += 1

    return fps, frames()


def opencv_reader(path: str) -> tuple[float, Frames]:
    import cv2

    video = cv2.VideoCapture(path)
    if not video.isOpened():
        raise ValueError(f"cannot decode {path}")
    expected = int(video.get(cv2.CAP_PROP_FRAME_COUNT))

    def frames() -> Frames:
        try:
            n = 0
            while (got := video.read())[0]:
                yield video.get(cv2.CAP_PROP_POS_MSEC) / 1000, got[1][:, :, ::-1]
                n += 1
            if expected > n + 1:
                raise ValueError(f"{path} ended after {n} of {expected} frames")
        finally:
            video.release()

    return video.get(cv2.CAP_PROP_FPS), frames()


def default_reader(path: str) -> tuple[float, Frames]:
    return y4m_reader(path) if path.lower().endswith(".y4m") else opencv_reader(path)


def hue_saturation_value(rgb: np.ndarray) -> np.ndarray:
    """[h, w, 3]: hue in half degrees (0 to 180), saturation and value from 0 to 255."""
    x = rgb.astype(float)
    value = x.max(axis=2)
    spread = value - x.min(axis=2)
    safe = np.where(spread > 0, spread, 1)
    r, g, b = (x[:, :, i] for i in range(3))
    sixth = np.select([value == r, value == g], [(g - b) / safe, 2 + (b - r) / safe], 4 + (r - g) / safe)
    hue = np.where(spread > 0, np.mod(sixth * 30, 180), 0)
    saturation = np.where(value > 0, 255 * spread / np.where(value > 0, value, 1), 0)
    return np.stack([hue, saturation, value], axis=2)


def change_scores(frames: Iterator[np.ndarray], side: int = COMPARE_SIDE) -> Iterator[float]:
    """Of each frame against the one before: the mean of the mean differences of hue, saturation and
    value; 0 for the first."""
    before = None
    for rgb in frames:
        small = np.stack([shrunk(rgb[:, :, c].astype(float), side) for c in range(3)], axis=2)
        now = hue_saturation_value(np.rint(small))
        yield 0.0 if before is None or before.shape != now.shape else float(np.abs(now - before).mean())
        before = now


def scan(spark: SparkSession, videos: dict[str, str], reader: Reader = default_reader) -> DataFrame:
    """One row a frame of every video (id -> path): its time, size and change score. Null times stay null;
    timeline.usable_times() judges them. A video without a frame or a valid rate is an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for video_id, path in p.itertuples(index=False):
                fps, frames = reader(path)
                if not (math.isfinite(fps) and fps > 0):
                    raise ValueError(f"{path} has no valid frame rate")
                rows: list[tuple] = []
                seen: list[tuple] = []

                def noted(frames=frames, seen=seen) -> Iterator[np.ndarray]:
                    for ts, rgb in frames:
                        seen.append((ts, rgb.shape))
                        yield rgb

                n = 0
                for score in change_scores(noted()):
                    ts, shape = seen.pop()
                    rows.append((video_id, n, ts, fps, shape[1], shape[0], score))
                    n += 1
                    if len(rows) == 10_000:
                        yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCANNED.split(", ")])
                        rows.clear()
                if not n:
                    raise ValueError(f"{path} has no usable frame")
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCANNED.split(", ")])

    listed = spark.createDataFrame(sorted(videos.items()), "video_id string, path string").repartition(max(1, len(videos)), "video_id")
    return listed.mapInPandas(run, SCANNED)


def shots(scanned: DataFrame, fps: float, threshold: float = CUT_SCORE, min_frames: int = MIN_SHOT_FRAMES) -> tuple[DataFrame, DataFrame]:
    """(frames with shot_id and usable times, shots) from change scores: a shot starts where the score
    reaches the threshold, at least min_frames after the one before."""
    if not (math.isfinite(threshold) and threshold > 0) or min_frames < 1:
        raise ValueError("the threshold and the least frames must be positive")
    starts = timeline.enforce_min_gap(scanned.filter(F.col("change") >= threshold), min_frames).withColumn("starts", F.lit(True))
    frames = timeline.usable_times(scanned, fps).join(starts, ["video_id", "frame_number"], "left")
    numbered = timeline.shot_ids(frames, F.coalesce("starts", F.lit(False))).drop("starts")
    return numbered, timeline.shots(numbered, fps)


def read_selected(wanted: DataFrame, videos: dict[str, str], reader: Reader = default_reader) -> DataFrame:
    """The pixels of the wanted frames (video_id, frame_number, ts): each video is read once, in order; a frame
    that isn't there is an error."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        video_id = p["video_id"].iloc[0]
        numbers = set(p["frame_number"])
        if len(numbers) != len(p):
            raise ValueError("selected frames must be unique")
        _, frames = reader(videos[video_id])
        rows = []
        for n, (ts, rgb) in enumerate(frames):
            if n in numbers:
                rows.append((video_id, n, ts, rgb.shape[1], rgb.shape[0], np.ascontiguousarray(rgb).tobytes()))
                if len(rows) == len(numbers):
                    break
        if len(rows) < len(numbers):
            raise ValueError(f"{videos[video_id]} ended before the last selected frame")
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SELECTED.split(", ")])

    if missing := [r[0] for r in wanted.select("video_id").distinct().collect() if r[0] not in videos]:
        raise ValueError(f"unknown videos: {missing}")
    return wanted.groupBy("video_id").applyInPandas(run, SELECTED)


def unchanged(paths: dict[str, str]) -> dict[str, tuple[int, int]]:
    """Size and time of each video, to be compared before and after a run."""
    return {k: (s.st_size, s.st_mtime_ns) for k, p in paths.items() if (s := os.stat(p))}
