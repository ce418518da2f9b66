"""Generated scenes: labels and preference pairs as cross products, seeded geometry, rendering."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import png

#: The dimensions of the generated set, its seed, picture size, and version.
SPLITS = ("dev", "test")
VARIANTS = ("base", "position", "scale", "background")
SUBJECTS = ("car", "tree", "person")
APPEARANCES = ("neutral", "warm", "cool", "textured")
SEED = 20260921
SIZE = (384, 256)
VERSION = "composition-scenes-v1"

#: Sky, ground and subject colours of each appearance.
PALETTES = {
    "neutral": ((220, 225, 230), (145, 150, 155), (40, 45, 50)),
    "warm": ((240, 215, 185), (180, 145, 110), (85, 45, 25)),
    "cool": ((185, 220, 240), (110, 150, 180), (25, 50, 85)),
    "textured": ((225, 220, 210), (155, 150, 135), (55, 50, 35)),
}

#: Each subject as shapes inside its box; polygons by corners, the others by box.
SHAPES = {
    "car": (
        ("polygon", ((0.15, 0.5), (0.30, 0), (0.72, 0), (0.88, 0.5))),
        ("rectangle", (0, 0.45, 1, 0.85)),
        ("ellipse", (0.08, 0.65, 0.33, 1)),
        ("ellipse", (0.67, 0.65, 0.92, 1)),
    ),
    "tree": (("rectangle", (0.40, 0.55, 0.60, 1)), ("polygon", ((0.5, 0), (0, 0.75), (1, 0.75)))),
    "person": (
        ("ellipse", (0.32, 0, 0.68, 0.30)),
        (
            "polygon",
            ((0.30, 0.30), (0.70, 0.30), (1, 0.60), (0.70, 0.65), (0.70, 1), (0.53, 1), (0.50, 0.70), (0.47, 1), (0.30, 1), (0.30, 0.65), (0, 0.60)),
        ),
    ),
}

LAYOUT = "struct<center_x:double,center_y:double,width:double,height:double,horizon:double>"


def _one_of(values: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def seed_column(seed: int, key: Column) -> Column:
    """scene_seed() of a key column, as a number of 20 digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def image_labels(spark: SparkSession, families_per_split: int = 12, seed: int = SEED) -> DataFrame:
    """id, path, split, family_id, layout_id, variant, subject, appearance, seed: 48 images a family.
    Every combination is one number of a range, taken apart by division."""
    if families_per_split < 1:
        raise ValueError("at least one family a split")
    sizes = (len(APPEARANCES), len(SUBJECTS), len(VARIANTS), families_per_split, len(SPLITS))
    total = 1
    digits = []
    for n in sizes:
        digits.append(F.floor(F.col("id") / total) % n)
        total *= n
    df = spark.range(total).select(
        _one_of(SPLITS, digits[4]).alias("split"),
        digits[3].alias("f"),
        _one_of(VARIANTS, digits[2]).alias("variant"),
        _one_of(SUBJECTS, digits[1]).alias("subject"),
        _one_of(APPEARANCES, digits[0]).alias("appearance"),
    )
    family = F.concat("split", F.lit("-"), F.format_string("%03d", F.col("f").cast("int")))
    df = df.withColumn("family_id", family).withColumn("layout_id", F.concat_ws("-", "family_id", "variant"))
    df = df.withColumn("id", F.concat_ws("-", "layout_id", "subject", "appearance"))
    return df.select(
        "id",
        F.concat(F.lit("images/"), "split", F.lit("/"), "id", F.lit(".png")).alias("path"),
        "split",
        "family_id",
        "layout_id",
        "variant",
        "subject",
        "appearance",
        # the same for all layouts of a family, so that texture doesn't change with geometry
        seed_column(seed, F.concat_ws("-", "family_id", "subject", "appearance")).alias("seed"),
    )


def preference_pairs(labels: DataFrame) -> DataFrame:
    """split, query, positive, negative, change, positive_change. Queries are base images; the
    positive has the next subject and the same or the next look, the negative one changed
    factor of the layout."""

    def following(values: tuple[str, ...], c: str) -> Column:
        return _one_of(values, F.array_position(F.array(*map(F.lit, values)), F.col(c)) % len(values))

    base = labels.filter("variant = 'base'")
    looks = F.array(
        F.struct(F.col("appearance").alias("look"), F.lit("subject").alias("positive_change")),
        F.struct(following(APPEARANCES, "appearance").alias("look"), F.lit("subject_and_appearance").alias("positive_change")),
    )
    rows = base.withColumn("p", F.explode(looks)).withColumn("change", F.explode(F.array(*map(F.lit, VARIANTS[1:]))))
    positive = F.concat_ws("-", "layout_id", following(SUBJECTS, "subject"), F.col("p.look"))
    negative = F.concat_ws("-", "family_id", "change", "subject", "appearance")
    return rows.select("split", F.col("id").alias("query"), positive.alias("positive"), negative.alias("negative"), "change", F.col("p.positive_change").alias("positive_change"))


def scene_seed(seed: int, key: str) -> int:
    """The first eight digest bytes of `seed:key`, as an unsigned number."""
    return int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:16], 16)


def family_layouts(seed: int) -> dict[str, dict[str, float]]:
    """Geometry of a family, drawn from its own seed, and its one-factor changes."""
    draw = random.Random(seed)
    side = draw.uniform(0.26, 0.34)
    mirrored = draw.choice((True, False))
    ranges = {"center_y": (0.55, 0.67), "width": (0.18, 0.26), "height": (0.22, 0.32), "horizon": (0.25, 0.45)}
    base = {"center_x": 1 - side if mirrored else side} | {k: draw.uniform(*r) for k, r in ranges.items()}
    return {
        "base": base,
        "position": base | {"center_x": 1 - base["center_x"]},
        "scale": base | {k: base[k] * 1.5 for k in ("width", "height")},
        "background": base | {"horizon": base["horizon"] + 0.35},
    }


def with_layouts(labels: DataFrame, seed: int = SEED) -> DataFrame:
    """labels with the struct `layout`. Seeded numbers come from Python's generator, once a row."""

    @F.pandas_udf(LAYOUT)
    def layouts(family: pd.Series, variant: pd.Series) -> pd.DataFrame:
        known = {f: family_layouts(scene_seed(seed, f)) for f in family.unique()}
        return pd.DataFrame([known[f][v] for f, v in zip(family, variant, strict=True)])

    return labels.withColumn("layout", layouts("family_id", "variant"))


def _inside(corners: list[tuple[float, float]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pixels lie in a polygon, its border included, by counting edges to their right."""
    found = np.zeros(np.broadcast(x, y).shape, bool)
    border = np.zeros_like(found)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        spans = (ay > y) != (by > y)
        found ^= spans & (x < ax + (y - ay) * (bx - ax) / ((by - ay) or 1))
        along = (x - ax) * (bx - ax) + (y - ay) * (by - ay)
        length = (bx - ax) ** 2 + (by - ay) ** 2
        t = np.clip(along / (length or 1), 0, 1)
        border |= (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2 <= 0.25
    return found | border


def render_scene(layout: dict[str, float], subject: str, appearance: str, size: tuple[int, int] = SIZE, seed: int = 0) -> np.ndarray:
    """RGB pixels (h, w, 3): sky, ground from the horizon down, the subject in its box, and for the
    textured look seeded grey noise of -8 to 8 levels."""
    if subject not in SHAPES or appearance not in PALETTES:
        raise ValueError("unknown subject or appearance")
    w, h = size
    sky, ground, colour = PALETTES[appearance]
    out = np.empty((h, w, 3), np.uint8)
    out[:] = sky
    out[min(round(layout["horizon"] * h), h) :] = ground
    y, x = np.mgrid[0:h, 0:w]
    origin = ((layout["center_x"] - layout["width"] / 2) * (w - 1), (layout["center_y"] - layout["height"] / 2) * (h - 1))
    extent = (layout["width"] * (w - 1), layout["height"] * (h - 1))

    def at(px: float, py: float) -> tuple[int, int]:
        return round(origin[0] + px * extent[0]), round(origin[1] + py * extent[1])

    for kind, points in SHAPES[subject]:
        if kind == "polygon":
            hit = _inside([at(*p) for p in points], x, y)
        else:
            (left, top), (right, bottom) = at(*points[:2]), at(*points[2:])
            if kind == "rectangle":
                hit = (x >= left) & (x <= right) & (y >= top) & (y <= bottom)
            else:
                rx, ry = max((right - left) / 2, 0.5), max((bottom - top) / 2, 0.5)
                hit = ((x - (left + right) / 2) / rx) ** 2 + ((y - (top + bottom) / 2) / ry) ** 2 <= 1
        out[hit] = colour
    if appearance == "textured":
        noise = np.random.Generator(np.random.PCG64(seed)).integers(-8, 9, (h, w, 1), dtype=np.int16)
        out = np.clip(out + noise, 0, 255).astype(np.uint8)
    return out


def rendered(labels: DataFrame, size: tuple[int, int] = SIZE) -> DataFrame:
    """labels (with layout) with `content`, the picture as PNG, and its sha256. A task renders one
    picture at a time."""
    if min(size) < 32:
        raise ValueError("pictures need 32 pixels on each side at least")
    schema = labels.schema.simpleString()[len("struct<") : -1]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for i in range(0, len(p), 16):
                some = p.iloc[i : i + 16].copy()
                files = [
                    png.encode(render_scene(r["layout"].asDict() if hasattr(r["layout"], "asDict") else dict(r["layout"]), r["subject"], r["appearance"], size, int(r["seed"])))
                    for r in some.to_dict("records")
                ]
                some["content"], some["sha256"] = files, [hashlib.sha256(f).hexdigest() for f in files]
                yield some

    return labels.mapInPandas(run, schema + ",content:binary,sha256:string")


def layout_is_sane(layout: dict[str, float]) -> bool:
    return all(math.isfinite(v) for v in layout.values()) and layout["width"] > 0 and layout["height"] > 0
