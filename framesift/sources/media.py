"""Image collections as DataFrames: listing, inventory, lenient decoding, batches, summaries.

Files are listed and read by Spark's binary file source, so a collection can be anywhere Spark
reads; where only names and sizes are asked for, no content is read. That source leaves out
names that begin with a dot or an underscore.
"""

from __future__ import annotations

import io
import os
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import row_numbers
from ..functions.scalars import IMAGE_SUFFIXES, is_contained, is_hidden, suffix
from ..operators.descriptor import shrunk
from . import png

KEY = ["relative_path", "size_bytes", "mtime_ns"]
DECODED = (
    "relative_path string, size_bytes long, mtime_ns long, source_width int, source_height int, "
    "width int, height int, pixels binary, error string"
)
Decoder = Callable[[bytes], np.ndarray]


def _linked(base: str) -> Callable[[Column], Column]:
    real = os.path.realpath(base)

    @F.pandas_udf("boolean")
    def check(paths: pd.Series) -> pd.Series:
        return pd.Series([os.path.realpath(os.path.join(real, p)) != os.path.join(real, p) for p in paths], dtype=bool)

    return check


def scan(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, size_bytes, mtime_ns, content of the image files below root. Hidden names and, on
    a local disk, symbolic links are left out; a root that is no folder is an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
        raise ValueError(f"{root} is not a folder")
    base = fs.makeQualified(path).toString().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = files.select(
        F.expr(f"substring(path, {len(base) + 2})").alias("relative_path"),
        F.col("length").alias("size_bytes"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        "content",
    )
    found = found.filter(suffix(F.col("relative_path")).isin(*IMAGE_SUFFIXES) & ~is_hidden(F.col("relative_path")))
    if base.startswith("file:"):
        found = found.filter(~_linked(base.removeprefix("file:"))("relative_path"))
    return found


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, size_bytes, mtime_ns; without an image it is an error."""
    found = scan(spark, root).select(*KEY)
    if found.isEmpty():
        raise ValueError(f"no images below {root}")
    return found


def pillow_decoder(data: bytes) -> np.ndarray:
    from PIL import Image, ImageOps

    with Image.open(io.BytesIO(data)) as im:
        im.load()
        return np.asarray(ImageOps.exif_transpose(im).convert("RGB"))


def plain_decoder(data: bytes) -> np.ndarray:
    """Plain PNG and binary PGM or PPM, for places without an image library."""
    if data[:4] == b"\x89PNG":
        return png.decode(data)
    parts = data.split(None, 4)
    if len(parts) < 5 or parts[0] not in (b"P5", b"P6") or parts[3] != b"255":
        raise ValueError("not a plain PNG, PGM or PPM")
    w, h, n = int(parts[1]), int(parts[2]), 1 if parts[0] == b"P5" else 3
    body = data[len(data) - len(parts[4]) :]
    if len(body) < w * h * n:
        raise ValueError("truncated")
    return np.frombuffer(body[: w * h * n], np.uint8).reshape(h, w, n)


def default_decoder() -> Decoder:
    try:
        import PIL  # noqa: F401
    except ImportError:
        return plain_decoder
    return pillow_decoder


def decoding_errors() -> tuple[type[Exception], ...]:
    """What a bad file may raise: an oversized one, too, is an error of its row."""
    try:
        from PIL import Image
    except ImportError:
        return OSError, ValueError, SyntaxError
    return OSError, ValueError, SyntaxError, Image.DecompressionBombError


def decode(scanned: DataFrame, decoder: Decoder | None = None, max_side: int | None = None, colour: bool = False) -> DataFrame:
    """Every scanned row with its pixels (grey bytes, or RGB) or its error; one bad file doesn't stop the
    rest. width and height are those of the pixels, at most max_side; source_ those of the file."""
    if max_side is not None and max_side < 1:
        raise ValueError("max_side must be positive")
    read = decoder or default_decoder()

    def one(r) -> tuple:
        try:
            p = read(r.content)
            p = p[:, :, None] if p.ndim == 2 else p
            h, w = p.shape[:2]
            if colour:
                p = np.repeat(p[:, :, :1], 3, axis=2) if p.shape[2] < 3 else p[:, :, :3]
                out = np.stack([shrunk(p[:, :, c].astype(float), max_side) for c in range(3)], axis=2)
            else:
                out = shrunk(png.grey(p).astype(float), max_side)
            return r.relative_path, r.size_bytes, r.mtime_ns, w, h, out.shape[1], out.shape[0], np.rint(out).astype(np.uint8).tobytes(), None
        except decoding_errors() as e:
            return r.relative_path, r.size_bytes, r.mtime_ns, None, None, None, None, None, str(e) or type(e).__name__

    columns = [c.split()[0] for c in DECODED.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), 16):  # few decoded pictures at a time
                out = pd.DataFrame([one(r) for r in p.iloc[at : at + 16].itertuples(index=False)], columns=columns)
                yield out.astype({c: "Int32" for c in columns if c.endswith(("width", "height"))})

    return scanned.select(*KEY, "content").mapInPandas(run, DECODED)


def usable(decoded: DataFrame, required: bool = False) -> DataFrame:
    """The rows that decoded; with `required`, none at all is an error."""
    good = decoded.filter("error is null")
    if required and good.isEmpty():
        raise ValueError("no usable images")
    return good


def errors(decoded: DataFrame) -> DataFrame:
    return decoded.filter("error is not null").select(*KEY, "error")


def batch_numbers(df: DataFrame, key: str, size: int = 16) -> DataFrame:
    """0-based batch of each row in key order."""
    if size < 1:
        raise ValueError("the batch size must be positive")
    return row_numbers(df, key, "batch").withColumn("batch", F.floor(F.col("batch") / size))


def summary(decoded: DataFrame) -> DataFrame:
    """candidates, usable, invalid, bytes: the last of usable files only."""
    good = F.col("error").isNull()
    return decoded.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(good).alias("usable"),
        F.count_if(~good).alias("invalid"),
        F.coalesce(F.sum(F.when(good, F.col("size_bytes"))), F.lit(0)).alias("bytes"),
    )


def extension_histogram(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """extension, n of the files given; of a decoded collection, its usable() rows."""
    return files.groupBy(suffix(F.col(path)).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def flatten_results(results: DataFrame, limit: int = 5000) -> DataFrame:
    """shots[].queries[] as rows with shot_id; between 1 and `limit` rows, unique frames."""
    rows = unchecked_results(results)
    n, distinct = rows.agg(F.count(F.lit(1)), F.countDistinct("frame_number")).first()
    if not 1 <= n <= limit or n != distinct:
        raise ValueError(f"{n} frames, {distinct} distinct")
    return rows.orderBy("frame_number")


def unchecked_results(results: DataFrame) -> DataFrame:
    shots = results.select(F.explode("shots").alias("s"))
    return shots.select(F.col("s.id").alias("shot_id"), F.explode("s.queries").alias("q")).select("shot_id", "q.*")


def thumbnail_plan(matches: DataFrame, images: DataFrame, current: DataFrame) -> DataFrame:
    """image_id, relative_path, thumbnail, error: one row for each matched image. `images` is the index's
    mapping (id, relative_path, size_bytes, mtime_ns), `current` the inventory now. A file that is
    gone, changed or outside its folder has an error instead of a thumbnail; the others go on."""
    wanted = matches.select("image_id").distinct().join(images.withColumnRenamed("id", "image_id"), "image_id")
    now = current.select("relative_path", F.col("size_bytes").alias("size_now"), F.col("mtime_ns").alias("mtime_now"))
    met = wanted.join(now, "relative_path", "left")
    error = (
        F.when(~is_contained(F.col("relative_path")), "outside the collection")
        .when(F.col("size_now").isNull(), "missing")
        .when((F.col("size_now") != F.col("size_bytes")) | (F.col("mtime_now") != F.col("mtime_ns")), "changed since indexing")
    )
    name = F.format_string("candidates/%06d.png", "image_id")
    return met.select("image_id", "relative_path", F.when(error.isNull(), name).alias("thumbnail"), error.alias("error"))


def thumbnails(scanned: DataFrame, max_side: int = 320, decoder: Decoder | None = None) -> DataFrame:
    """relative_path, content (a PNG of at most max_side), error of scanned files. One bad file doesn't stop the
    rest."""
    small = decode(scanned, decoder, max_side, colour=True)

    @F.pandas_udf("binary")
    def packed(px: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else png.encode(np.frombuffer(p, np.uint8).reshape(int(b), int(a), 3)) for p, a, b in zip(px, w, h, strict=True)])

    return small.select("relative_path", packed("pixels", "width", "height").alias("content"), "error")


def feedback_profile(profile: dict, members: set[str]) -> list[dict]:
    """The examples of a profile: name, criterion, and the workbook members of its roles. Only media members
    that stay in their folder count, and every example needs a preferred picture."""
    out = []
    for example in profile["examples"]:
        roles = {r: example[r] for r in ("preferred", "less_preferred") if r in example}
        bad = [m for m in roles.values() if not m.startswith("xl/media/") or ".." in m.split("/") or m not in members]
        if bad or "preferred" not in roles:
            raise ValueError(f"example {example.get('name')!r}: {bad or 'no preferred picture'}")
        out.append({"name": example["name"], "criterion": example["criterion"]} | roles)
    return out


def workbook_media(path: str) -> dict[str, bytes]:
    """Media members of a workbook; names that leave their folder are an error."""
    import zipfile

    with zipfile.ZipFile(path) as z:
        names = [n for n in z.namelist() if n.startswith("xl/media/") and not n.endswith("/")]
        if any(".." in n.split("/") for n in names):
            raise ValueError("a member leaves its folder")
        return {n: z.read(n) for n in names}
