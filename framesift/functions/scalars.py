"""Scalar helpers: clipping, percentile scaling, path functions, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: File suffixes that count as images.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def scale_percentile(df: DataFrame, value: str, out: str, by: str | None = None) -> DataFrame:
    """`value` between its 10th and 90th percentile, over all rows or those of equal `by`, clipped to
    0..1; 0.5 for all rows when the two are closer than 1e-12. Bounds over all rows are one row,
    joined as such."""
    bounds = F.percentile(value, F.array(F.lit(0.1), F.lit(0.9)))
    both = f"{out}_bounds"
    if by is None:
        df = df.join(F.broadcast(df.agg(bounds.alias(both))))
    else:
        df = df.join(df.groupBy(by).agg(bounds.alias(both)), by)
    low, high = F.col(both)[0], F.col(both)[1]
    scaled = F.when(high - low < 1e-12, F.lit(0.5)).otherwise(clip01((F.col(value) - low) / (high - low)))
    return df.withColumn(out, scaled).drop(both)


def image_link(path: Column) -> Column:
    """A relative path as a link: UTF-8 bytes quoted but for letters, digits, slashes and _.-~"""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def suffix(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.startswith("."))


def is_contained(path: Column) -> Column:
    """A relative path that stays below its root."""
    return ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda x: x == "..") & (path != "")


def seed64(text: Column) -> Column:
    """The first 8 digest bytes as an unsigned number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
