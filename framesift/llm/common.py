"""Helpers shared by the training-data operators: tables, scratch space, folds, hashing."""

from __future__ import annotations

import contextlib
import gc
import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import cut, drop, drop_path, scratch_path, scratch_root, scratch_scope  # noqa: F401

#: White space of the contracts: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(df: DataFrame | None, spark: SparkSession) -> None:
    """drop(), and let Spark's cleaner drop the shuffle files behind it: it does so when the driver
    collects its garbage, which on a driver with much memory may come late."""
    if df is not None:
        drop(df)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df hasn't got, whatever the case of its letters."""
    known = {c.lower() for c in df.columns}
    return next(n for k in range(len(known) + 1) if (n := f"{stem}{k or ''}").lower() not in known)


def fold(doc_id: Column, mod: int) -> Column:
    """crc32(doc_id as text) mod `mod`; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(mod)


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    return F.coalesce(fold(doc_id, mod) == remainder, F.lit(False))


def words_of(text: Column) -> Column:
    """Words of a text, white space being SPACE; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


ARROW_ROWS = 1000
ARROW_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds what is sent to Python at a time, in rows and in bytes, as texts can be long: 1,000 rows
    and 16 MB (or one row) instead of Spark's 10,000 and 64 MB. Smaller settings are left alone."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(key).strip().lower()).groups()
        if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= most:
            spark.conf.set(key, most)


def tidy() -> None:
    """At the end of a Python task: give freed memory back, as the worker lives on idle."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


# ---------------------------------------------------------------- numpy hashing

U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=U))
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b & (2**64 - 1), U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of UTF-8 bytes."""
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[b]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each b[start:end], equal for equal bytes wherever they stand."""
    power, inverse = _grown(len(b))
    total = np.zeros(len(b) + 1, U)
    np.cumsum(_BYTE[b] * power[: len(b)], out=total[1:])
    return mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(U))


HASH_PIECE = 1 << 20  # bytes hashed at a time, so a very long text needs bounded memory


def word_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words in UTF-8 bytes, in order; pieces end at white space."""
    out = []
    at = 0
    while at < len(b):
        end = at + HASH_PIECE
        while end < len(b):
            gap = np.flatnonzero(_IS_SPACE[b[end : end + HASH_PIECE]])
            if gap.size:
                end += int(gap[0])
                break
            end += HASH_PIECE
        piece = b[at:end]
        start, stop = word_spans(piece)
        out.append(span_hashes(piece, start, stop))
        at = end
    return np.concatenate(out) if out else np.zeros(0, U)


def utf8(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
