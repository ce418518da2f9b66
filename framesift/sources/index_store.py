"""The vector index as Parquet: resumable extraction, checksummed manifest, verified loading."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import shutil
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.ordering import row_numbers
from ..functions.scalars import is_contained
from .sinks import write_json

SCHEMA_VERSION = 1
CHECKPOINT = "relative_path string, size_bytes long, mtime_ns long, vector array<float>, error string"


@contextlib.contextmanager
def locked(folder: str) -> Iterator[None]:
    """Exclusive and non-blocking: a second user is an error."""
    os.makedirs(folder, exist_ok=True)
    with open(Path(folder, ".lock"), "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            raise RuntimeError(f"{folder} is in use") from e
        yield


def ensure_separate(a: str, b: str) -> None:
    x, y = Path(a).resolve(), Path(b).resolve()
    if x == y or x in y.parents or y in x.parents:
        raise ValueError(f"{a} and {b} must not contain each other")


def fingerprint(inventory: DataFrame) -> str:
    """sha256 over the rows, in any order: each row's digest falls into one of 4,096 groups by its first
    digits, a group's digest is that of its sorted row digests, and the groups are joined in order."""
    rows = inventory.select(F.sha2(F.to_json(F.struct("relative_path", "size_bytes", "mtime_ns")), 256).alias("h"))
    groups = rows.groupBy(F.substring("h", 1, 3).alias("g")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return groups.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "h"))), lambda x: x["h"]), ""), 256)).first()[0]


def pending(inventory: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Inventory rows without a committed result."""
    return inventory.join(checkpoint.select("relative_path"), "relative_path", "left_anti")


def stale(inventory: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Committed rows whose file has another size or time now."""
    now, old = inventory.alias("now"), checkpoint.alias("old")
    met = now.join(old, F.col("now.relative_path") == F.col("old.relative_path"))
    other = (F.col("now.size_bytes") != F.col("old.size_bytes")) | (F.col("now.mtime_ns") != F.col("old.mtime_ns"))
    return met.filter(other).select("now.relative_path", "now.size_bytes", "now.mtime_ns")


def expected_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """relative_path, problem of a collection against what it should hold (both relative_path, size_bytes):
    missing, unexpected, or of another size."""
    a = expected.select("relative_path", F.col("size_bytes").alias("expected_size"))
    b = found.select("relative_path", F.col("size_bytes").alias("found_size"))
    problem = (
        F.when(F.col("found_size").isNull(), "missing")
        .when(F.col("expected_size").isNull(), "unexpected")
        .when(F.col("found_size") != F.col("expected_size"), "size")
    )
    return a.join(b, "relative_path", "full").select("relative_path", problem.alias("problem")).filter("problem is not null")


class VectorIndex:
    """Folder: checkpoint/batch=N (committed extraction rounds), vectors, images, errors,
    manifest.json (written last)."""

    def __init__(self, spark: SparkSession, folder: str, dimension: int, descriptor: dict) -> None:
        self.spark, self.folder, self.dimension, self.descriptor = spark, folder, dimension, descriptor

    def checkpoint(self) -> DataFrame:
        done = sorted(str(p) for p in Path(self.folder, "checkpoint").glob("batch=*") if (p / "_SUCCESS").exists())
        return self.spark.read.schema(CHECKPOINT).parquet(*done) if done else self.spark.createDataFrame([], CHECKPOINT)

    def extract(self, inventory: DataFrame, encode: Callable[[DataFrame], DataFrame], batch_rows: int = 1 << 20, allow_zero: bool = True) -> int:
        """`encode` turns pending inventory rows into checkpoint rows, in rounds of about batch_rows. A
        round commits whole or not at all; vectors must be finite, of the dimension and of norm 1,
        or 0 where zero vectors are allowed."""
        if batch_rows < 1:
            raise ValueError("the batch size must be positive")
        before = self.checkpoint()
        if stale(inventory, before).limit(1).count():
            raise RuntimeError("files changed since they were extracted; rebuild the index")
        todo = pending(inventory, before)
        total = todo.count()
        rounds = -(-total // batch_rows)
        for r in range(rounds):
            part = todo if rounds == 1 else todo.filter(F.pmod(F.xxhash64("relative_path"), F.lit(rounds)) == r)
            self._commit(part, encode, allow_zero)
        return total

    def _commit(self, todo: DataFrame, encode: Callable[[DataFrame], DataFrame], allow_zero: bool) -> None:
        n = todo.count()
        number = len(list(Path(self.folder, "checkpoint").glob("batch=*")))
        path = f"{self.folder}/checkpoint/staged"
        encode(todo).select("relative_path", "size_bytes", "mtime_ns", "vector", "error").write.mode("overwrite").parquet(path)
        rows = self.spark.read.schema(CHECKPOINT).parquet(path)
        good = F.col("error").isNull() & V.is_valid(F.col("vector"), self.dimension, allow_zero)
        fine = good | (F.col("error").isNotNull() & F.col("vector").isNull())
        if rows.filter(~fine).limit(1).count() or rows.count() != n:
            raise ValueError("the encoder gave other rows or invalid vectors; nothing was committed")
        os.rename(path, f"{self.folder}/checkpoint/batch={number:06d}")

    def _settings(self, inventory: DataFrame) -> dict:
        return {"schema_version": SCHEMA_VERSION, "descriptor": self.descriptor, "inventory_sha256": fingerprint(inventory)}

    def _compare(self, settings: dict, rebuild: bool) -> None:
        """A folder that holds work of other settings, or something else, is left alone unless it is to be
        rebuilt."""
        manifest, work = Path(self.folder, "manifest.json"), Path(self.folder, "checkpoint")
        if rebuild:
            shutil.rmtree(work, ignore_errors=True)
        elif manifest.exists():
            before = json.loads(manifest.read_text())
            if {k: before.get(k) for k in settings} != settings:
                raise ValueError("source or descriptor changed; rebuild the index or take another folder")
        elif any(p.name not in (".lock", "checkpoint") for p in Path(self.folder).iterdir()):
            raise ValueError(f"{self.folder} holds other files")

    def build(
        self,
        inventory: DataFrame,
        encode: Callable[[DataFrame], DataFrame],
        rebuild: bool = False,
        batch_rows: int = 1 << 20,
        again: Callable[[], DataFrame] | None = None,
        images_root: str | None = None,
    ) -> dict:
        """Extract what is missing and write the index. `again` lists the collection once more after
        extraction; if it changed, nothing is written. Tables are staged, then renamed."""
        with locked(self.folder):
            began = time.time()
            settings = self._settings(inventory)
            self._compare(settings, rebuild)
            manifest = settings | {"status": "indexing", "images_root": images_root}
            write_json(f"{self.folder}/manifest.json", manifest)
            extracted = self.extract(inventory, encode, batch_rows)
            encoded = time.time()
            if again and fingerprint(again()) != settings["inventory_sha256"]:
                raise RuntimeError("the collection changed meanwhile; rebuild the index")
            rows = self.checkpoint().join(inventory.select("relative_path"), "relative_path", "left_semi")
            good = row_numbers(rows.filter("error is null"), "relative_path", "id")
            images = good.select("id", "relative_path", "size_bytes", "mtime_ns", V.zero_at_index(F.col("vector")).alias("zero_vector"))
            self._replace("vectors", good.select("id", F.col("vector").alias("embedding")))
            self._replace("images", images)
            self._replace("errors", rows.filter("error is not null").drop("vector"))
            usable, zero = self.spark.read.parquet(f"{self.folder}/images").agg(F.count(F.lit(1)), F.count_if("zero_vector")).first()
            total = rows.count()
            manifest |= {
                "counts": {"usable": usable, "invalid": total - usable},
                "zero_vectors": zero,
                "processed": extracted,
                "reused": total - extracted,
                "files": checksums(self.folder),
                "timings_seconds": {"extraction": round(encoded - began, 3), "total": round(time.time() - began, 3)},
                "completed_at": datetime.now(UTC).isoformat(),
                "status": "complete" if usable else "failed",
            }
            write_json(f"{self.folder}/manifest.json", manifest)
            if not usable:
                raise ValueError("no usable image")
            return manifest

    def _replace(self, name: str, df: DataFrame) -> None:
        staged, place = f"{self.folder}/{name}.staged", f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(staged)
        shutil.rmtree(place, ignore_errors=True)
        os.rename(staged, place)

    def load(self) -> tuple[dict, DataFrame, DataFrame]:
        """(manifest, images, vectors) after checking version, status, checksums and mapping."""
        with locked(self.folder):
            manifest = json.loads(Path(self.folder, "manifest.json").read_text())
            if manifest.get("schema_version") != SCHEMA_VERSION or manifest.get("status") != "complete":
                raise ValueError("the index is not complete")
            if manifest["descriptor"] != self.descriptor:
                raise ValueError("the index was made with another descriptor")
            if manifest["files"] != checksums(self.folder):
                raise ValueError("the index files changed")
        images, vectors = (self.spark.read.parquet(f"{self.folder}/{x}") for x in ("images", "vectors"))
        placed = row_numbers(images, "relative_path", "place")
        if placed.filter((F.col("place") != F.col("id")) | ~is_contained(F.col("relative_path"))).limit(1).count():
            raise ValueError("ids don't follow paths")
        if vectors.join(images, "id", "full").filter("embedding is null or relative_path is null").limit(1).count():
            raise ValueError("images and vectors differ")
        return manifest, images, vectors


def checksums(folder: str) -> dict[str, dict]:
    out = {}
    for p in sorted(Path(folder).glob("*/part-*")):
        with p.open("rb") as f:
            digest = hashlib.file_digest(f, "sha256").hexdigest()
        out[p.relative_to(folder).as_posix()] = {"sha256": digest, "bytes": p.stat().st_size}
    return out


def open_index(spark: SparkSession, folder: str) -> tuple[dict, DataFrame, DataFrame]:
    """(manifest, images, vectors) of an index whose descriptor its own manifest names."""
    path = Path(folder, "manifest.json")
    if not path.is_file():
        raise ValueError(f"no index in {folder}")
    described = json.loads(path.read_text()).get("descriptor", {})
    if "dimension" not in described:
        raise ValueError("the index manifest is not valid")
    return VectorIndex(spark, folder, described["dimension"], described).load()


def index_digest(manifest: dict) -> str:
    """One sha256 of an index: of the checksums of its files."""
    return hashlib.sha256(json.dumps(manifest["files"], sort_keys=True).encode()).hexdigest()
