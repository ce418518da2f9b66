"""Scratch space: tables that end a lineage, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only on a local master, where it is unset,
    a folder of this machine: executors elsewhere would write to disks nobody else reads."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        folder = tempfile.mkdtemp(prefix="framesift-")
        atexit.register(shutil.rmtree, folder, True)
        _local_scratch[app] = "file://" + folder
    return _local_scratch[app]


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_root(spark)}/framesift-{what}-{uuid.uuid4().hex}"


_open_scopes: list[list[str]] = []


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df to the scratch folder and read it back: the lineage ends there, on storage
    that outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    for paths in _open_scopes:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes at its end every table that cut() made inside it, but those of the frames put into the
    list it gives. For callers that write the result before they leave."""
    paths: list[str] = []
    kept: list[DataFrame] = []
    _open_scopes.append(paths)
    try:
        yield kept
    finally:
        _open_scopes[:] = [x for x in _open_scopes if x is not paths]
        used = {f.rpartition("/")[0].rpartition("/")[2] for df in kept for f in df.inputFiles()}
        for path in paths:
            if path.rpartition("/")[2] not in used:
                drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables written by cut() that no later step reads."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, path)
