"""A SparkSession with the engine's defaults."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def get_session(master: str = "local[*]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, AQE, Arrow in batches bounded by rows and bytes; `shuffle_partitions` is left to the
    cluster unless given, and so is spark.checkpoint.dir, the shared folder for intermediate tables.
    Python workers find this package where the driver did; on a cluster, ship it with --py-files."""
    here = str(Path(__file__).resolve().parent.parent)
    known = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != here]
    builder = (
        SparkSession.builder.master(master)
        .appName("framesift")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
        .config("spark.executorEnv.PYTHONPATH", os.pathsep.join([here, *known]))
        .config("spark.ui.enabled", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
