"""Row numbers in the order of a key, without sorting a table in one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS = 1 << 20  # rows aimed at for one range
SAMPLE = 50  # sampled keys a range


def row_numbers(df: DataFrame, key: str, out: str, rows: int = ROWS) -> DataFrame:
    """df with `out`: 0-based place of each row by `key`, which must not be null; rows of equal key stand
    in any order. Keys are cut into ranges at sampled bounds; rows are numbered inside each range
    and the sizes of the ranges before are added."""
    n = df.count()
    parts = max(1, -(-n // rows))
    bounds = []
    if parts > 1:
        share = min(1.0, SAMPLE * parts / n)
        keys = sorted(r[0] for r in df.select(key).filter(F.col(key).isNotNull()).sample(share, seed=1).collect())
        bounds = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []
    cuts = np.array(bounds, dtype=object if not bounds or isinstance(bounds[0], str) else None)

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(), side="right").astype("int32"))

    part, before = f"{out}_range", f"{out}_before"
    df = df.withColumn(part, range_of(F.col(key)) if bounds else F.lit(0))
    sizes = df.groupBy(part).count() if bounds else None
    at = F.row_number().over(Window.partitionBy(part).orderBy(key)).cast("long") - 1
    if sizes is None:
        return df.withColumn(out, at).drop(part)
    starts = sizes.withColumn(before, F.coalesce(F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = F.broadcast(starts.drop("count"))  # one row a range
    return df.join(starts, part).withColumn(out, at + F.col(before)).drop(part, before)
