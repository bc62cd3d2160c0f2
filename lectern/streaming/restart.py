"""Restartable incremental batches as streams: what was done is not done again, what stays missing is reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """The first row of each key; repeats that come within ``within`` of it go. The state of older keys is dropped."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def still_missing(expected: DataFrame, outputs: DataFrame, key: str, ts: str, wait: str, late: str = "0 seconds") -> DataFrame:
    """(key, ts) of the expected items without an output within ``wait``, told once that time has passed.

    A left outer join of two streams: an output counts if its time is from the item's time to ``wait`` after it. ``late``
    is by how much rows of either stream may come out of order. State holds items and outputs of the last ``wait`` only.
    """
    want = expected.select(F.col(key), F.col(ts)).withWatermark(ts, late)
    have = outputs.select(F.col(key).alias("_key"), F.col(ts).alias("_at")).withWatermark("_at", late)
    near = (F.col(key) == F.col("_key")) & (F.col("_at") >= F.col(ts)) & (F.col("_at") <= F.col(ts) + F.expr(f"interval {wait}"))
    return want.join(have, near, "left_outer").where(F.col("_key").isNull()).select(key, ts)
