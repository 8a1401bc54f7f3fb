"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# At most HOT_SHARE - 1 keys can each hold more than 1/HOT_SHARE of the rows, so
# the hot side of a split join always has fewer rows than this and may be broadcast.
HOT_SHARE = 1000


def split_hot(keyed: DataFrame, weight: str) -> tuple[DataFrame, DataFrame]:
    """Split a one-row-per-key table into its heavy hitters and the rest."""
    total = keyed.agg(F.sum(weight)).scalar()
    hot = F.col(weight) * HOT_SHARE > total
    return keyed.filter(hot), keyed.filter(~hot)


def join_per_key(rows: DataFrame, keyed: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of many rows with one row per key, safe against hot keys.

    ``weight`` is the number of ``rows`` of each key. Heavy keys are broadcast
    (fewer than ``HOT_SHARE`` rows by definition), so their rows never meet in
    one task; the others take the ordinary shuffled join.
    """
    hot, cold = split_hot(keyed, weight)
    hot_keys = F.broadcast(hot.select(key))
    heavy = rows.join(F.broadcast(hot), key)
    light = rows.join(hot_keys, key, "left_anti").join(cold, key)
    return heavy.unionByName(light)
