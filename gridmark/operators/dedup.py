"""Exact duplicate removal by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmark.operators.skew import join_per_key


def deduplicate(samples: DataFrame, key: str = "sha256", order: tuple[str, ...] = ("image_path",)) -> DataFrame:
    """Keep the first sample of every content hash.

    ``order`` must be a total order. The rank filter becomes a group limit that
    runs before the shuffle, so every task sends at most one row per hash and a
    hash shared by a third of all samples costs one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return samples.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def dedup_report(samples: DataFrame, key: str = "sha256") -> DataFrame:
    """Scanned, retained and removed samples."""
    per_hash = samples.groupBy(key).agg(F.count("*").alias("copies"))
    return per_hash.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("total_scanned"),
        F.count("*").alias("unique_retained"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates_removed"),
    )


def duplicate_mapping(
    samples: DataFrame, key: str = "sha256", order: tuple[str, ...] = ("image_path",),
    ident: str = "image_path",
) -> DataFrame:
    """Every removed sample next to the kept one, one row per removed sample.

    The long form has no per-hash array, so a hash with many copies stays spread
    over all tasks.
    """
    first = F.min(F.struct(*order, F.col(ident).alias("_ident")))
    groups = (
        samples.groupBy(key)
        .agg(first.alias("_first"), F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
        .select(key, F.col("_first._ident").alias("kept"), "copies")
    )
    rows = samples.select(key, F.col(ident).alias("removed"))
    return (
        join_per_key(rows, groups, key, "copies")
        .filter(F.col("removed") != F.col("kept"))
        .select(key, "kept", "removed", "copies")
    )
