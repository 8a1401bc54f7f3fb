"""Quantiles from mergeable sketches, for groups that keep growing.

A sketch of a group is a few kilobytes whatever the group's size. Sketches of new data are merged with stored ones, so
old rows are never read again; exact order statistics (``evaluate.percentiles``) read all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 800  # of a sketch; see ``rank_error``


def rank_error(size: int = SIZE) -> float:
    """How far, as a share of the rows, the rank of an answer may lie from the one asked for (99 percent confidence)."""
    return 2.296 / size**0.9723  # fixed values: the published error of KLL sketches


def quantile_sketches(df: DataFrame, group: list[str], value: str, size: int = SIZE) -> DataFrame:
    """One row per group: its keys, ``sketch``, ``n``. NULL and NaN values are not counted; a group without others has no row."""
    kept = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return kept.groupBy(*group).agg(
        F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"), F.count("*").alias("n")
    )


def merge_sketches(sketches: DataFrame, group: list[str], size: int = SIZE) -> DataFrame:
    """Sketches of finer groups or of several parts as one per group; ``group`` may be empty."""
    return sketches.groupBy(*group).agg(F.kll_merge_agg_double("sketch", size).alias("sketch"), F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, group: list[str], quantiles: dict[str, float]) -> DataFrame:
    """The given quantiles of every sketch, by name; 0.0 and 1.0 are the exact extremes."""
    found = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in quantiles.items()]
    return sketches.select(*group, "n", *found)


def append_sketches(df: DataFrame, path: str, group: list[str], value: str, part: str, size: int = SIZE) -> None:
    """Store the sketches of one part of the data, named by ``part``; storing a part again replaces it."""
    quantile_sketches(df, group, value, size).write.mode("overwrite").parquet(f"{path}/part={part}")


def stored_sketches(spark: SparkSession, path: str, group: list[str], size: int = SIZE) -> DataFrame:
    """All stored parts, merged."""
    return merge_sketches(spark.read.parquet(path), group, size)
