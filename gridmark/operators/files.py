"""Checks on file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.functions.paths import extension


def verify_checksums(expected: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Status of every expected file: verified, mismatch, missing or unchecked.

    ``expected`` has ``expected_md5`` (NULL when none is published, any case),
    ``files`` has ``actual_md5``; both are unique on ``key``.
    """
    want, got = F.lower("expected_md5"), F.lower("actual_md5")
    status = (
        F.when(F.col("_present").isNull(), "missing")
        .when(want.isNull(), "unchecked")
        .when(want == got, "verified")
        .otherwise("mismatch")
    )
    present = files.select(key, "actual_md5", F.lit(True).alias("_present"))
    return expected.join(present, key, "left").withColumn("status", status).drop("_present")


def inventory(files: DataFrame, *by: str, path: str = "path") -> DataFrame:
    """Images, annotation files and all files per group."""
    ext = F.lower(extension(F.col(path)))
    # Extensions counted as images and as annotations.
    return files.groupBy(*by).agg(
        F.count_if(ext.isin(".jpg", ".jpeg", ".png", ".bmp", ".webp")).alias("images"),
        F.count_if(ext.isin(".json", ".xml", ".txt")).alias("annotations"),
        F.count("*").alias("total_files"),
    )


def name_collisions(samples: DataFrame, split: str = "split", name: str = "export_name") -> DataFrame:
    """Export names used more than once in a split; they would overwrite each other."""
    return (
        samples.groupBy(split, name).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    )
