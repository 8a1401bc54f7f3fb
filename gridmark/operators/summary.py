"""Manifest counters of a built dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.config import DIGITAL, PHYSICAL, SPLITS
from gridmark.functions.classes import name_of
from gridmark.vocabulary import NUM_CLASSES


def split_summary(samples: DataFrame, pieces: str = "n_pieces") -> DataFrame:
    """Images, images per domain, negatives and pieces of every split."""
    return samples.groupBy("split").agg(
        F.count("*").alias("total_images"),
        F.count_if(F.col("domain") == PHYSICAL).alias("physical_count"),
        F.count_if(F.col("domain") == DIGITAL).alias("digital_count"),
        F.count_if("is_negative").alias("negative_count"),
        F.coalesce(F.sum(pieces), F.lit(0)).alias("total_pieces"),
    )


def domain_totals(samples: DataFrame, pieces: str = "n_pieces") -> DataFrame:
    """Images and pieces per split, per domain and overall, in one pass."""
    grouped = samples.groupingSets([["split"], ["domain"], []], "split", "domain").agg(
        F.count("*").alias("images"),
        F.coalesce(F.sum(pieces), F.lit(0)).alias("pieces"),
        F.grouping_id().alias("_level"),
    )
    facet = F.when(F.col("_level") == 1, "split").when(F.col("_level") == 2, "domain")
    return grouped.select(
        F.coalesce(facet, F.lit("all")).alias("facet"),
        F.coalesce("split", "domain", F.lit("all")).alias("value"),
        "images",
        "pieces",
    )


def class_distribution(counts: DataFrame) -> DataFrame:
    """Pieces per split and class from long counters (split, class_id, n)."""
    return counts.groupBy("split", "class_id").agg(F.sum("n").alias("n"))


def class_crosstab(counts: DataFrame) -> DataFrame:
    """All twelve classes against the splits, zero-filled, with totals.

    One pass with conditional sums; the class side is a zero-filled dimension of
    twelve rows, and the aggregated side has at most one row per class.
    """
    spark = counts.sparkSession
    per_class = (
        counts.filter(F.col("class_id").between(0, NUM_CLASSES - 1))
        .groupBy("class_id")
        .agg(
            *[F.sum(F.when(F.col("split") == s, F.col("n"))).alias(s) for s in SPLITS],
            F.sum("n").alias("total"),
        )
    )
    classes = spark.range(NUM_CLASSES).select(F.col("id").cast("int").alias("class_id"))
    return classes.join(F.broadcast(per_class), "class_id", "left").select(
        "class_id",
        name_of(F.col("class_id")).alias("class_name"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in (*SPLITS, "total")],
    )
