"""Range and format checks of the result contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmark.config import DOMAINS
from gridmark.functions.classes import clean_square_name


def in_unit_range(value: Column) -> Column:
    return F.coalesce(value.between(0.0, 1.0), F.lit(False))


def box_checks(x_min: Column, y_min: Column, x_max: Column, y_max: Column, conf: Column) -> dict[str, Column]:
    """Named predicates that hold for a valid pixel box."""
    positive = F.coalesce(F.least(x_min, y_min, x_max, y_max) >= 0.0, F.lit(False))
    return {
        "negative_coordinate": positive,
        "inverted_x": F.coalesce(x_max >= x_min, F.lit(False)),
        "inverted_y": F.coalesce(y_max >= y_min, F.lit(False)),
        "confidence_range": in_unit_range(conf),
    }


def classification_checks(domain: Column, confidence: Column, method: Column, latency: Column) -> dict[str, Column]:
    """Named predicates that hold for a valid domain classification."""
    return {
        "unknown_domain": F.coalesce(domain.isin(*DOMAINS), F.lit(False)),
        "confidence_range": in_unit_range(confidence),
        "unknown_method": F.coalesce(method.isin("heuristic", "neural"), F.lit(False)),
        "negative_latency": F.coalesce(latency >= 0.0, F.lit(False)),
    }


def square_checks(name: Column, file_idx: Column, rank_idx: Column) -> dict[str, Column]:
    """Named predicates that hold for a valid board square."""
    return {
        "bad_square_name": clean_square_name(name).isNotNull(),
        "bad_file_index": F.coalesce(file_idx.between(0, 7), F.lit(False)),
        "bad_rank_index": F.coalesce(rank_idx.between(0, 7), F.lit(False)),
    }


def contract_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Add the array of broken checks and whether the row is valid."""
    broken = F.array_compact(
        F.array(*[F.when(~holds, F.lit(name)) for name, holds in checks.items()])
    )
    return df.withColumn("broken", broken).withColumn("is_valid", F.size("broken") == 0)
