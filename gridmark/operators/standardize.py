"""Raw boxes to canonical annotations, with one outcome per box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.functions import boxes
from gridmark.functions.once import compute_once
from gridmark.functions.tokens import to_double
from gridmark.operators.classes import map_classes
from gridmark.vocabulary import Vocabulary

# Columns of the clamped box.
OUT_BOX = ("out_xc", "out_yc", "out_w", "out_h")
# Outcomes in order of precedence.
OUTCOMES = ("unknown_class", "out_of_bounds", "degenerate", "valid")


def parse_tokens(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Label tokens to typed columns; ``parsed`` is false for lines that are dropped uncounted."""
    token = lambda i: F.get(F.col(tokens), F.lit(i))
    numbers = {n: to_double(token(i)) for i, n in enumerate(("xc", "yc", "w", "h"), start=1)}
    conf = F.when(F.size(tokens) > 5, to_double(token(5))).otherwise(1.0)
    parsed = F.size(tokens) >= 5
    for name in (*numbers, "conf"):
        parsed = parsed & F.col(name).isNotNull()
    return compute_once(
        df, {"raw_label": token(0), **numbers, "conf": conf}
    ).withColumn("parsed", parsed)


def standardize(
    df: DataFrame,
    vocab: Vocabulary | None = None,
    label: str = "raw_label",
    dataset: str | None = None,
    digits_are_ids: bool = True,
) -> DataFrame:
    """Map the class, clamp the box and test its size; nothing is dropped.

    Needs ``xc, yc, w, h`` and the label column. Adds ``class_id``,
    ``class_name``, ``outcome``, ``was_clamped`` and the clamped ``out_*`` box.
    """
    vocab = vocab or Vocabulary()
    mapped = map_classes(df, vocab, label, dataset, digits_are_ids=digits_are_ids)
    cut = boxes.clamp(boxes.from_yolo(), vocab.sanitize)
    parts = dict(zip(OUT_BOX, (cut.box.xc, cut.box.yc, cut.box.w, cut.box.h)))
    clamped = compute_once(mapped, {"_visible": cut.visible, "was_clamped": cut.moved, **parts})
    out_box = boxes.from_yolo(*OUT_BOX)
    outcome = (
        F.when(F.col("class_id").isNull(), "unknown_class")
        .when(~F.col("_visible"), "out_of_bounds")
        .when(~boxes.is_valid(out_box, vocab.sanitize), "degenerate")
        .otherwise("valid")
    )
    names = F.get(F.array(*[F.lit(n) for n in vocab.names]), F.col("class_id"))
    return (
        clamped.withColumn("class_name", names).withColumn("outcome", outcome).drop("_visible")
    )


def valid_annotations(standardized: DataFrame) -> DataFrame:
    """Only the boxes that survive."""
    return standardized.filter(F.col("outcome") == "valid")


def sanitization_stats(standardized: DataFrame, *by: str) -> DataFrame:
    """Counters per group; partial aggregation merges them, as adding two counters would."""
    outcome = F.col("outcome")
    return standardized.groupBy(*by).agg(
        F.count("*").alias("total_annotations"),
        F.count_if(outcome == "valid").alias("valid_annotations"),
        F.count_if((outcome == "valid") & F.col("was_clamped")).alias("clamped_annotations"),
        F.count_if(outcome == "degenerate").alias("discarded_degenerate"),
        F.count_if(outcome == "out_of_bounds").alias("discarded_out_of_bounds"),
        F.count_if(outcome == "unknown_class").alias("discarded_unknown_class"),
    )


def class_counts(annotations: DataFrame, *by: str) -> DataFrame:
    """Long counter table (group, class, n)."""
    return annotations.groupBy(*by, "class_id").agg(F.count("*").alias("n"))


def merge_counts(*counters: DataFrame) -> DataFrame:
    """Add counter tables key by key; every column but ``n`` is part of the key."""
    first, *rest = counters
    merged = first
    for other in rest:
        merged = merged.unionByName(other)
    keys = [c for c in first.columns if c != "n"]
    return merged.groupBy(*keys).agg(F.sum("n").alias("n"))


def counts_to_map(counts: DataFrame, *by: str) -> DataFrame:
    """Counter table to one map per group.

    One entry per class id, so the collected array is bounded by the ontology.
    """
    entries = F.sort_array(F.collect_list(F.struct("class_id", "n")))
    return counts.groupBy(*by).agg(F.map_from_entries(entries).alias("class_counts"))


def label_line(prefix: str = "out_"):
    """Canonical text line ``class xc yc w h`` with six decimals."""
    parts = [F.format_string("%.6f", F.col(prefix + c)) for c in ("xc", "yc", "w", "h")]
    return F.concat_ws(" ", F.col("class_id").cast("string"), *parts)
