"""The audit rule chain over label lines or numeric boxes, and its reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.config import AuditConfig
from gridmark.functions import boxes
from gridmark.functions.classes import color_of, name_of, piece_type_of
from gridmark.functions.once import compute_once
from gridmark.functions.tokens import strip, to_double, to_int, words
from gridmark.vocabulary import NUM_CLASSES

# Violation kinds a line can have, in the order they are tested.
MALFORMED = "malformed_line"
BAD_CLASS = "invalid_class_id"
NOT_FINITE = "nan_or_inf_value"
NON_POSITIVE = "non_positive_dimension"
OUTSIDE = "out_of_bounds_coord"
DEGENERATE = "degenerate_box"
# Violation kinds a file or a pair can have.
ORPHAN_IMAGE = "orphan_image"
ORPHAN_LABEL = "orphan_label"
CORRUPTED_IMAGE = "corrupted_image"
MISSING_FILE = "missing_file"

VIOLATION_COLUMNS = (
    "file_path", "line_number", "violation_type", "severity", "description", "raw_content",
)
VIOLATION_SCHEMA = (
    "file_path STRING, line_number INT, violation_type STRING, severity STRING, "
    "description STRING, raw_content STRING"
)


def _rules(
    df: DataFrame, malformed: Column, class_id: Column, box: boxes.Box, cfg: AuditConfig
) -> DataFrame:
    """First failing rule per row, plus the clamp and validity flags."""
    eps = cfg.epsilon
    x0, y0, x1, y1 = box.edges
    high = 1.0 + eps
    outside = (
        ~box.xc.between(-eps, high) | ~box.yc.between(-eps, high)
        | (box.w > high) | (box.h > high)
        | (x0 < -eps) | (y0 < -eps) | (x1 > high) | (y1 > high)
    )
    small = (
        (box.w < cfg.min_dimension) | (box.h < cfg.min_dimension)
        | (box.w * box.h < cfg.min_area)
    )
    kind = (
        F.when(malformed, MALFORMED)
        .when(~F.coalesce(class_id.between(0, cfg.num_classes - 1), F.lit(False)), BAD_CLASS)
        .when(~box.is_finite, NOT_FINITE)
        .when((box.w <= 0.0) | (box.h <= 0.0), NON_POSITIVE)
        .when(outside, OUTSIDE)
        .when(small, DEGENERATE)
    )
    beyond = (x0 < 0.0) | (y0 < 0.0) | (x1 > 1.0) | (y1 > 1.0)
    for centre in (box.xc, box.yc):
        beyond = beyond | ~centre.between(0.0, 1.0)
    reached_clamp = F.col("violation_type").isNull() | (F.col("violation_type") == DEGENERATE)
    strict = cfg.strict_degenerate_as_error
    severity = F.when(F.col("violation_type") == DEGENERATE, "ERROR" if strict else "WARNING").when(
        F.col("violation_type").isNotNull(), "ERROR"
    )
    corrupted = F.coalesce(F.col("severity") == "ERROR", F.lit(False))
    return (
        compute_once(df, {"violation_type": kind})
        .withColumn("severity", severity)
        .withColumn("is_corrupted", corrupted)
        .withColumn("is_minor_clamp", reached_clamp & F.coalesce(beyond, F.lit(False)))
    )


def audit_boxes(df: DataFrame, cfg: AuditConfig = AuditConfig(), cls: str = "cls") -> DataFrame:
    """Audit a numeric annotation table with columns ``xc, yc, w, h`` and a class id."""
    audited = _rules(df, F.lit(False), F.col(cls), boxes.from_yolo(), cfg)
    return audited.withColumn("class_id", F.col(cls).cast("int"))


def audit_lines(df: DataFrame, cfg: AuditConfig = AuditConfig(), line: str = "line") -> DataFrame:
    """Audit label text lines; blank and comment lines must already be gone.

    Adds the parsed columns, ``violation_type``, ``severity``, ``description``
    and the two flags.
    """
    split = compute_once(df, {"_tokens": words(F.col(line))})
    token = lambda i: F.get(F.col("_tokens"), F.lit(i))
    numbers = {n: to_double(token(i)) for i, n in enumerate(("xc", "yc", "w", "h"), start=1)}
    parsed = compute_once(
        split,
        {
            "n_tokens": F.size("_tokens"),
            "class_token": token(0),
            "class_id": to_int(token(0)),
            **numbers,
        },
    ).drop("_tokens")
    audited = _rules(
        parsed, F.col("n_tokens") < 5, F.col("class_id"), boxes.from_yolo(), cfg
    )
    text = strip(F.col(line))
    fixed = lambda pattern, *cols: F.format_string(pattern, *[F.col(c) for c in cols])
    kind = F.col("violation_type")
    description = (
        F.when(kind == MALFORMED, F.concat(
            F.lit("Expected at least 5 tokens (class_id xc yc w h), got "),
            F.col("n_tokens").cast("string"), F.lit(": "), text))
        .when((kind == BAD_CLASS) & F.col("class_id").isNull(), F.concat(
            F.lit("Class ID must be an integer, got "), F.col("class_token")))
        .when(kind == BAD_CLASS, F.concat(
            F.lit("Class ID "), F.col("class_id").cast("string"),
            F.lit(f" out of canonical range [0, {cfg.num_classes - 1}]")))
        .when(kind == NOT_FINITE, F.concat(
            F.lit("Coordinates contain NaN, Inf or text: "), text))
        .when(kind == NON_POSITIVE, fixed("Dimensions must be positive: w=%s, h=%s", "w", "h"))
        .when(kind == OUTSIDE, fixed(
            "Coordinates outside [0, 1]: xc=%.5f, yc=%.5f, w=%.5f, h=%.5f", "xc", "yc", "w", "h"))
        .when(kind == DEGENERATE, fixed(
            "Degenerate box below minimum threshold (w=%.5f, h=%.5f)", "w", "h"))
    )
    return audited.withColumn("description", description).drop("class_token")


def line_violations(audited: DataFrame, file: str = "file_path", number: str = "line_number",
                    raw: str = "line") -> DataFrame:
    """Violation rows of audited lines, in the common violation schema."""
    return audited.filter(F.col("violation_type").isNotNull()).select(
        F.col(file).alias("file_path"),
        F.col(number).cast("int").alias("line_number"),
        "violation_type", "severity", "description",
        F.col(raw).alias("raw_content"),
    )


def missing_target(spark: SparkSession, path: str) -> DataFrame:
    """The single violation of an audit whose target does not exist."""
    row = (path, None, MISSING_FILE, "ERROR", f"Target dataset does not exist: {path}", "")
    return spark.createDataFrame([row], VIOLATION_SCHEMA)


def violation_counts(violations: DataFrame, *by: str) -> DataFrame:
    return violations.groupBy(*by, "violation_type", "severity").agg(F.count("*").alias("n"))


def box_counters(audited: DataFrame, *by: str) -> DataFrame:
    """Scanned, valid, corrupted, degenerate and clamped boxes, and the rejection rate."""
    scanned = F.count("*")
    degenerate = F.count_if(F.col("violation_type") == DEGENERATE)
    return audited.groupBy(*by).agg(
        scanned.alias("total_boxes_scanned"),
        F.count_if(~F.col("is_corrupted")).alias("valid_boxes_count"),
        F.count_if(F.col("is_corrupted")).alias("corrupted_boxes_count"),
        degenerate.alias("degenerate_boxes_count"),
        F.count_if(F.col("is_minor_clamp")).alias("clamped_boxes_count"),
        percent(degenerate, scanned).alias("degenerate_box_rejection_rate"),
    )


def verdict(violations: DataFrame, *by: str) -> DataFrame:
    """Errors, warnings and whether the audit passed."""
    errors = F.count_if(F.col("severity") == "ERROR")
    return violations.groupBy(*by).agg(
        errors.alias("error_count"),
        F.count_if(F.col("severity") == "WARNING").alias("warning_count"),
        (errors == 0).alias("passed"),
    )


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, zero for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        part.cast("double") / F.when(whole != 0, whole).cast("double") * 100.0
    )


def class_histogram(audited: DataFrame, bar_width: int = 24) -> DataFrame:
    """Valid boxes per class, zero-filled, with share and bar length.

    One partial aggregation with twelve counters; only the twelve result rows
    meet in the final step.
    """
    valid = ~F.col("is_corrupted")
    per_class = [
        F.count_if(valid & (F.col("class_id") == c)).alias(f"c{c}") for c in range(NUM_CLASSES)
    ]
    counts = audited.agg(*per_class).select(
        F.posexplode(F.array(*[F.col(f"c{c}") for c in range(NUM_CLASSES)])).alias("class_id", "n"),
        F.greatest(*[F.col(f"c{c}") for c in range(NUM_CLASSES)]).alias("top"),
        sum((F.col(f"c{c}") for c in range(1, NUM_CLASSES)), F.col("c0")).alias("total"),
    )
    whole = F.greatest(F.col("total"), F.lit(1))
    bar = F.rint(F.col("n") / F.greatest(F.col("top"), F.lit(1)).cast("double") * bar_width)
    return counts.select(
        F.col("class_id"),
        name_of(F.col("class_id")).alias("class_name"),
        color_of(F.col("class_id")).alias("color"),
        piece_type_of(F.col("class_id")).alias("piece_type"),
        F.col("n").alias("box_count"),
        (F.col("n") / whole.cast("double") * 100.0).alias("share_pct"),
        bar.cast("int").alias("bar_length"),
    )


def color_type_balance(audited: DataFrame) -> DataFrame:
    """Valid boxes by colour and by piece type in one pass (long form)."""
    valid = audited.filter(~F.col("is_corrupted")).select(
        color_of(F.col("class_id")).alias("color"), piece_type_of(F.col("class_id")).alias("piece_type")
    )
    return (
        valid.groupingSets([["color"], ["piece_type"]], "color", "piece_type")
        .agg(F.count("*").alias("n"))
        .select(
            F.when(F.col("color").isNotNull(), "color").otherwise("piece_type").alias("facet"),
            F.coalesce("color", "piece_type").alias("value"),
            "n",
        )
    )


def preview(violations: DataFrame, limit: int = 50, *order: str) -> DataFrame:
    """First violations of a report with the number of rows left out.

    ``limit`` is the size of the printed report; Spark keeps the top rows of
    every partition, so only ``limit`` rows per task travel.
    """
    keys = order or ("file_path", "line_number", "violation_type")
    total = violations.agg(F.count("*")).scalar()
    return violations.orderBy(*keys).limit(limit).withColumn(
        "n_more", F.greatest(F.lit(0), total - F.lit(limit))
    )
