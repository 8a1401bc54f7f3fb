"""Audit a dataset folder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark import sinks
from gridmark.config import AuditConfig
from gridmark.operators import audit, pairing
from gridmark.session import materialize
from gridmark.sources import images, labels, listing


@dataclass(frozen=True)
class Audited:
    """Lazy audit results; ``lines`` and ``pairs`` are None when the target is missing."""

    path: str
    violations: DataFrame
    pairs: DataFrame | None = None
    lines: DataFrame | None = None

    @property
    def verdict(self) -> DataFrame:
        return audit.verdict(self.violations)

    @property
    def pairing(self) -> DataFrame:
        return pairing.pairing_counters(self.pairs)

    @property
    def boxes(self) -> DataFrame:
        return audit.box_counters(self.lines)

    @property
    def histogram(self) -> DataFrame:
        return audit.class_histogram(self.lines)

    @property
    def report(self) -> DataFrame:
        """One nested row with all sections."""
        return sinks.audit_row(self.path, self.pairing, self.boxes, self.histogram, self.verdict)

    def preview(self, limit: int = 50) -> DataFrame:
        return audit.preview(self.violations, limit)


def audit_folder(spark: SparkSession, root: str, cfg: AuditConfig = AuditConfig()) -> Audited:
    """Pair images and labels, check images, and audit every line of matched labels.

    Pairs and audited lines are stored once, so that the sections of the report neither read a file nor decode a
    picture again.
    """
    given, root = root, listing.qualified(spark, root)
    if not listing.exists(root):
        return Audited(given, audit.missing_target(spark, given))
    tree = listing.list_files(spark, root)
    pairs = pairing.discover_pairs(tree, cfg)
    contents = labels.read_label_text(spark, root).select(
        F.col("rel_path").alias("label_path"), labels.is_blank().alias("_blank"), "content"
    )
    # Orphan labels keep their NULL-free path; orphan images get a key that matches nothing.
    probe = F.coalesce("label_path", F.concat(F.lit("?"), F.col("pair_key")))
    blank = contents.select(F.col("label_path").alias("_label"), "_blank")
    pairs = (
        pairs.join(blank, probe == F.col("_label"), "left")
        .withColumn("label_is_empty", F.coalesce("_blank", F.lit(True)))
        .drop("_label", "_blank")
    )
    if cfg.validate_image_decoding:
        errors = images.image_errors(spark, root, tree).withColumnRenamed("rel_path", "_image")
        probe = F.coalesce("image_path", F.concat(F.lit("?"), F.col("pair_key")))
        pairs = pairs.join(errors, probe == F.col("_image"), "left").drop("_image")
    pairs = materialize(pairs)
    matched = pairing.matched(pairs).select("label_path")
    lines = labels.label_lines(contents.drop("_blank").join(matched, "label_path", "left_semi"))
    audited = materialize(audit.audit_lines(lines, cfg))
    violations = pairing.pair_violations(pairs).unionByName(
        audit.line_violations(audited, file="label_path")
    )
    return Audited(given, violations, pairs, audited)


def audit_folders(spark: SparkSession, roots: list[str], cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """Report rows of several targets, one per target; missing ones have no sections."""
    reports = [audit_folder(spark, root, cfg) for root in roots]
    rows = [
        a.report if a.pairs is not None
        else a.verdict.select(F.lit(a.path).alias("dataset_path"), "passed", "error_count", "warning_count")
        for a in reports
    ]
    union = rows[0]
    for row in rows[1:]:
        union = union.unionByName(row, allowMissingColumns=True)
    return union
