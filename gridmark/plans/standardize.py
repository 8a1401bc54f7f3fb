"""Standardise a folder of label files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark import sinks
from gridmark.file_sink import write_files
from gridmark.functions.paths import is_label
from gridmark.operators import standardize as ops
from gridmark.sources import labels, listing
from gridmark.vocabulary import Vocabulary


@dataclass(frozen=True)
class Standardized:
    """Lazy results of a standardisation."""

    boxes: DataFrame
    files: DataFrame

    @property
    def annotations(self) -> DataFrame:
        return sinks.canonical_annotations(self.boxes, "rel_path", "line_number")

    @property
    def stats(self) -> DataFrame:
        return ops.sanitization_stats(self.boxes)

    @property
    def class_counts(self) -> DataFrame:
        return ops.class_counts(ops.valid_annotations(self.boxes))

    def write(self, target: str) -> DataFrame:
        """One canonical label file per input file, all or none; returns (rel_path, length) of what is there then."""
        return write_files(sinks.label_files(self.annotations, self.files), target)


def standardize_folder(
    spark: SparkSession, root: str, dataset: str | None = None, vocab: Vocabulary | None = None
) -> Standardized:
    """Parse, map, clamp and test every label line below a folder."""
    parsed = labels.parse_labels(labels.label_lines(labels.read_label_text(spark, root)))
    tagged = parsed.withColumn("dataset", F.lit(dataset).cast("string"))
    boxes = ops.standardize(tagged, vocab, dataset="dataset" if dataset else None)
    files = listing.list_files(spark, root).filter(is_label(F.col("rel_path")))
    return Standardized(boxes, files)
