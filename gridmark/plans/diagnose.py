"""Contact-anchor diagnostics and domain screening of image folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.config import ScreenWeights
from gridmark.operators import features, pairing, parallax, standardize
from gridmark.sinks import canonical_annotations, write_parallax_report
from gridmark.sources import images, labels, listing
from gridmark.vocabulary import Vocabulary


def paired_annotations(spark: SparkSession, root: str, vocab: Vocabulary | None = None,
                       first: int | None = None) -> DataFrame:
    """Standardised annotations of images that have a non-empty label.

    ``first`` keeps the first images by path, as a report size.
    """
    pairs = pairing.annotated_pairs(listing.list_files(spark, root))
    if first is not None:
        pairs = pairing.first_pairs(pairs, first)
    contents = labels.read_label_text(spark, root).withColumnRenamed("rel_path", "label_path")
    wanted = contents.join(pairs, "label_path").withColumnRenamed("image_path", "image_id")
    parsed = labels.parse_labels(labels.label_lines(wanted))
    return canonical_annotations(
        standardize.standardize(parsed, vocab), "image_id", "line_number"
    )


def write_contact_report(annotations: DataFrame, target: str, dataset: str) -> None:
    """Diagnostics of every image, and their summary."""
    write_parallax_report(contact_diagnostics(annotations), target, dataset)


def contact_diagnostics(annotations: DataFrame, sweep: bool = False) -> DataFrame:
    """Per-image accuracy, optionally for every sweep angle."""
    if sweep:
        return parallax.per_image(parallax.angle_sweep(annotations), "elevation_deg", "image_id")
    return parallax.per_image(parallax.assign_squares(annotations))


def screen_images(spark: SparkSession, root: str, weights: ScreenWeights = ScreenWeights(),
                  logits: DataFrame | None = None) -> DataFrame:
    """Domain of every decodable image; ambiguous ones use ``logits`` where present."""
    measured = features.thumbnail_features(images.decoded_images(spark, root), weights)
    fused = features.fuse_windows(measured, weights)
    if logits is None:
        return features.decide_domain(fused, weights)
    return features.route_tiers(fused, logits, "image_id", weights).withColumn(
        "heuristic_score", F.col("physical_score")
    )
