"""Matching images with their label files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.config import AuditConfig
from gridmark.functions import paths
from gridmark.operators.audit import (
    CORRUPTED_IMAGE, ORPHAN_IMAGE, ORPHAN_LABEL, percent,
)


def discover_pairs(files: DataFrame, cfg: AuditConfig = AuditConfig()) -> DataFrame:
    """One row per logical key with its image and label, either of which may be NULL.

    ``files`` has ``rel_path`` (relative to the dataset root). The full outer
    join of images and labels is one aggregation over both kinds, so there is a
    single shuffle with map-side combining. Of several images of one key the
    last one scanned wins.
    """
    path = F.col("rel_path")
    is_image = paths.is_listed_image(path, cfg.image_extensions)
    candidates = files.withColumn("_image", is_image).filter(
        F.col("_image") | paths.is_label(path)
    )
    rank = F.struct(paths.scan_rank(path, cfg.image_extensions).alias("r"), path.alias("p"))
    return (
        candidates.withColumn("pair_key", paths.logical_stem(path))
        .groupBy("pair_key")
        .agg(
            F.max(F.when(F.col("_image"), rank)).getField("p").alias("image_path"),
            F.max(F.when(~F.col("_image"), path)).alias("label_path"),
        )
    )


def orphan_labels(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("image_path").isNull())


def orphan_images(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("label_path").isNull())


def matched(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("image_path").isNotNull() & F.col("label_path").isNotNull())


def pair_violations(pairs: DataFrame) -> DataFrame:
    """Orphans, and corrupted images where ``image_error`` is present."""
    kind = F.when(F.col("image_path").isNull(), ORPHAN_LABEL).when(
        F.col("label_path").isNull(), ORPHAN_IMAGE
    )
    text = F.when(
        kind == ORPHAN_LABEL,
        F.concat(F.lit("Label file has no image: "), paths.base_name(F.col("label_path"))),
    ).otherwise(F.concat(F.lit("Image file has no label: "), paths.base_name(F.col("image_path"))))
    if "image_error" in pairs.columns:
        broken = F.col("label_path").isNotNull() & F.col("image_error").isNotNull()
        kind = kind_or(kind, broken, CORRUPTED_IMAGE)
        text = F.when(
            kind == CORRUPTED_IMAGE,
            F.concat(F.lit("Image cannot be decoded: "), F.col("image_error")),
        ).otherwise(text)
    return pairs.select(
        F.coalesce(
            F.when(kind == ORPHAN_LABEL, F.col("label_path")), F.col("image_path")
        ).alias("file_path"),
        F.lit(None).cast("int").alias("line_number"),
        kind.alias("violation_type"),
        F.lit("ERROR").alias("severity"),
        text.alias("description"),
        F.lit("").alias("raw_content"),
    ).filter(F.col("violation_type").isNotNull())


def kind_or(kind, condition, fallback: str):
    return F.coalesce(kind, F.when(condition, fallback))


def pairing_counters(pairs: DataFrame) -> DataFrame:
    """Images, labels, matches, orphans, negatives and corrupted images.

    Negatives (``label_is_empty``) and corrupted images (``image_error``) count
    for matched pairs only.
    """
    image, label = F.col("image_path").isNotNull(), F.col("label_path").isNotNull()
    both = image & label
    empty = F.col("label_is_empty") if "label_is_empty" in pairs.columns else F.lit(False)
    broken = (
        F.col("image_error").isNotNull() if "image_error" in pairs.columns else F.lit(False)
    )
    negatives = F.count_if(both & empty)
    return pairs.agg(
        F.count_if(image).alias("total_images_scanned"),
        F.count_if(label).alias("total_labels_scanned"),
        F.count_if(both).alias("matched_pairs_count"),
        F.count_if(image & ~label).alias("orphaned_images_count"),
        F.count_if(label & ~image).alias("orphaned_labels_count"),
        negatives.alias("negative_samples_count"),
        F.count_if(both & broken).alias("corrupted_images_count"),
        percent(negatives, F.count_if(both)).alias("negative_sample_ratio"),
    )


def attach_labels(images: DataFrame, labels: DataFrame, labels_dir: str | None = None) -> DataFrame:
    """Label of each image by stem.

    With ``labels_dir`` only that folder counts. Otherwise a ``labels`` folder
    next to the image's own folder is preferred over a label beside the image.
    Both frames have ``path``. Label paths are unique, so every join is many to
    one; images that share a stem and one explicit folder share a key, which the
    adaptive skew join splits on the image side.
    """
    def candidate(name: str):
        return labels.select(F.col("path").alias(name))

    here = paths.parent(F.col("path"))
    name = F.concat(F.lit("/"), paths.stem(F.col("path")), F.lit(".txt"))
    if labels_dir is not None:
        wanted = F.concat(F.lit(labels_dir.rstrip("/")), name)
        return images.join(candidate("_explicit"), wanted == F.col("_explicit"), "left").select(
            *images.columns, F.col("_explicit").alias("label_path")
        )
    sibling = F.concat(paths.parent(here), F.lit("/labels"), name)
    beside = F.concat(here, name)
    return (
        images.join(candidate("_sibling"), sibling == F.col("_sibling"), "left")
        .join(candidate("_beside"), beside == F.col("_beside"), "left")
        .select(*images.columns, F.coalesce("_sibling", "_beside").alias("label_path"))
    )


def annotated_pairs(files: DataFrame) -> DataFrame:
    """Images with a non-empty label, found in three places.

    An image under ``images/`` uses the mirrored path under ``labels/``. Any
    other image uses the label beside it, or else the one in a ``labels`` folder
    next to its own folder. ``files`` has ``rel_path`` and ``length``.
    """
    labels = files.filter((paths.extension(F.col("rel_path")) == ".txt") & (F.col("length") > 0))
    images = files.filter(
        paths.extension(F.col("rel_path")).isin(".jpg", ".jpeg", ".png", ".bmp", ".webp")
    )
    path = F.col("rel_path")
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    above = F.regexp_replace(folder, r"[^/]*/$", "")
    text_name = F.concat(paths.stem(path), F.lit(".txt"))
    mirrored = path.startswith("images/")
    first = F.when(
        mirrored, F.concat(F.lit("labels/"), F.substr(folder, F.lit(8)), text_name)
    ).otherwise(F.concat(folder, text_name))
    second = F.when(~mirrored, F.concat(above, F.lit("labels/"), text_name)).otherwise(
        _no_match(path)
    )
    label = lambda name: labels.select(F.col("rel_path").alias(name))
    return (
        images.join(label("_first"), first == F.col("_first"), "left")
        .join(label("_second"), second == F.col("_second"), "left")
        .select(
            F.col("rel_path").alias("image_path"),
            F.coalesce("_first", "_second").alias("label_path"),
        )
        .filter(F.col("label_path").isNotNull())
    )


def sample_rows(images: DataFrame, label_counts: DataFrame) -> DataFrame:
    """Samples with piece counts and the negative flag.

    ``images`` carries ``label_path``, ``domain``, ``source_name`` and an
    optional ``force_negative``; ``label_counts`` has one row per label with
    ``label_path`` and ``n_pieces``. A sample without label or without any
    counted class is negative.
    """
    forced = F.col("force_negative") if "force_negative" in images.columns else F.lit(False)
    pieces = F.coalesce("n_pieces", F.lit(0))
    counted = label_counts.withColumnRenamed("label_path", "_counted")
    probe = F.coalesce(F.col("label_path"), _no_match(F.col("path")))
    return (
        images.join(counted, probe == F.col("_counted"), "left")
        .withColumn("is_negative", forced | (pieces == 0))
        .withColumn("n_pieces", pieces)
        .drop("force_negative", "_counted")
    )


def _no_match(path):
    """A join key that equals no path: absent keys spread out instead of meeting in one task."""
    return F.concat(F.lit("?"), path)


def first_pairs(pairs: DataFrame, n: int) -> DataFrame:
    """The first pairs by image path, as many as a report shows; every task sends that many at most."""
    return pairs.orderBy("image_path").limit(n)
