"""Assemble a deduplicated, split dataset from several source pools."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark import sinks
from gridmark.config import SplitRatio
from gridmark.errors import EmptyDatasetError
from gridmark.file_sink import write_files
from gridmark.functions.paths import export_name, is_label
from gridmark.operators import dedup, files, pairing, split, summary
from gridmark.session import discard, materialize
from gridmark.sources import images, labels, listing
from gridmark.vocabulary import Vocabulary

COUNTS = "class_counts"


def scan_pool(
    spark: SparkSession, root: str, domain: str, source_name: str, is_negative: bool = False,
    labels_dir: str | None = None, pool_order: int = 0, hashes: DataFrame | None = None,
) -> DataFrame:
    """Samples of one folder: image, label, hash, class counts and negative flag.

    Labels are looked up under ``labels_dir`` when it is given and there, else in
    a parallel ``labels`` folder (also the one beside the root itself), else
    beside the image. ``hashes`` are those of ``images.hash_table``, which reads only what changed since
    an earlier run; else every image is read. Of equal images the build keeps that of the smallest ``pool_order``.
    """
    root = listing.qualified(spark, root)
    tree = listing.list_files(spark, root)
    found = images.scan_images(tree, domain, source_name, is_negative)
    hashed = images.with_hashes(found, images.content_hashes(spark, root) if hashes is None else hashes)
    explicit = labels_dir is not None and listing.exists(listing.qualified(spark, labels_dir))
    if explicit:
        roots = [listing.qualified(spark, labels_dir)]
    else:
        beside = f"{root.rpartition('/')[0]}/labels"
        roots = [root, *([beside] if beside != root and listing.exists(beside) else [])]
    label_files, per_label = None, None
    for place in roots:
        files_here = (tree if place == root else listing.list_files(spark, place)).filter(is_label(F.col("rel_path")))
        counted = _label_counts(spark, place)
        label_files = files_here if label_files is None else label_files.unionByName(files_here)
        per_label = counted if per_label is None else per_label.unionByName(counted)
    paired = pairing.attach_labels(hashed, label_files, roots[0] if explicit else None)
    samples = pairing.sample_rows(paired, per_label).withColumn("pool_order", F.lit(pool_order))
    return samples.withColumnRenamed("path", "image_path").drop("length", "rel_path")


def _label_counts(spark: SparkSession, root: str) -> DataFrame:
    """label_path, class counts and pieces of every label below a qualified root."""
    counted = labels.label_class_counts(labels.read_label_text(spark, root))
    label_path = F.concat(F.lit(root + "/"), F.col("rel_path"))
    return counted.groupBy("rel_path").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class_id", "n")))).alias(COUNTS),
        F.sum("n").alias("n_pieces"),
    ).select(label_path.alias("label_path"), COUNTS, "n_pieces")


@dataclass(frozen=True)
class Built:
    """Lazy results of a build; nothing is written to a target before ``write`` or ``export``.

    They read the stored scan. As a context manager, a build deletes it at the end; else it goes when the driver ends.
    """

    scanned: DataFrame
    samples: DataFrame
    ratios: SplitRatio
    vocab: Vocabulary

    def __enter__(self) -> Built:
        return self

    def __exit__(self, *error) -> None:
        discard(self.scanned)

    @property
    def report(self) -> DataFrame:
        return dedup.dedup_report(self.scanned)

    @property
    def duplicates(self) -> DataFrame:
        return dedup.duplicate_mapping(self.scanned, order=_order(self.scanned))

    @property
    def split_summary(self) -> DataFrame:
        return summary.split_summary(self.samples)

    @property
    def class_counts(self) -> DataFrame:
        """Long counters (split, class_id, n)."""
        return self.samples.select("split", F.explode(COUNTS).alias("class_id", "n"))

    @property
    def crosstab(self) -> DataFrame:
        return summary.class_crosstab(self.class_counts)

    @property
    def collisions(self) -> DataFrame:
        """Export names that would overwrite each other; rows are never lost."""
        return files.name_collisions(self.samples)

    @property
    def manifest(self) -> DataFrame:
        return sinks.manifest_row(
            self.report, self.split_summary, summary.class_distribution(self.class_counts),
            summary.domain_totals(self.samples), self.ratios, self.vocab,
        )

    def export(self, target: str) -> DataFrame:
        """Images and labels as files below `images/<split>` and `labels/<split>`, all or none; returns (rel_path, length)."""
        return write_files(sinks.dataset_files(self.samples), target)

    def write(self, target: str) -> None:
        """Samples partitioned by split, and the manifest."""
        sinks.write_table(self.samples, f"{target}/samples", "split")
        sinks.write_json(self.manifest, f"{target}/manifest")


def _order(samples: DataFrame) -> tuple[str, ...]:
    return ("pool_order", "image_path") if "pool_order" in samples.columns else ("image_path",)


def build_dataset(
    samples: DataFrame, ratios: SplitRatio = SplitRatio(), seed: int = 42,
    vocab: Vocabulary | None = None, target: str | None = None,
) -> Built:
    """Deduplicate, split and summarise; writes only when a target is given.

    The scanned samples, hashes included, are stored once in the shared folder,
    also for a dry run: report, duplicates, split and every summary read that
    copy, each with only the columns it needs, so no file is read twice. Of equal
    images the first by (pool order, path) stays.
    """
    samples = materialize(samples)
    if samples.isEmpty():
        raise EmptyDatasetError("cannot build a dataset from an empty sample pool")
    unique = dedup.deduplicate(samples, order=_order(samples))
    assigned = split.stratified_split(unique, ratios=ratios, seed=seed).withColumn(
        "export_name", export_name(F.col("domain"), F.col("source_name"), F.col("image_path"))
    )
    built = Built(samples, assigned, ratios, vocab or Vocabulary())
    if target is not None:
        built.write(target)
    return built
