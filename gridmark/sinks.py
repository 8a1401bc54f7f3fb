"""Writers and report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmark.config import SPLITS, SplitRatio
from gridmark.functions.paths import stem
from gridmark.operators.parallax import macro_average
from gridmark.operators.standardize import OUT_BOX, label_line
from gridmark.vocabulary import Vocabulary


def canonical_annotations(standardized: DataFrame, *keep: str) -> DataFrame:
    """Surviving boxes in canonical columns."""
    return standardized.filter(F.col("outcome") == "valid").select(
        *keep, "class_id", "class_name",
        *[F.col(c).alias(c.removeprefix("out_")) for c in OUT_BOX], "conf",
    )


def write_table(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite") -> None:
    """Canonical sink: Parquet, optionally partitioned."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def label_files(annotations: DataFrame, files: DataFrame) -> DataFrame:
    """(rel_path, content) of every label file; a file without boxes gets empty content.

    A label file is one output file, so its lines have to meet; they describe a
    single picture. Tables stay the sink for anything larger.
    """
    line = F.struct("line_number", label_line("").alias("text"))
    texts = annotations.groupBy("rel_path").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["text"]), "\n")
        .alias("_text")
    )
    content = F.when(F.col("_text").isNull(), "").otherwise(F.concat("_text", F.lit("\n")))
    return files.select("rel_path").join(texts, "rel_path", "left").select(
        "rel_path", content.alias("content")
    )


def dataset_files(samples: DataFrame) -> DataFrame:
    """(rel_path, copy_from) of every file of a built dataset: `images/<split>/` and `labels/<split>/`.

    Every image has a label file; that of a negative, or of a sample without one, is empty.
    """
    label = F.concat(F.lit("labels/"), "split", F.lit("/"), stem(F.col("export_name")), F.lit(".txt"))
    image = F.concat(F.lit("images/"), "split", F.lit("/"), "export_name")
    return samples.select(F.inline(F.array(
        F.struct(image.alias("rel_path"), F.col("image_path").alias("copy_from")),
        F.struct(label.alias("rel_path"), F.when(~F.col("is_negative"), F.col("label_path")).alias("copy_from")),
    )))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Small report rows as JSON lines in one file."""
    df.coalesce(1).write.mode(mode).json(path)


def write_parallax_report(images: DataFrame, target: str, dataset: str) -> None:
    """``diagnostics``, one row per image, and ``summary``, one JSON row of their means, below a target.

    Diagnostics grow with the images, so they are a table and no list within the summary, which is
    computed from the table as stored.
    """
    spark = images.sparkSession
    write_table(images, f"{target}/diagnostics")
    stored = spark.read.schema(images.schema).parquet(f"{target}/diagnostics")
    write_json(macro_average(stored).withColumn("dataset_dir", F.lit(dataset)), f"{target}/summary")


def append_metrics(df: DataFrame, path: str) -> None:
    """Append epochs to a metrics log."""
    df.write.mode("append").json(path)


def manifest_row(
    report: DataFrame, summary: DataFrame, classes: DataFrame, domains: DataFrame,
    ratios: SplitRatio, vocab: Vocabulary, name: str = "hybrid", version: str = "1.0.0",
) -> DataFrame:
    """One nested manifest row from the build's counter tables.

    The inputs are already aggregated: three splits, twelve classes, two domains.
    """
    per_split = classes.groupBy("split").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("class_id", "n")))).alias(
            "class_distribution"
        )
    )
    empty = F.create_map().cast("map<int,bigint>")
    full = summary.join(per_split, "split", "left").withColumn(
        "class_distribution", F.coalesce("class_distribution", empty)
    )
    body = F.struct(*[c for c in full.columns if c != "split"])
    by_name = F.array_sort(
        F.collect_list(F.struct("split", body.alias("body"))),
        lambda a, b: F.when(a["split"] < b["split"], -1).when(a["split"] > b["split"], 1).otherwise(0),
    )
    splits = full.agg(
        F.map_from_entries(by_name).alias("splits"),
        F.sum("total_pieces").alias("total_pieces"),
    )
    totals = domains.filter(F.col("facet") == "domain").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "images")))).alias("d")
    )
    literal_map = lambda items: F.create_map(*[F.lit(x) for kv in items for x in kv])
    return report.select(
        F.lit(name).alias("dataset_name"),
        F.lit(version).alias("version"),
        literal_map(zip(SPLITS, (ratios.train, ratios.val, ratios.test))).alias("split_ratios"),
        F.col("total_scanned").alias("total_images"),
        F.col("unique_retained").alias("total_unique_images"),
        F.col("duplicates_removed").alias("total_duplicates_removed"),
        splits.select("total_pieces").scalar().alias("total_pieces"),
        totals.select("d").scalar().alias("domain_totals"),
        splits.select("splits").scalar().alias("splits"),
        literal_map(vocab.canonical_names().items()).alias("class_names"),
    )


def audit_row(path: str, pairing: DataFrame, boxes: DataFrame, classes: DataFrame,
              verdict: DataFrame) -> DataFrame:
    """One nested audit report row; violations stay a table of their own."""
    ratio, rate = "negative_sample_ratio", "degenerate_box_rejection_rate"
    pair = pairing.select(F.struct(
        *[c for c in pairing.columns if c != ratio], F.round(ratio, 2).alias("negative_sample_ratio_pct"),
    )).scalar()
    box = boxes.select(F.struct(
        *[c for c in boxes.columns if c != rate], F.round(rate, 4).alias(f"{rate}_pct"),
    )).scalar()
    entries = lambda key, value: F.map_from_entries(
        F.sort_array(F.collect_list(F.struct(key, value)))
    )
    by_class = classes.agg(entries("class_id", "box_count")).scalar()
    by_type = classes.groupBy("piece_type").agg(F.sum("box_count").alias("n")).agg(
        entries("piece_type", "n")
    ).scalar()
    colored = lambda c: classes.agg(
        F.coalesce(F.sum(F.when(F.col("color") == c, F.col("box_count"))), F.lit(0))
    ).scalar()
    return verdict.select(
        F.lit(path).alias("dataset_path"),
        "passed", "error_count", "warning_count",
        pair.alias("pairing_summary"),
        box.alias("annotation_summary"),
        F.struct(
            by_class.alias("class_counts"),
            colored("white").alias("white_piece_count"),
            colored("black").alias("black_piece_count"),
            by_type.alias("piece_type_counts"),
        ).alias("class_distribution"),
    )
