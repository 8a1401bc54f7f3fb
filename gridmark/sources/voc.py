"""Pascal VOC annotation documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.functions import boxes
from gridmark.functions.once import compute_once
from gridmark.functions.tokens import strip

DOCUMENT = (
    "size STRUCT<width: STRING, height: STRING>, "
    "object ARRAY<STRUCT<name: STRING, bndbox: STRUCT<xmin: STRING, ymin: STRING, "
    "xmax: STRING, ymax: STRING>>>"
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per XML file with its path."""
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.xml")
    return parse_text(text.select(F.col("_metadata.file_path").alias("path"), "value"))


def parse_text(documents: DataFrame, text: str = "value") -> DataFrame:
    """Documents that arrive as text rows; numbers stay text until they are checked."""
    rest = [c for c in documents.columns if c != text]
    parsed = F.from_xml(F.col(text), DOCUMENT, {"mode": "PERMISSIVE"})
    return compute_once(documents, {"_doc": parsed}).select(
        *rest,
        F.col("_doc.size").isNotNull().alias("has_size"),
        F.coalesce(F.trim("_doc.size.width").try_cast("int"), F.lit(0)).alias("width"),
        F.coalesce(F.trim("_doc.size.height").try_cast("int"), F.lit(0)).alias("height"),
        F.col("_doc.object").alias("objects"),
    )


def invalid_documents(documents: DataFrame) -> DataFrame:
    """Documents without a usable image size, as violation rows."""
    reason = F.when(~F.col("has_size"), "XML lacks a size element").otherwise(
        F.format_string("Invalid image dimensions %dx%d", F.col("width"), F.col("height"))
    )
    return documents.filter(~boxes.has_image_size(F.col("width"), F.col("height"))).select(
        F.col("path").alias("file_path"),
        F.lit(None).cast("int").alias("line_number"),
        F.lit("malformed_line").alias("violation_type"),
        F.lit("ERROR").alias("severity"),
        reason.alias("description"),
        F.lit("").alias("raw_content"),
    )


def objects(documents: DataFrame) -> DataFrame:
    """Normalised boxes of named objects in documents with a usable size."""
    usable = documents.filter(boxes.has_image_size(F.col("width"), F.col("height")))
    flat = usable.select(
        *[c for c in usable.columns if c not in ("objects", "has_size")], F.inline("objects")
    )
    named = flat.withColumn("raw_label", strip(F.coalesce("name", F.lit("")))).filter(
        (F.col("raw_label") != "") & F.col("bndbox").isNotNull()
    )
    edges = ("xmin", "ymin", "xmax", "ymax")
    numbers = compute_once(named, {
        f"_{e}": F.coalesce(F.trim(F.col(f"bndbox.{e}")), F.lit("0")).try_cast("double") for e in edges
    })
    box = boxes.from_pixel_corners(
        *[F.col(f"_{e}") for e in edges], F.col("width"), F.col("height")
    )
    kept = [c for c in named.columns if c not in ("name", "bndbox", "width", "height")]
    placed = compute_once(numbers, dict(zip(("xc", "yc", "w", "h"), (box.xc, box.yc, box.w, box.h))))
    return placed.select(*kept, "xc", "yc", "w", "h", F.lit(1.0).alias("conf"))
