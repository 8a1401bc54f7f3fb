"""COCO-style annotation documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmark.functions import boxes
from gridmark.functions.once import compute_once
from gridmark.sources import json_ranges

IMAGE = "STRUCT<id: BIGINT, file_name: STRING, width: INT, height: INT>"
PIECE = "STRUCT<image_id: BIGINT, category_id: BIGINT, bbox: ARRAY<DOUBLE>, score: DOUBLE>"
DOCUMENT = (
    f"images ARRAY<{IMAGE}>, categories ARRAY<STRUCT<id: BIGINT, name: STRING>>, "
    f"annotations STRUCT<pieces: ARRAY<{PIECE}>>"
)
ELEMENT = (
    "path STRING, document BIGINT, kind STRING, id BIGINT, file_name STRING, width INT, height INT, name STRING, "
    "image_id BIGINT, category_id BIGINT, bbox ARRAY<DOUBLE>, score DOUBLE"
)
# Where elements stand in a document: boxes in one of two layouts.
ARRAYS = {("images",): "image", ("categories",): "category", ("annotations",): "piece", ("annotations", "pieces"): "piece"}
FEW_IMAGES = 16  # a document with more has its boxes shuffled; no result depends on it


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents with an explicit schema; one file may hold one multi-line document."""
    return spark.read.schema(DOCUMENT).json(path, multiLine=True).withColumn(
        "path", F.col("_metadata.file_path")
    )


def parse_text(documents: DataFrame, text: str = "value") -> DataFrame:
    """Documents that arrive as text rows."""
    parsed = F.from_json(F.col(text), DOCUMENT)
    rest = [c for c in documents.columns if c != text]
    return compute_once(documents, {"_doc": parsed}).select(*rest, "_doc.*")


def document_counts(documents: DataFrame) -> DataFrame:
    """Images, boxes and categories of every document."""
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    return documents.select(
        *[c for c in ("path",) if c in documents.columns],
        size("images").alias("images"),
        size("annotations.pieces").alias("boxes"),
        size("categories").alias("categories"),
    )


def annotations(documents: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Every annotation with the pixel size of its image, within its own document.

    Image ids are only unique in one document, and ``keys`` need not be: boxes never meet images of another
    row. Of images that a document lists twice the first by all its fields counts. A box whose image is not
    listed stays, with ``image_listed`` false and no box. Documents of few images are matched
    within their row; the boxes of others leave it before they meet their image, so one large
    document spreads over tasks. Files that hold more than a row should are read by ``read_elements``.
    """
    size = F.coalesce(F.array_size("images"), F.lit(0))
    listed = F.array_sort(F.filter("images", lambda i: i["id"].isNotNull()))
    image_of = lambda p: F.get(F.filter("_images", lambda i: i["id"] == p["image_id"]), F.lit(0))
    few = documents.filter(size <= FEW_IMAGES).withColumn("_images", listed).select(
        *keys, F.explode("annotations.pieces").alias("_piece"), "_images"
    ).select(*keys, "_piece", image_of(F.col("_piece")).alias("_image"))
    # Images and boxes of one document in one column, so that it is read once; its number tells equal keys apart.
    as_image = F.transform("images", lambda i: F.struct(i.alias("image"), F.lit(None).cast(PIECE).alias("piece")))
    as_piece = F.transform("annotations.pieces", lambda p: F.struct(F.lit(None).cast(IMAGE).alias("image"), p.alias("piece")))
    both = F.concat(F.coalesce(as_image, F.array()), F.coalesce(as_piece, F.array()))
    rows = documents.filter(size > FEW_IMAGES).withColumn("_document", F.monotonically_increasing_id()).select(
        *keys, "_document", F.explode(both).alias("_e")
    ).select(*keys, "_document", F.coalesce("_e.image.id", "_e.piece.image_id").alias("_id"), "_e.image", "_e.piece")
    first = F.min(F.when(F.col("image.id").isNotNull(), F.col("image"))).over(Window.partitionBy("_document", "_id"))
    many = rows.withColumn("_image", first).filter(F.col("piece").isNotNull()).select(
        *keys, F.col("piece").alias("_piece"), "_image"
    )
    return _placed(few.unionByName(many), keys)


def _placed(pieces: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Boxes in the unit square; pieces(keys, _piece, _image)."""
    flat = pieces.select(*keys, "_piece.*", *[F.col(f"_image.{c}").alias(c) for c in ("file_name", "width", "height")],
                         F.col("_image").isNotNull().alias("image_listed"))
    usable = flat.filter(F.col("category_id").isNotNull() & (F.array_size("bbox") >= 4))
    at = lambda i: F.get(F.col("bbox"), F.lit(i))
    box = boxes.from_coco(at(0), at(1), at(2), at(3), F.col("width"), F.col("height"))
    placed = compute_once(usable, dict(zip(("xc", "yc", "w", "h"), (box.xc, box.yc, box.w, box.h))))
    return placed.select(
        *keys, "file_name", "image_id",
        F.col("category_id").cast("string").alias("raw_label"),
        "xc", "yc", "w", "h",
        F.coalesce("score", F.lit(1.0)).alias("conf"),
        "image_listed",
        F.coalesce(boxes.has_image_size(F.col("width"), F.col("height")), F.lit(False)).alias("has_image_size"),
    )


def read_elements(spark: SparkSession, path: str, size: int = json_ranges.RANGE) -> DataFrame:
    """Images, categories and boxes of large documents, one row each, read by byte ranges.

    ``document`` is the place in the file where the document begins. Fields of another
    type than theirs are NULL.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("path", pa.string()), ("document", pa.int64()), ("kind", pa.string()), ("id", pa.int64()), ("file_name", pa.string()),
            ("width", pa.int32()), ("height", pa.int32()), ("name", pa.string()), ("image_id", pa.int64()), ("category_id", pa.int64()),
            ("bbox", pa.list_(pa.float64())), ("score", pa.float64()),
        ])
        takers = {"document": None, "kind": None, "path": None, "file_name": _text, "name": _text, "bbox": _numbers, "score": _number}
        for batch in batches:
            for row in batch.to_pylist():
                for part in json_ranges.elements(row, ARRAYS):
                    fixed = {"path": row["path"], "document": part.document, "kind": part.kind}
                    names = set().union(*part.values)
                    columns = [
                        pa.repeat(pa.scalar(fixed[f.name], f.type), len(part.values)) if f.name in fixed
                        else _column([v.get(f.name) for v in part.values], takers.get(f.name, _whole), f.type) if f.name in names
                        else pa.nulls(len(part.values), f.type)
                        for f in schema
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return json_ranges.ranges(spark, path, size).mapInArrow(read, ELEMENT)


def _column(values: list, taker: Callable, kind: pa.DataType) -> pa.Array:
    """Values of one field; a column that only holds its own type is taken whole."""
    found = set(map(type, values))
    if taker is _numbers and found == {list}:
        flat = list(chain.from_iterable(values))
        if set(map(type, flat)) <= {int, float}:
            ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
            return pa.ListArray.from_arrays(ends, pa.array(list(map(float, flat)), pa.float64()))
    if taker is _whole and found <= {int, type(None)} or taker is _text and found <= {str, type(None)} or taker is _number and found <= {float, type(None)}:
        return pa.array(values, kind)
    return pa.array([taker(v) for v in values], kind)


def _whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def _number(value) -> float | None:
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def _numbers(value) -> list[float | None] | None:
    return [_number(v) for v in value] if isinstance(value, list) else None


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def element_annotations(elements: DataFrame) -> DataFrame:
    """``annotations`` of documents that were read as elements; boxes meet their images in a shuffle or a broadcast."""
    keys = ["path", "document"]
    image = F.min(F.struct("id", "file_name", "width", "height")).alias("_image")
    images = elements.filter("kind = 'image' AND id IS NOT NULL").groupBy(*keys, F.col("id").alias("image_id")).agg(image)
    pieces = elements.filter("kind = 'piece'")
    joined = pieces.join(images, [*keys, "image_id"], "left")
    return _placed(joined.select(*keys, F.struct("image_id", "category_id", "bbox", "score").alias("_piece"), "_image"), tuple(keys))


def unlisted_images(found: DataFrame) -> DataFrame:
    """Violation rows: boxes of images that their document does not list."""
    return found.filter(~F.col("image_listed")).withColumn("violation_type", F.lit("unlisted_image"))
