"""Image files: content hashes, decodability and pixels."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.config import IMAGE_EXTENSIONS
from gridmark.functions.headers import has_size, picture_header
from gridmark.functions.paths import is_image, is_listed_image
from gridmark.sources.listing import list_files, open_file, qualified, relative_path

# The JVM decodes the others; of these the header is read.
_BY_HEADER = (".webp",)
MODIFIED = ["path", "length", "modified"]  # what tells whether a file is still the one that was hashed
BUFFER = 1 << 20


def _glob(extensions: tuple[str, ...]) -> str:
    letters = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    return "{" + ",".join("*" + letters(e) for e in extensions) + "}"


def scan_images(files: DataFrame, domain: str, source_name: str, is_negative: bool = False) -> DataFrame:
    """Images of one pool, tagged with domain and source."""
    return files.filter(is_image(F.col("rel_path"))).select(
        "path", "rel_path", "length",
        F.lit(domain).alias("domain"),
        F.lit(source_name).alias("source_name"),
        F.lit(is_negative).alias("force_negative"),
    )


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 and MD5 of every non-empty image below a root."""
    root = qualified(spark, root)
    raw = spark.read.format("binaryFile").load(
        root, recursiveFileLookup=True, pathGlobFilter=_glob(IMAGE_EXTENSIONS)
    )
    return raw.select(
        relative_path(F.col("_metadata.file_path"), root).alias("rel_path"),
        F.sha2("content", 256).alias("sha256"),
        F.md5("content").alias("actual_md5"),
    )


def hash_table(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """path, rel_path, length, modified, sha256, actual_md5 of every image below a root.

    ``known`` is such a table of an earlier run. Files whose path, length and time of change it holds keep their hashes
    and are not read; only the others are, a buffer at a time. Files that are gone drop out.
    """
    files = list_files(spark, root, modified=True).filter(is_image(F.col("rel_path")))
    fresh = files if known is None else files.join(known, MODIFIED, "left_anti")
    hashed = fresh.mapInArrow(_hashed, fresh.schema.simpleString()[7:-1].replace(":", " ") + ", sha256 string, actual_md5 string")
    if known is None:
        return hashed
    same = files.join(known.select(*MODIFIED, "sha256", "actual_md5").dropDuplicates(MODIFIED), MODIFIED)
    return hashed.unionByName(same.select(hashed.columns))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            sha256, md5 = hashlib.sha256(), hashlib.md5(usedforsecurity=False)
            with open_file(path) as handle:
                while block := handle.read(BUFFER):
                    sha256.update(block)
                    md5.update(block)
            found.append((sha256.hexdigest(), md5.hexdigest()))
        columns = [*batch.columns, *[pa.array([f[i] for f in found], pa.string()) for i in range(2)]]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sha256", "actual_md5"])


def with_hashes(images: DataFrame, hashes: DataFrame) -> DataFrame:
    """Attach hashes by path; an empty file has the hash of nothing.

    A file that has content must have a hash: the job stops if one is missing,
    because a made-up hash would merge it with other files.
    """
    empty = F.sha2(F.lit("").cast("binary"), 256)
    missing = F.raise_error(F.concat(F.lit("no content hash for "), F.col("path")))
    return (
        images.join(hashes.select("rel_path", "sha256"), "rel_path", "left")
        .withColumn("sha256", F.when(F.col("length") == 0, empty).otherwise(F.coalesce("sha256", missing)))
    )


def decoded_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = IMAGE_EXTENSIONS) -> DataFrame:
    """image_id (relative path), size, channels and BGR bytes; height is -1 when undecodable."""
    root = qualified(spark, root)
    raw = spark.read.format("image").load(
        root, recursiveFileLookup=True, pathGlobFilter=_glob(extensions)
    )
    return raw.select(
        relative_path(F.col("image.origin"), root).alias("image_id"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
    )


def image_errors(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """(rel_path, image_error) of images that are empty or cannot be decoded."""
    root = qualified(spark, root)
    listed = files.filter(is_listed_image(F.col("rel_path"))).select("rel_path", "length")
    jvm = tuple(e for e in IMAGE_EXTENSIONS if e not in _BY_HEADER)
    sizes = decoded_images(spark, root, jvm).select(
        F.col("image_id").alias("rel_path"), ((F.col("height") > 0) & (F.col("width") > 0)).alias("ok")
    )
    raw = spark.read.format("binaryFile").load(root, recursiveFileLookup=True, pathGlobFilter=_glob(_BY_HEADER))
    header = picture_header(F.col("content"))
    sizes = sizes.unionByName(raw.select(
        relative_path(F.col("_metadata.file_path"), root).alias("rel_path"), (has_size(header) & header["complete"]).alias("ok"),
    ))
    error = F.when(F.col("length") == 0, "Image file is 0 bytes (empty file)").when(
        ~F.coalesce("ok", F.lit(False)), "Image cannot be decoded"
    )
    return (
        listed.join(sizes, "rel_path", "left")
        .select("rel_path", error.alias("image_error"))
        .filter(F.col("image_error").isNotNull())
    )

