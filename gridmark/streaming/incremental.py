"""Incremental twins of the audit and of the exact dedup, frame sampling, and the tables that streams keep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from gridmark.config import AuditConfig
from gridmark.functions.tokens import is_content
from gridmark.operators import audit
from gridmark.errors import GridmarkError
from gridmark.session import shared_folder
from gridmark.sources import labels, listing

BATCH, LEVEL = "batch_id", "level"
COMPACT_EVERY = 32  # batches that are folded into one folder of a keyed table


def read_label_stream(spark: SparkSession, root: str, files_per_trigger: int | None = None) -> DataFrame:
    """Lines of label files as they arrive."""
    options = {"wholetext": True, "recursiveFileLookup": True, "pathGlobFilter": "*.txt"}
    reader = spark.readStream.options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    contents = reader.text(root, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("content")
    )
    return labels.label_lines(contents)


def audit_counts(lines: DataFrame, cfg: AuditConfig = AuditConfig(), line: str = "line") -> DataFrame:
    """Boxes per violation kind and severity; valid boxes have NULL for both.

    The state has one row per kind, whatever the volume.
    """
    content = lines.filter(is_content(F.col(line)))
    return audit.violation_counts(audit.audit_lines(content, cfg, line))


def dedup_stream(samples: DataFrame, key: str = "sha256", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First arrival of every content hash; hashes older than the watermark leave the state."""
    return samples.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def first_frames(
    frames: DataFrame, stream: list[str], time: str = "ts", interval: str = "1 second",
    delay: str = "10 seconds", ties: tuple[str, ...] = (),
) -> DataFrame:
    """First frame of every stream in each tumbling interval, with the frames it stands for.

    The state is one row per stream and open interval: intervals behind the watermark leave
    it, and frames that arrive for them later are dropped. Frames of equal time are
    told apart by ``ties``. Columns: the stream keys, ``window_start``, ``window_end``, the first
    frame's other columns, ``frames``. A frame without a time belongs to no interval.
    """
    rest = [c for c in frames.columns if c not in stream]
    first = F.min_by(F.struct(*rest), F.struct(time, *ties))
    return (
        frames.withWatermark(time, delay)
        .groupBy(*stream, F.window(time, interval).alias("_window"))
        .agg(first.alias("_first"), F.count("*").alias("frames"))
        .select(*stream, F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"),
                *[F.col(f"_first.{c}").alias(c) for c in rest], "frames")
    )


def run_once(
    stream: DataFrame, mode: str = "append", target: str | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Process all available input and return the stored result; no input at all gives no rows.

    ``append`` results go to a Parquet table. ``complete`` results replace it
    after every batch. ``update`` results, the changed rows of a batch, are merged by ``keys``
    into a keyed table. Table and checkpoint live in the shared folder unless a
    target is given, so a restarted run continues where the last one stopped.
    """
    spark = stream.sparkSession
    base = target or f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    table, checkpoint = f"{base}/table", f"{base}/checkpoint"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if mode == "append":
        writer = writer.format("parquet").option("path", table)
    elif mode == "complete":
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(table))
    elif not keys:
        raise GridmarkError("updates need the keys they are merged by")
    else:
        writer = writer.foreachBatch(lambda batch, number: merge_batch(batch, number, table, keys))
    writer.trigger(availableNow=True).start().awaitTermination()
    if mode == "update":
        return read_keyed(spark, table, stream.schema, keys)
    if not listing.exists(listing.qualified(spark, table)):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(table)


def merge_batch(batch: DataFrame, number: int, table: str, keys: list[str]) -> None:
    """Store the changed rows of one batch in a folder named by its number.

    A batch that runs again after a failure replaces its own folder, so it counts once. Now and
    then the folders so far are folded into one of their newest rows. They are removed only after the fold is
    complete; until then both hold the same rows, of which a reader takes one per key.
    """
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{table}/{LEVEL}=0/{BATCH}={number}")
    if number % COMPACT_EVERY != COMPACT_EVERY - 1:
        return
    newest = read_keyed(spark, table, batch.schema, keys)
    newest.write.mode("overwrite").parquet(f"{table}/{LEVEL}=1/{BATCH}={number}")
    covered = [f"{LEVEL}=0/{BATCH}={n}" for n in range(number - COMPACT_EVERY + 1, number + 1)]
    for folder in [*covered, f"{LEVEL}=1/{BATCH}={number - COMPACT_EVERY}"]:
        listing.remove(spark, f"{table}/{folder}")


def read_keyed(spark: SparkSession, table: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The newest row of every key; NULL is a key like any other."""
    if not listing.exists(listing.qualified(spark, table)):
        return spark.createDataFrame([], schema)
    stored = StructType([*schema.fields, StructField(LEVEL, IntegerType()), StructField(BATCH, LongType())])
    rows = spark.read.schema(stored).parquet(table)
    rest = [c for c in schema.names if c not in keys]
    newest = F.max_by(F.struct(*rest, F.lit(0).alias("_")), F.struct(BATCH, LEVEL)).alias("_newest")
    return rows.groupBy(*keys).agg(newest).select(
        *[F.col(c) if c in keys else F.col(f"_newest.{c}").alias(c) for c in schema.names]
    )
