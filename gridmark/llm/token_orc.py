"""Token ids of documents in ORC files, in ascending document order.

The id column is a list of integers, which ORC stores in stripes with integer run-length
encoding. Each stripe has row indexes, and a Bloom filter on doc_id, so that a reader opens
only the stripes that can hold a document; stripes of one file are read in parallel.

Defined results: a null text is empty (the end id alone); a null doc_id comes first; repeated
rows are written one by one; an empty table gives no rows; other columns are ignored. A very
long text is one row, handed on with few others in one Arrow batch.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmark.llm.tables import slices
from gridmark.llm.tokenizing import BATCH_BYTES, encoder
from gridmark.session import delete_at_end, shared_folder

WRITTEN = "doc_id bigint, part int, part_start bigint, ids array<int>"


def id_lists(blobs: list[bytes]) -> pa.Array:
    """A list column over the given little-endian 32-bit ids."""
    ends = np.cumsum([0] + [len(b) // 4 for b in blobs]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), "<i4")))


def write_token_orc(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, blank_joins_next: bool = True, stripe_bytes: int = 16 << 20
) -> None:
    """Write doc_id, ids (with the end id), and the place of the document in its part of the files.

    One range shuffle orders the texts; ids are made afterwards, so they are not shuffled.
    `part` numbers the ranges in ascending order, `part_start` counts the ids before a document in its part.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, blank_joins_next).encode
        part, start = TaskContext.get().partitionId(), 0
        for batch in (piece for whole in batches for piece in slices(whole, "text", BATCH_BYTES)):
            texts = batch.column("text").fill_null("").to_pylist()
            blobs = [ids + end for ids in encode(texts)]
            sizes = np.array([len(b) // 4 for b in blobs], np.int64)
            starts = start + np.cumsum(sizes) - sizes
            start += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(blobs), part, np.int32)), pa.array(starts), id_lists(blobs)],
                names=["doc_id", "part", "part_start", "ids"],
            )

    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encoded, WRITTEN)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", 1000)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; a list of doc_ids is pushed down to stripe statistics and Bloom filters."""
    files = spark.read.schema(WRITTEN).orc(path)
    return files if doc_ids is None else files.where(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    The number of parts is that of the writing tasks, so their running sum is a small table.
    """
    files = read_token_orc(spark, path)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            ends = ids.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), batch.column("part_start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    ends = files.groupBy("part").agg(F.max(F.col("part_start") + F.size("ids")).alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ends.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    rows = files.mapInArrow(summed, "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_orc(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files to the shared folder and return their index."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    write_token_orc(docs, path, tokenizer, end_id)
    delete_at_end(spark, path)
    return token_index(spark, path)
