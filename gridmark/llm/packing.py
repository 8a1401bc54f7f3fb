"""Packing documents into token sequences of a fixed length.

Token counts are made in one pass over the texts. The table of lengths (at most `capacity`
rows) is planned by `exact_fill`; pieces are put in order of length, and their rank within the
length names their place. A length that holds a third of all pieces spreads over many tasks,
because ranks are counted over ranges of rows, not in one group.

Defined results: a null text is empty (the end id alone); repeated rows are packed each on its
own; an empty table gives no rows; other columns are ignored; null doc_ids stay null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridmark.llm import worker_memory
from gridmark.llm.exact_fill import plan_sequences, slots
from gridmark.llm.tables import slices
from gridmark.llm.tokenizing import BATCH_BYTES, encoder
from gridmark.session import materialize

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, blank_joins_next: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of every document: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, blank_joins_next).encode
        for batch in (piece for whole in batches for piece in slices(whole, "text", BATCH_BYTES)):
            rows = []
            texts = batch.column("text").fill_null("").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    rows.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(worker_memory.trimmed(cut), PIECES)


def ranked_by_length(pieces: DataFrame) -> DataFrame:
    """Adds `rank`, from 0, of each piece among those of its length; no group is gathered in one task."""
    ordered = pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    numbered = materialize(ordered.withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    # At most one row for each length and one more for each task.
    groups = numbered.groupBy(part.alias("part"), "length").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("part", "length", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return (
        numbered.withColumn("part", part)
        .join(F.broadcast(groups), ["part", "length"])
        .withColumn("rank", F.col("row") - F.col("first") + F.col("before"))
        .drop("part", "first", "before", "row")
    )


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces with a `length` from 1 to capacity."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    place = slots(plan_sequences(counts, capacity))
    span = max(counts.values(), default=0) + 1

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = place["length"] * span + place["first"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            slot = np.searchsorted(keys, length * span + rank, side="right") - 1
            nth = rank - place["first"][slot]
            each = place["each"][slot]
            sequence = place["sequence"][slot] + nth // each
            offset = place["offset"][slot] + nth % each * length
            kept = [batch.column(name) for name in ("doc_id", "piece", "start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=names)

    return ranked_by_length(pieces).mapInArrow(placed, f"{PIECES}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents and their places in as few sequences as the plan finds."""
    return pack(materialize(token_pieces(docs, tokenizer, end_id, capacity)), capacity)
