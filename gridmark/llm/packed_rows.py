"""Moving many small records between tasks as a few packed rows.

Records are arrays of equal length. Those of one Arrow batch that go to the same bucket travel as
one row of binary columns, so that Spark shuffles thousands of bytes a row instead of one record. Numbers
lie byte by byte, all first bytes first: the leading zeros of ids and places are then runs, which the shuffle compresses.
Buckets are far more than tasks and get their records by hash; a key that is frequent is one of
many in its bucket, and the caller sees to it that such a key is cheap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def schema(names: list[str]) -> str:
    return ", ".join(["bucket int", *[f"{name} binary" for name in names]])


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows of a bucket in one task, two buckets a task or so.

    Buckets are at least twice the session's shuffle partitions; where the volume asks for more, tasks follow it, so
    that what a task holds stays as large as it is.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return rows.repartition(buckets // 2, "bucket") if buckets > 2 * usual else rows.repartition("bucket")


def scatter(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row a bucket, its records in their order."""
    order = np.argsort(bucket, kind="stable")
    sorted_ = bucket[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    firsts = np.concatenate([[0], cuts]) if len(order) else np.zeros(0, np.int64)
    ends = np.append(cuts, len(order)) if len(order) else firsts
    arrays = [pa.array(sorted_[firsts].astype(np.int32))]
    for values in columns.values():
        planes = values[order].view(np.uint8).reshape(len(order), values.dtype.itemsize)
        blobs = [planes[a:b].T.tobytes() for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
        arrays.append(pa.array(blobs, pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *columns])


def gather(batches: Iterator[pa.RecordBatch], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """All records of a task's packed rows, as one array a column."""
    parts: dict[str, list[bytes]] = {name: [] for name in kinds}
    for batch in batches:
        for name in kinds:
            parts[name].extend(batch.column(name).to_pylist())
    return {name: unpack(parts[name], kind) for name, kind in kinds.items()}


def unpack(blobs: list[bytes], kind: str) -> np.ndarray:
    """The records of packed values of one column."""
    size = np.dtype(kind).itemsize
    rows = [np.frombuffer(b, np.uint8).reshape(size, -1).T for b in blobs]
    joined = np.concatenate(rows) if rows else np.zeros((0, size), np.uint8)
    return np.ascontiguousarray(joined).view(kind).reshape(-1)
