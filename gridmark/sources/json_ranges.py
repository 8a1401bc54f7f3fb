"""Elements of arrays in large JSON files, read by byte ranges in parallel.

A range of a JSON file means nothing without what came before it: whether it begins within a string, and which
containers are open. Both are found without reading the file in order. The first pass summarises
every range for each state it may begin in: the state it ends in, how many containers it closes that it did not
open, and those it opens and leaves open. The driver chains the summaries, a few numbers a range. The second pass reads each range
once more in its now known context and yields the elements that begin in it, following the last one beyond its end.
Files of one range need no first pass. A file may hold several documents, one after the other.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.errors import GridmarkError
from gridmark.sources import listing

RANGE = 4 << 20  # bytes
LOOK_BACK = 512  # bytes in which the key of a container must begin
MORE = 1 << 16
MOST_TASKS = 10_000
OUTSIDE, STRING, ESCAPE = 0, 1, 2  # states: outside strings, within one, there after a backslash
CONTEXT = "path string, start bigint, end bigint, state int, opens array<struct<at: bigint, array: boolean, key: string>>"

_DEPTH = np.zeros(256, np.int8)
_DEPTH[list(b"{[")] = 1
_DEPTH[list(b"}]")] = -1
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$')


@dataclass
class Scan:
    """Structural characters of a range that begins in a known state."""

    at: np.ndarray  # places of brackets outside strings
    char: np.ndarray
    depth: np.ndarray  # after each of them, from 0 at the start
    state: int  # at the end

    @property
    def closed(self) -> int:
        return max(0, -int(self.depth.min(initial=0)))

    def left_open(self) -> np.ndarray:
        """Indexes of the openers that are not closed within the range."""
        least = np.minimum.accumulate(self.depth[::-1])[::-1]
        return np.flatnonzero((_DEPTH[self.char] > 0) & (least >= self.depth))


def scan(data: bytes, state: int) -> Scan:
    raw = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(raw == 34)
    plain = raw != 92
    if plain.all():
        before = np.where(quotes == 0, int(state == ESCAPE), 0)
        trailing = 0 if len(raw) else int(state == ESCAPE)
    else:
        # Backslashes right before a place: up to the last other byte; those before the range count as one if it begins escaped.
        last = np.maximum.accumulate(np.where(plain, np.arange(len(raw), dtype=np.int64), -1))
        run = lambda i: np.where(i > 0, i - 1 - last[i - 1], 0) + np.where((i == 0) | (last[i - 1] < 0), int(state == ESCAPE), 0)
        before = run(quotes)
        trailing = int(run(np.array([len(raw)]))[0])
    quotes = quotes[before % 2 == 0]
    marks = np.flatnonzero(_DEPTH[raw])
    outside = (np.searchsorted(quotes, marks) + (state != OUTSIDE)) % 2 == 0
    marks = marks[outside]
    inside = (len(quotes) + (state != OUTSIDE)) % 2 == 1
    end = OUTSIDE if not inside else ESCAPE if trailing % 2 else STRING
    return Scan(marks, raw[marks], np.cumsum(_DEPTH[raw[marks]], dtype=np.int64), end)


def read_bytes(path: str, start: int, end: int) -> bytes:
    """Bytes of a range of a file, fewer at its end."""
    if listing.is_local(path):
        with open(listing.plain(path), "rb") as handle:
            handle.seek(start)
            return handle.read(end - start)
    system, inner = listing.file_system(path)
    with system.open_input_file(inner) as handle:
        return handle.read_at(min(end, handle.size()) - start, start) if start < handle.size() else b""


def key_before(data: bytes) -> str | None:
    """The key that data ends with, before the value that follows."""
    found = _KEY.search(data[-LOOK_BACK:])
    return json.loads(b'"' + found.group(1) + b'"') if found else None


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "start", "end", "state", "after", "closed", "at", "array"]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            data = read_bytes(r["path"], r["start"], r["end"])
            for state in (OUTSIDE, STRING, ESCAPE):
                found = scan(data, state)
                left = found.left_open()
                rows.append((r["path"], r["start"], r["end"], state, found.state, found.closed,
                             (found.at[left] + r["start"]).tolist(), (found.char[left] == 91).tolist()))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_())]
        yield pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], k) for i, k in enumerate(kinds)], names=names)


def _contexts(summaries: list) -> Iterator[tuple]:
    """(path, start, end, state, open containers) of every range, in order of each file."""
    by_file: dict[str, dict[int, dict[int, object]]] = {}
    for row in summaries:
        by_file.setdefault(row["path"], {}).setdefault(row["start"], {})[row["state"]] = row
    for path, ranges in sorted(by_file.items()):
        state, opens = OUTSIDE, []
        for start in sorted(ranges):
            row = ranges[start][state]
            yield path, start, row["end"], state, list(opens)
            if row["closed"] > len(opens):
                raise GridmarkError(f"{path} is not JSON: more is closed than opened before byte {row['end']}")
            opens = opens[: len(opens) - row["closed"]]
            for at, array in zip(row["at"], row["array"], strict=True):
                # Only keys of a document's own containers and of theirs matter.
                keyed = 0 < len(opens) < 3 and not opens[-1][1]
                key = key_before(read_bytes(path, max(0, at - LOOK_BACK), at)) if keyed else None
                opens.append((at, array, key))
            state = row["after"]


def ranges(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """Byte ranges of all files below a path, with the state and the open containers each begins with."""
    root = listing.qualified(spark, path)
    files = listing.list_files(spark, root) if listing.is_folder(root) else spark.createDataFrame([(root, listing.file_size(root))], "path string, length bigint")
    # As Spark's own readers do, leave out hidden files.
    files = files.where("length > 0").where(~F.substring_index("path", "/", -1).rlike("^[._]"))
    none = F.array().cast("array<struct<at: bigint, array: boolean, key: string>>")
    small = files.where(F.col("length") <= size).select("path", F.lit(0).cast("bigint").alias("start"), F.col("length").alias("end"), F.lit(OUTSIDE).alias("state"), none.alias("opens"))
    parts = files.where(F.col("length") > size).select(
        "path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(size).cast("bigint"))).alias("start"), F.least("length", F.col("start") + size).alias("end")
    )
    count = parts.count()
    if not count:
        return small
    spread = parts.repartition(min(count, MOST_TASKS), "path", "start")
    summary = "path string, start bigint, end bigint, state int, after int, closed bigint, at array<bigint>, array array<boolean>"
    known = list(_contexts(spread.mapInArrow(_summaries, summary).collect()))
    large = spark.createDataFrame(known, CONTEXT).repartition(min(count, MOST_TASKS), "path", "start")
    return large.unionByName(small)


@dataclass
class Elements:
    """Elements of one wanted array that begin in a range."""

    document: int  # where the document begins
    kind: str
    values: list[dict]


def elements(row: dict, wanted: dict[tuple[str, ...], str]) -> Iterator[Elements]:
    """Objects in the arrays at the wanted key paths (of one or two keys) that begin in a range."""
    path, start, end = row["path"], row["start"], row["end"]
    head = min(start, LOOK_BACK)
    data = read_bytes(path, start - head, end)
    found = scan(data[head:], row["state"])
    opens = [(o["at"], o["array"], o["key"]) for o in row["opens"]]
    at, depth = found.at + start, found.depth + len(opens)
    rising = _DEPTH[found.char] > 0
    # Containers near the root, those open at the start first: place, depth they are opened at, array, key.
    near = [(o[0], i, o[1], o[2], -1) for i, o in enumerate(opens[:3])]
    shallow = np.flatnonzero(rising & (depth <= 2) | rising & (depth == 3) & (found.char == 91))
    for i in shallow.tolist():
        key = key_before(data[: head + int(found.at[i])]) if depth[i] > 1 else None
        near.append((int(at[i]), int(depth[i]) - 1, bool(found.char[i] == 91), key, i))
    line: list[tuple] = []
    for place, level, array, key, index in near:
        line = [*line[:level], (place, key)]
        keys = tuple(k for _, k in line[1:])
        if not array or len(line) != level + 1 or keys not in wanted:
            continue
        inside = level + 1  # the depth of the array's elements before they open
        below = np.flatnonzero(depth[index + 1 :] < inside)
        last = index + 1 + int(below[0]) if len(below) else len(depth)
        span = slice(index + 1, last)
        firsts = found.at[span][rising[span] & (depth[span] == inside + 1)]
        ends = found.at[span][~rising[span] & (depth[span] == inside)]
        if not len(firsts):
            continue
        ends = ends[ends > firsts[0]]
        text = data[head + int(firsts[0]) : head + int(ends[-1]) + 1] if len(ends) == len(firsts) else (
            data[head + int(firsts[0]) :] + _rest(path, end, found.state, int(depth[-1]) - inside))
        yield Elements(line[0][0], wanted[keys], [v for v in json.loads(b"[" + text + b"]") if isinstance(v, dict)])


def _rest(path: str, end: int, state: int, depth: int) -> bytes:
    """What follows a range up to the end of the element that is open there at a depth."""
    parts = []
    while depth > 0:
        data = read_bytes(path, end, end + MORE)
        if not data:
            raise GridmarkError(f"{path} ends within an element")
        found = scan(data, state)
        done = np.flatnonzero(found.depth + depth == 0)
        if len(done):
            return b"".join([*parts, data[: int(found.at[done[0]]) + 1]])
        parts.append(data)
        end, state = end + len(data), found.state
        depth += int(found.depth[-1]) if len(found.depth) else 0
    return b"".join(parts)
