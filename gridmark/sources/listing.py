"""File listing as a data source.

The built-in file sources drop empty files, yet an empty label marks a negative
sample and an empty image is a defect. This source lists every file with its
size. The driver only reads the names in the first directory levels to form partitions;
sizes, and all that lies deeper, are looked up inside tasks. A folder of very many files is shared by
several tasks, each of which looks up the files its part of the names' hashes has.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridmark.schemas import LISTING

FORMAT = "gridmark_files"
PARTITION_LEVELS = 2
COUNTED_FOLDERS = 1000  # of the deepest level that the driver sees, beyond which it does not count their files
PART_FILES, MOST_PARTS = 10_000, 256


def is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def plain(path: str) -> str:
    """Path without a file scheme and trailing slash."""
    return (urlparse(path).path if path.startswith("file:") else path).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The absolute form of a path, as Spark resolves it; local paths lose their scheme."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return plain(full)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, through the file system Spark writes with; nothing there is fine."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def file_system(path: str):
    """Arrow's file system of a remote path; it knows the object store Hadoop calls s3a as s3."""
    from pyarrow import fs

    for scheme in ("s3a://", "s3n://"):
        if path.startswith(scheme):
            path = "s3://" + path[len(scheme):]
    return fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    """Whether a dataset folder is there (one metadata call)."""
    if is_local(path):
        return os.path.exists(plain(path))
    from pyarrow import fs

    system, inner = file_system(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def is_folder(path: str) -> bool:
    if is_local(path):
        return os.path.isdir(plain(path))
    from pyarrow import fs

    system, inner = file_system(path)
    return system.get_file_info(inner).type == fs.FileType.Directory


def file_size(path: str) -> int:
    if is_local(path):
        return os.path.getsize(plain(path))
    system, inner = file_system(path)
    return system.get_file_info(inner).size


def open_file(path: str):
    """A file to read bytes from."""
    if is_local(path):
        return open(plain(path), "rb")
    system, inner = file_system(path)
    return system.open_input_stream(inner)


def entries(path: str, wanted: Callable[[str], bool] | None = None) -> Iterator[tuple[str, bool, int, datetime | None]]:
    """(path, is directory, size, time of change) of one directory level; only wanted files are looked at further."""
    if is_local(path):
        with os.scandir(plain(path)) as found:
            for entry in found:
                if entry.is_dir():
                    yield entry.path, True, 0, None
                elif wanted is None or wanted(entry.name):
                    known = entry.stat()
                    yield entry.path, False, known.st_size, datetime.fromtimestamp(known.st_mtime, UTC)
        return
    from pyarrow import fs

    system, inner = file_system(path)
    scheme = path[: path.index(inner)] if inner in path else ""
    for info in system.get_file_info(fs.FileSelector(inner)):
        folder = info.type == fs.FileType.Directory
        if folder or wanted is None or wanted(info.base_name):
            yield scheme + info.path, folder, info.size or 0, info.mtime


def names(path: str) -> tuple[list[str], int]:
    """Folders and the number of files of one directory level; files are not looked at further."""
    if not is_local(path):
        found = [e[:2] for e in entries(path)]
        return [p for p, folder in found if folder], sum(not folder for _, folder in found)
    folders, files = [], 0
    with os.scandir(plain(path)) as found:
        for entry in found:
            if entry.is_dir():
                folders.append(entry.path)
            else:
                files += 1
    return folders, files


class _Folder(InputPartition):
    """Share ``part`` of ``parts`` of a folder's files, by a hash of their names."""

    def __init__(self, path: str, deep: bool, part: int = 0, parts: int = 1) -> None:
        self.path, self.deep, self.part, self.parts = path, deep, part, parts

    def holds(self, name: str) -> bool:
        return self.parts == 1 or zlib.crc32(os.fsencode(name)) % self.parts == self.part


class _Reader(DataSourceReader):
    def __init__(self, root: str, modified: bool) -> None:
        self.root, self.modified = plain(root), modified

    def partitions(self) -> list[InputPartition]:
        level, parts = [self.root], []
        for depth in range(PARTITION_LEVELS + 1):
            deep = depth == PARTITION_LEVELS
            if deep and len(level) > COUNTED_FOLDERS:
                return parts + [_Folder(folder, True) for folder in level]
            below = []
            for folder in level:
                folders, files = names(folder)
                below += folders
                n = min(MOST_PARTS, max(1, files // PART_FILES))
                parts += [_Folder(folder, deep, i, n) for i in range(n)]
            level = below
        return parts

    def read(self, partition: _Folder) -> Iterator[tuple]:
        pending = [partition.path]
        while pending:
            for path, is_dir, size, time in entries(pending.pop(), partition.holds):
                if not is_dir:
                    row = path, path[len(self.root) + 1:], size
                    yield (*row, time) if self.modified else row
                elif partition.deep:
                    pending.append(path)


class FileListing(DataSource):
    """``spark.read.format("gridmark_files").load(root)``: path, rel_path, length, and with option modified the time of change."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _modified(self) -> bool:
        return self.options.get("modified", "false") == "true"

    def schema(self) -> str:
        return LISTING + (", modified TIMESTAMP" if self._modified() else "")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._modified())


def list_files(spark: SparkSession, root: str, modified: bool = False) -> DataFrame:
    """Every file below a root, empty ones included."""
    root = qualified(spark, root)
    spark.dataSource.register(FileListing)
    return spark.read.format(FORMAT).option("modified", "true" if modified else "false").load(root)


def relative_path(uri: Column, root: str) -> Column:
    """Path below the (qualified) root of a file URI as the built-in sources report it."""
    decoded = F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    prefix = len(plain(root)) + 1
    path = F.regexp_replace(decoded, "^file:/+", "/") if is_local(root) else decoded
    return F.substr(path, F.lit(prefix + 1))
