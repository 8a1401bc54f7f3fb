"""A sink of many small files with one commit for all of them.

``df.write.format("gridmark_export").mode("overwrite").option("path", target).save()`` writes one file a row
of (rel_path, content, copy_from): the content, a copy of another file, or no bytes at all. Tasks write into
a staging folder within the target. Only when all have ended does the commit rename what they wrote into place:
each folder or file at the top of the target that the job wrote replaces what had its name, and
everything else stays. A failed job removes its staging folder and leaves the target as it was. A task
that runs twice writes the same files twice, each renamed into place when it is whole.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from gridmark.errors import GridmarkError
from gridmark.sources import listing

FORMAT = "gridmark_export"
SCHEMA = "rel_path STRING, content STRING, copy_from STRING"
BUFFER = 1 << 20
WITHOUT_FOLDERS = ("s3", "gcs", "abfs")  # stores whose folders cannot be renamed


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


def _place(path: str):
    """File system of a path, and the path within it."""
    if listing.is_local(path):
        from pyarrow import fs

        return fs.LocalFileSystem(), listing.plain(path)
    return listing.file_system(path)


def _checked(rel_path: str | None) -> str:
    parts = (rel_path or "").split("/")
    if not all(parts) or ".." in parts or parts[0].startswith("_staging-"):
        raise GridmarkError(f"cannot write a file named {rel_path!r}")
    return rel_path


class _Writer(DataSourceWriter):
    def __init__(self, target: str, overwrite: bool) -> None:
        self.target, self.overwrite, self.job = target.rstrip("/"), overwrite, uuid.uuid4().hex
        system, _ = _place(self.target)
        if system.type_name in WITHOUT_FOLDERS:
            raise GridmarkError(f"files are committed by renames, which {system.type_name} does not have; write a table instead")

    @property
    def staging(self) -> str:
        return f"{_place(self.target)[1]}/_staging-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        system, _ = _place(self.target)
        made, files, size = set(), 0, 0
        for row in iterator:
            path = f"{self.staging}/{_checked(row['rel_path'])}"
            folder = posixpath.dirname(path)
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            aside = f"{path}.{uuid.uuid4().hex}"
            with system.open_output_stream(aside) as out:
                if row["copy_from"] is not None:
                    source, inner = _place(row["copy_from"])
                    with source.open_input_stream(inner) as handle:
                        while block := handle.read(BUFFER):
                            out.write(block)
                            size += len(block)
                elif row["content"]:
                    data = row["content"].encode("utf-8")
                    out.write(data)
                    size += len(data)
            system.move(aside, path)
            files += 1
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, target = _place(self.target)
        done = [m for m in messages if m is not None]
        if not sum(m.files for m in done):
            system.create_dir(target, recursive=True)
            return
        written = [info for info in system.get_file_info(fs.FileSelector(self.staging))]
        old = f"{self.staging}-old"
        places = {info.base_name: system.get_file_info(f"{target}/{info.base_name}") for info in written}
        standing = sorted(name for name, there in places.items() if there.type != fs.FileType.NotFound)
        if standing and not self.overwrite:
            self.abort(messages)
            raise GridmarkError(f"{self.target} already holds {standing[0]}")
        if standing:
            system.create_dir(old)
        for info in written:
            if info.base_name in standing:
                system.move(f"{target}/{info.base_name}", f"{old}/{info.base_name}")
            system.move(info.path, f"{target}/{info.base_name}")
        system.delete_dir(self.staging)
        if standing:
            system.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, _ = _place(self.target)
        if system.get_file_info(self.staging).type != fs.FileType.NotFound:
            system.delete_dir(self.staging)


class FileExport(DataSource):
    """Writes rows of (rel_path, content, copy_from) as files."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def write_files(files: DataFrame, target: str) -> DataFrame:
    """Write (rel_path, content and/or copy_from) below a target; returns what is there then: rel_path, length.

    Different rows of one name would overwrite each other, so they are refused before anything is written.
    """
    spark = files.sparkSession
    target = listing.qualified(spark, target)
    none = F.lit(None).cast("string")
    # Put together once, for the look at their names and for the writer.
    rows = files.select("rel_path", *[F.col(c) if c in files.columns else none.alias(c) for c in ("content", "copy_from")]).distinct().persist(StorageLevel.DISK_ONLY)
    try:
        twice = rows.groupBy("rel_path").count().filter("count > 1").first()
        if twice is not None:
            raise GridmarkError(f"{twice['count']} files would be named {twice['rel_path']}")
        spark.dataSource.register(FileExport)
        rows.write.format(FORMAT).mode("overwrite").option("path", target).save()
    finally:
        rows.unpersist()
    return listing.list_files(spark, target).select("rel_path", "length")
