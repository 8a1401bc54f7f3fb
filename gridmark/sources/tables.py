"""Configuration manifests, training logs and evaluation tables."""

from __future__ import annotations

import os
from collections.abc import Sequence

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmark.schemas import EPOCH, EVALUATION, SOURCE_FILES, SOURCES


def read_manifests(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(sources, source_files) of declarative manifests; a later file wins on equal keys."""
    merged: dict[str, dict] = {}
    for path in paths:
        if not os.path.exists(path):
            continue
        with open(path, encoding="utf-8") as handle:
            content = yaml.safe_load(handle) or {}
        merged.update({k: s for k, s in content.items() if isinstance(s, dict)})
    sources = [
        (key, s.get("name"), s.get("publisher"), s.get("doi"), s.get("license"),
         s.get("target_subdir"), bool(s.get("auth_required", False)), s.get("description"))
        for key, s in merged.items()
    ]
    files = [
        (key, file_key, f.get("filename"), f.get("url"), bool(f.get("is_archive", False)),
         f.get("expected_md5"), f.get("extract_subdir"), f.get("description"))
        for key, s in merged.items()
        for file_key, f in (s.get("files") or {}).items()
    ]
    return spark.createDataFrame(sources, SOURCES), spark.createDataFrame(files, SOURCE_FILES)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Training metrics, one JSON object per line."""
    return spark.read.schema(EPOCH).json(path)


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Stored engine evaluations; filters and columns reach the Parquet scan."""
    return spark.read.schema(EVALUATION).parquet(path)


def file_checksums(spark: SparkSession, root: str) -> DataFrame:
    """(filename, actual_md5) of the non-empty files below a root."""
    raw = spark.read.format("binaryFile").load(root, recursiveFileLookup=True)
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    return raw.select(name.alias("filename"), F.md5("content").alias("actual_md5"))
