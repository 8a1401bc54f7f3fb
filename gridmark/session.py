"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from gridmark.errors import GridmarkError

# Settings every plan relies on; a cluster may set its own values first.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM only compiles methods below this size; a larger fused stage would be
    # interpreted, so Spark should use its split, per-operator code instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
STAGE = "stage-"
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", name: str = "gridmark", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {**DEFAULTS, "spark.ui.enabled": "false", **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: the cluster's checkpoint folder, a local one only on local masters."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise GridmarkError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete what is stored at a path when the driver ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def materialize(df: DataFrame, free: bool = False) -> DataFrame:
    """Write an intermediate result once to the shared folder and read it back.

    The Parquet copy survives lost executors, cuts the lineage, and lets later
    passes read only the columns they need. It is deleted when the driver ends, or by ``discard``.
    ``free`` deletes what the write has shuffled at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{STAGE}{uuid.uuid4().hex}"
    usual = spark.conf.get(FREE, None)
    if free:
        spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        if free and usual is None:
            spark.conf.unset(FREE)
        elif free:
            spark.conf.set(FREE, usual)
    delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the stored copies a materialized DataFrame reads; it cannot be read any more."""
    context = df.sparkSession.sparkContext
    folders = {file.rpartition("/")[0] for file in df.inputFiles()}
    for folder in folders:
        if folder.rpartition("/")[2].startswith(STAGE):
            place = context._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
