"""Readers for the Parquet tables and the shared folder that cut lineage is written to."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: What materialize wrote, by application.
_WRITTEN: dict[str, list[str]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; where it is unset and all runs in this process, one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tandemlab-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path := f"{shared_dir(spark)}/tandemlab-{uuid.uuid4().hex}")
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def together(*frames: DataFrame) -> DataFrame:
    """The rows of tables made by ``materialize`` with one schema, read as one table."""
    paths = sorted({f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()})
    return frames[0].sparkSession.read.schema(frames[0].schema).parquet(*paths) if len(frames) > 1 and paths else frames[0]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, what a write shuffled is deleted as soon as its rows are written down, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)


def spread(scan: DataFrame) -> DataFrame:
    """A scan on at least as many partitions as there are cores, for Python stages that cost far more than their bytes.

    Only a scan of fewer files and splits than cores is shuffled; larger ones are left as they lie.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_materialized(*frames: DataFrame) -> None:
    """Deletes tables made by ``materialize`` that no later plan reads."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/tandemlab-" in f}:
            _delete(df.sparkSession, path)


def drop_part(df: DataFrame, column: str, value: int) -> None:
    """Deletes what a table made by ``materialize`` with ``column`` to partition by holds under ``value``."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if f"/{column}={value}/" in f and "/tandemlab-" in f}:
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Deletes all tables that ``materialize`` wrote for this application, whose results must have been stored; returns how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
