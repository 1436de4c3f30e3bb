"""Folders for written tables, landed feeds and stream checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def _base(spark: SparkSession) -> str | None:
    return spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder the cluster names in ``spark.checkpoint.dir``.

    A folder given to ``SparkContext.setCheckpointDir`` serves as well. Without
    either the call fails: only a folder named by the caller is known to be one
    that all executors can reach.
    """
    base = _base(spark)
    if not base:
        raise ValueError(f"set {_CHECKPOINT_KEY} to a folder all executors can reach")
    return f"{base.rstrip('/')}/wattframe/{name}-{uuid.uuid4().hex}"


def use_local_folder(spark: SparkSession) -> None:
    """Give a local session that names no folder a temporary one; for trials on one machine."""
    if _base(spark) is None and spark.sparkContext.master.startswith("local["):
        path = tempfile.mkdtemp(prefix="wattframe-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint rows that later steps read several times. Runs a job.

    The checkpoint is reliable: it lies in the shared folder and outlives
    executors.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return df.checkpoint()


def listed(spark: SparkSession, path: str) -> list[str]:
    """Paths of what a folder holds, nothing if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [str(s.getPath()) for s in files.listStatus(target)] if files.exists(target) else []


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, bytes and time of change of all files below a folder, nothing if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    below, found = files.listFiles(target, True), []
    while below.hasNext():
        status = below.next()
        found.append((str(status.getPath()), status.getLen(), status.getModificationTime()))
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
