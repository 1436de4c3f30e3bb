"""Intermediate tables in the folder all executors share, and a few column helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.workspace import shared_folder


class Scratch:
    """Tables written as Parquet below ``spark.checkpoint.dir`` and read again.

    A written table cuts the lineage, outlives executors and fixes whatever a
    plan would otherwise decide anew, such as generated row numbers.
    """

    def __init__(self, spark: SparkSession, name: str):
        self._spark = spark
        self._name = name
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self._spark, self._name)
        df.write.option("compression", "zstd").parquet(path)
        kept = self._spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables that no result still reads."""
        jvm = self._spark._jvm
        conf = self._spark._jsc.hadoopConfiguration()
        for df in kept:
            path = jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(df)))
            path.getFileSystem(conf).delete(path, True)


def columns_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the wanted columns, so that further ones cannot clash with generated names."""
    return docs.select(*[F.col(f"`{n}`") for n in names])


def whole_text(name: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task's function that gives freed memory back to the system when it ends.

    Python workers outlive their tasks, and what they keep would count against the
    tasks that run next to them.
    """

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
