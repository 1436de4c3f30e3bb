"""Tables in versions: a replacement or an addition becomes visible at once or not at all.

Data files go to folders that nobody reads yet. A version is a manifest that lists the
folders it consists of, with their rows; the commit is the renaming of the manifest to
the next free number, which of two writers only one achieves. Readers take the newest
manifest, so they see one version until the end, and a table can be replaced by what is
computed from itself. The rows are counted while they are written.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.workspace import listed, remove

_MANIFESTS = "_versions"


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was based on."""


@dataclass(frozen=True)
class Version:
    """What a manifest holds: data folders with their rows, and the table's schema."""

    number: int
    folders: tuple[tuple[str, int], ...]
    schema: str
    #: For each writer that numbers its additions, the last one that is in the table.
    writers: tuple[tuple[str, int], ...] = ()

    @property
    def rows(self) -> int:
        return sum(n for _, n in self.folders)


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _numbers(spark: SparkSession, table: str) -> list[int]:
    names = [f.rpartition("/")[2] for f in listed(spark, f"{table}/{_MANIFESTS}")]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def version(spark: SparkSession, table: str, number: int | None = None) -> Version | None:
    """The newest version of a table or one by its number, None when there is none yet."""
    numbers = _numbers(spark, table)
    if not numbers:
        return None
    number = numbers[-1] if number is None else number
    if number not in numbers:
        raise ValueError(f"{table} has no version {number}")
    # a manifest is one small text
    text = spark.read.text(f"{table}/{_MANIFESTS}/{number}.json", wholetext=True).first()[0]
    held = json.loads(text)
    return Version(
        held["number"], tuple(map(tuple, held["folders"])), held["schema"], tuple(map(tuple, held["writers"]))
    )


def read_version(spark: SparkSession, table: str, number: int | None = None) -> DataFrame:
    """A table as of its newest version, or of one by its number."""
    found = version(spark, table, number)
    if found is None:
        raise ValueError(f"{table} has no version yet")
    schema = T.StructType.fromJson(json.loads(found.schema))
    folders = [f"{table}/{f}" for f, n in found.folders if n]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _commit(spark: SparkSession, table: str, new: Version) -> None:
    """Make a manifest the table's next version, unless another has taken its number."""
    files, _ = _files(spark, table)
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(f"{table}/{_MANIFESTS}")
    files.mkdirs(folder)
    draft, final = path(folder, f"_draft-{uuid.uuid4().hex}"), path(folder, f"{new.number}.json")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(asdict(new)).encode()))
    out.close()
    # on object stores without an atomic rename a lock of the store's own has to be put around this
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise Conflict(f"version {new.number} of {table} was committed by another writer")


def _written(df: DataFrame, table: str) -> tuple[str, int]:
    """A new data folder, and its rows as counted by the job that wrote it."""
    seen = Observation()
    name = f"data-{uuid.uuid4().hex}"
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{table}/{name}")
    return name, seen.get["n"]


def _report(spark: SparkSession, number: int, before: int, total: int, written: int) -> DataFrame:
    made = [(number, before, total, max(total - before, 0), written)]
    return spark.createDataFrame(made, "version bigint, rows_before bigint, total_rows bigint, rows_added bigint, rows_written bigint")


def _put(df: DataFrame, table: str, keep: bool, turn: tuple[str, int] | None = None) -> DataFrame:
    spark = df.sparkSession
    before = version(spark, table)
    writers = {} if before is None else dict(before.writers)
    if turn is not None:
        if before is not None and writers.get(turn[0], -1) >= turn[1]:
            return _report(spark, before.number, before.rows, before.rows, 0)
        writers[turn[0]] = turn[1]
    if keep and before is not None:
        # checked before anything is written; an added table has to have the same columns
        held = T.StructType.fromJson(json.loads(before.schema))
        if [(f.name, f.dataType) for f in held] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError(f"columns to add differ from those of {table}")
    folder = _written(df, table)
    old = before.folders if keep and before is not None else ()
    schema = before.schema if keep and before is not None else json.dumps(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema]).jsonValue())
    number = 0 if before is None else before.number + 1
    try:
        _commit(spark, table, Version(number, (*old, folder), schema, tuple(writers.items())))
    except Conflict:
        remove(spark, f"{table}/{folder[0]}")
        raise
    total = sum(n for _, n in (*old, folder))
    return _report(spark, number, 0 if before is None else before.rows, total, folder[1])


def replace(df: DataFrame, table: str) -> DataFrame:
    """Put rows in the place of a table's; one row with the version and the rows before and after.

    ``df`` may be computed from the table itself. The version before stays readable.
    """
    return _put(df, table, keep=False)


def append(df: DataFrame, table: str, turn: tuple[str, int] | None = None) -> DataFrame:
    """Add rows to a table; one row as from ``replace``.

    ``turn`` names the writer and numbers its additions. One that is in the table
    already, such as a stream's batch that is run again, adds nothing.
    """
    return _put(df, table, keep=True, turn=turn)


def compact(spark: SparkSession, table: str, least: int = 2) -> bool:
    """Write the rows of all folders to one, as a new version, if there are ``least`` folders.

    Readers and their versions are not disturbed. A version that another writer
    commits meanwhile goes first, and the result is given up: False.
    """
    found = version(spark, table)
    if found is None or len(found.folders) < least:
        return False
    folder = _written(read_version(spark, table, found.number).hint("rebalance"), table)
    try:
        _commit(spark, table, Version(found.number + 1, (folder,), found.schema, found.writers))
    except Conflict:
        remove(spark, f"{table}/{folder[0]}")
        return False
    return True


def audit(spark: SparkSession, table: str) -> DataFrame:
    """Whether the newest version holds the rows that were counted as it was written. Runs a job."""
    found = version(spark, table)
    if found is None:
        raise ValueError(f"{table} has no version yet")
    stored = read_version(spark, table).agg(F.count("*").alias("stored_rows"))
    rows = stored.withColumn("frame_rows", F.lit(found.rows).cast("bigint"))
    return rows.withColumn("rows_match", F.col("frame_rows") == F.col("stored_rows"))


def forget(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Remove all versions but the newest ``keep``, and the data that only they hold; how many went.

    Folders of writers that have not committed yet are not known here and stay.
    """
    numbers = _numbers(spark, table)
    old, kept = numbers[:-keep], numbers[-keep:]
    used = {f for n in kept for f, _ in version(spark, table, n).folders}
    for n in old:
        for folder, _ in version(spark, table, n).folders:
            if folder not in used:
                remove(spark, f"{table}/{folder}")
        remove(spark, f"{table}/{_MANIFESTS}/{n}.json")
    return len(old)
