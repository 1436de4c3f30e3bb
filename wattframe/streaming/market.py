"""Market streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from wattframe.sources import versions
from wattframe.sources.feeds import ENVELOPE_KEYS, unwrap_envelope
from wattframe.sources.normalize import COMMON_COLUMNS
from wattframe.streaming import state
from wattframe.workspace import listed, remove

#: Columns in which a replayed row equals its first copy; another price is a correction.
EVENT_COLUMNS = ("iso", "settlement_point", "timestamp", "price")

_HOURS = ("settlement_point", "timestamp", "total", "n")


def read_payload_stream(
    spark: SparkSession,
    path: str,
    record_schema: str,
    keys: Sequence[str] = ENVELOPE_KEYS,
    files_per_batch: int = 1000,
    per_file: bool = True,
) -> DataFrame:
    """Records of JSON responses landing in a folder, one per file or one per line."""
    payloads = (
        spark.readStream.schema("value string")
        .format("text")
        .option("wholetext", per_file)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(path)
    )
    return unwrap_envelope(payloads, record_schema, keys=keys)


def read_csv_stream(
    spark: SparkSession, path: str, record_schema: str, files_per_batch: int = 1000
) -> DataFrame:
    """Records landing as CSV files with a header row."""
    return (
        spark.readStream.schema(record_schema)
        .option("header", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(path)
    )


def _batch_folders(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """Folders of the batches stored at a path, in order; those before a batch only."""
    folders = [f for f in listed(spark, path) if "/batch_id=" in f]
    numbered = sorted((int(f.rpartition("=")[2]), f) for f in folders)
    return [f for n, f in numbered if before is None or n < before]


def _latest_batch(spark: SparkSession, path: str, before: int | None = None) -> str | None:
    folders = _batch_folders(spark, path, before)
    return folders[-1] if folders else None


def any_batch(spark: SparkSession, path: str) -> bool:
    return bool(_batch_folders(spark, path))


def _started(
    writer: DataStreamWriter, store: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    return writer.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batches_to(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    prepare: Callable[[DataFrame, int], DataFrame],
) -> StreamingQuery:
    """Store each batch in a folder of its own, which a rerun of the batch replaces."""

    def store(batch: DataFrame, batch_id: int) -> None:
        path = f"{table}/batch_id={batch_id}"
        prepare(batch, batch_id).write.mode("overwrite").parquet(path)

    return _started(stream.writeStream, store, checkpoint)


def ingest(
    records: DataFrame,
    conform: Callable[[DataFrame], DataFrame],
    table: str,
    checkpoint: str,
) -> StreamingQuery:
    """Bring each batch of records to the common schema and add it to a table.

    Prices are stored as they came. Filling and the median look at other rows, so
    they belong to the reading of the table (``normalize.cleaned``): its result
    is then the same however the records were cut into batches.
    """
    return _batches_to(
        records, table, checkpoint, lambda batch, _: conform(batch).select(*COMMON_COLUMNS)
    )


def ingest_versions(
    records: DataFrame,
    conform: Callable[[DataFrame], DataFrame],
    table: str,
    checkpoint: str,
    writer: str = "ingest",
    compact_at: int = 16,
    keep: int = 2,
) -> StreamingQuery:
    """As ``ingest``, to a table in versions (``sources.versions``), which keeps few folders.

    A batch is one version and is added once, however often it is run. At
    ``compact_at`` folders they are written to one, and of the versions the newest
    ``keep`` stay.
    """
    spark = records.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        versions.append(conform(batch).select(*COMMON_COLUMNS), table, turn=(writer, batch_id))
        if versions.compact(spark, table, least=compact_at):
            versions.forget(spark, table, keep)

    return _started(records.writeStream, store, checkpoint)


def hourly(
    market: DataFrame,
    table: str,
    checkpoint: str,
    horizon: str = state.HORIZON,
    spread: int = state.SPREAD,
) -> StreamingQuery:
    """Keep sums and counts per point and hour up to date.

    Hours of open days are held as state; the table has one snapshot of them, which each
    batch replaces. An ended day's hours are stored once. Rows may come late by any
    time: an hour that was stored already gets a further sum. ``hourly_means`` reads
    the result, whose size follows the hours, not the batches.
    """
    spark = market.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        settled = batch.where(F.col("kind") != "open").select(*_HOURS)
        settled.write.mode("overwrite").parquet(f"{table}/settled/batch_id={batch_id}")
        before = _latest_batch(spark, f"{table}/open", batch_id)
        now = batch.where(F.col("kind") == "open").select("share", *_HOURS)
        if before is not None:
            touched = batch.where(F.col("kind") != "late").select("share").distinct()
            kept = spark.read.schema(now.schema).parquet(before).join(touched, "share", "left_anti")
            now = now.unionByName(kept)
        now.write.mode("overwrite").parquet(f"{table}/open/batch_id={batch_id}")
        # the snapshot before this one serves a rerun of this batch
        for old in _batch_folders(spark, f"{table}/open", batch_id - 1):
            remove(spark, old)
        batch.unpersist()

    return _started(state.hour_totals(market, horizon, spread).writeStream.outputMode("update"), store, checkpoint)


def hourly_means(spark: SparkSession, table: str) -> DataFrame:
    """Mean price per point and hour over all rows so far, open hours included."""
    schema = "settlement_point string, timestamp timestamp, total double, n bigint"
    settled = spark.read.schema(schema).parquet(f"{table}/settled").select(*_HOURS)
    latest = _latest_batch(spark, f"{table}/open")
    rows = settled if latest is None else settled.unionByName(spark.read.schema(schema).parquet(latest))
    price = F.try_divide(F.sum("total"), F.sum("n")).alias("price")
    return rows.groupBy("settlement_point", "timestamp").agg(price)


def stored_events(spark: SparkSession, table: str, rows: DataFrame, columns: Sequence[str] = EVENT_COLUMNS) -> DataFrame:
    """What ``drop_replays`` has stored, with the types of ``rows`` and no look into the files."""
    kept = [rows.schema[c] for c in columns]
    folders = [T.StructField("batch_id", T.LongType()), T.StructField("date", T.DateType())]
    return spark.read.schema(T.StructType(kept + folders)).parquet(table)


def drop_replays(
    market: DataFrame,
    table: str,
    checkpoint: str,
    columns: Sequence[str] = EVENT_COLUMNS,
    horizon: str = state.HORIZON,
    spread: int = state.SPREAD,
) -> StreamingQuery:
    """Add the rows of each batch that are not stored yet to a table.

    A first copy is stored however late it comes, and a row with another price is no
    copy. Rows of open days are compared with the state only. Late rows, and rows
    without a time, are compared with what is stored for their own dates; a batch
    without such rows does not read the table.
    """
    spark, names = market.sparkSession, list(columns)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        rows = batch.withColumn("date", F.to_date("timestamp"))
        late = rows.where("late").drop("late")
        # one for each day at most
        dates = [r["date"] for r in late.select("date").distinct().collect()]
        fresh = rows.where("NOT late").drop("late")
        if dates:
            late = late.dropDuplicates(names)
            if any_batch(spark, table):
                theirs = F.col("date").isin([d for d in dates if d is not None])
                theirs = theirs | F.col("date").isNull() if None in dates else theirs
                earlier = stored_events(spark, table, batch, names).where((F.col("batch_id") != batch_id) & theirs)
                same = [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in (*names, "date")]
                late = late.alias("new").join(earlier.alias("old"), same, "left_anti")
            fresh = fresh.unionByName(late)
        # up to four tasks write a date, and no task writes all dates
        dealt = fresh.repartition(spark.sparkContext.defaultParallelism, "date", F.pmod(F.xxhash64(*names), F.lit(4)))
        dealt.write.mode("overwrite").partitionBy("date").parquet(f"{table}/batch_id={batch_id}")
        batch.unpersist()

    unseen = state.fresh_rows(market, names, "timestamp", horizon, spread)
    return _started(unseen.writeStream.outputMode("update"), store, checkpoint)
