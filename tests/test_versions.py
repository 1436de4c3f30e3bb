import threading

import pytest
from pyspark.sql import functions as F

from wattframe.sources import versions


def numbers(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_a_reader_keeps_its_version_while_the_table_is_replaced(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.replace(spark.range(10), table)
    reading = versions.read_version(spark, table)
    row = versions.replace(spark.range(100, 105), table).first()
    assert (row.version, row.rows_before, row.total_rows, row.rows_added) == (1, 10, 5, 0)
    assert numbers(reading) == list(range(10))
    assert numbers(versions.read_version(spark, table)) == list(range(100, 105))
    assert numbers(versions.read_version(spark, table, 0)) == list(range(10))


def test_readers_never_meet_a_half_table(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.replace(spark.range(50), table)
    seen, done = set(), threading.Event()

    def read():
        while not done.is_set():
            seen.add(versions.read_version(spark, table).count())

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(5):
        versions.replace(spark.range(100 + i).repartition(4), table)
    done.set()
    reader.join(60)
    assert seen <= {50, *range(100, 105)}


def test_a_table_can_be_replaced_by_what_is_computed_from_it(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.replace(spark.range(6), table)
    for _ in range(2):
        versions.replace(versions.read_version(spark, table).where("id % 2 = 0").select((F.col("id") / 2).cast("long").alias("id")), table)
    assert numbers(versions.read_version(spark, table)) == [0, 1]


def test_appends_count_as_they_write(spark, tmp_path):
    table = str(tmp_path / "t")
    first = versions.append(spark.range(7), table).first()
    assert (first.rows_before, first.total_rows, first.rows_added) == (0, 7, 7)
    second = versions.append(spark.range(3), table).first()
    assert (second.rows_before, second.total_rows, second.rows_added, second.rows_written) == (7, 10, 3, 3)
    assert versions.append(spark.range(0), table).first().total_rows == 10
    row = versions.audit(spark, table).first()
    assert (row.stored_rows, row.frame_rows, row.rows_match) == (10, 10, True)
    with pytest.raises(ValueError, match="differ"):
        versions.append(spark.range(3).withColumn("more", F.lit(1)), table)
    assert versions.version(spark, table).rows == 10


def test_of_two_writers_one_commits(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.replace(spark.range(3), table)
    held = versions.version(spark, table)
    versions.append(spark.range(3, 5), table)
    with pytest.raises(versions.Conflict):
        versions._commit(spark, table, versions.Version(held.number + 1, held.folders, held.schema))
    assert numbers(versions.read_version(spark, table)) == list(range(5))


def test_an_audit_finds_lost_files(spark, tmp_path):
    table = tmp_path / "t"
    versions.replace(spark.range(40).repartition(4), str(table))
    lost = next(table.glob("data-*/part-*.parquet"))
    lost.unlink()
    row = versions.audit(spark, str(table)).first()
    assert not row.rows_match and row.frame_rows == 40


def test_a_failed_write_leaves_the_version(spark, tmp_path):
    table = str(tmp_path / "t")
    versions.replace(spark.range(3), table)
    with pytest.raises(Exception):
        versions.replace(spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id")), table)
    assert numbers(versions.read_version(spark, table)) == [0, 1, 2]


def test_old_versions_go_and_shared_data_stays(spark, tmp_path):
    table = tmp_path / "t"
    for i in range(4):
        versions.append(spark.range(i, i + 1), str(table))
    versions.replace(spark.range(9), str(table))
    assert versions.forget(spark, str(table), keep=2) == 3
    assert numbers(versions.read_version(spark, str(table), 3)) == [0, 1, 2, 3]
    assert versions.forget(spark, str(table), keep=1) == 1
    assert numbers(versions.read_version(spark, str(table))) == list(range(9))
    assert len(list(table.glob("data-*"))) == 1
    with pytest.raises(ValueError, match="no version 0"):
        versions.read_version(spark, str(table), 0)
    with pytest.raises(ValueError, match="no version yet"):
        versions.read_version(spark, str(tmp_path / "none"))
    versions.replace(spark.range(0), str(tmp_path / "empty"))
    assert versions.read_version(spark, str(tmp_path / "empty")).count() == 0


def test_a_numbered_addition_is_made_once(spark, tmp_path):
    table = str(tmp_path / "t")
    for turn in (0, 1, 1, 0, 2):
        versions.append(spark.range(turn * 10, turn * 10 + 3), table, turn=("stream", turn))
    versions.append(spark.range(100, 101), table, turn=("other", 0))
    assert numbers(versions.read_version(spark, table)) == [0, 1, 2, 10, 11, 12, 20, 21, 22, 100]
    assert versions.compact(spark, table) and not versions.compact(spark, table)
    versions.append(spark.range(3), table, turn=("stream", 2))
    assert versions.read_version(spark, table).count() == 10


def test_compaction_keeps_rows_and_readers(spark, tmp_path):
    table = tmp_path / "t"
    for i in range(5):
        versions.append(spark.range(i, i + 1), str(table))
    reading = versions.read_version(spark, str(table))
    assert not versions.compact(spark, str(table), least=6)
    assert versions.compact(spark, str(table), least=5)
    assert numbers(reading) == numbers(versions.read_version(spark, str(table))) == list(range(5))
    assert len(versions.version(spark, str(table)).folders) == 1
    assert versions.forget(spark, str(table), keep=1) == 5
    assert len(list(table.glob("data-*"))) == 1


def test_a_stream_to_versions_keeps_few_folders(spark, tmp_path):
    from wattframe.sources import normalize
    from wattframe.streaming import market

    landing, table, state = (str(tmp_path / n) for n in ("in", "t", "s"))
    schema = "LocalTime string, Pnode string, LMP string"
    for day in range(1, 8):
        rows = [(f"2025-07-0{day} {h:02d}:00:00", "A", str(h)) for h in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").csv(landing, header=True)
    records = market.read_csv_stream(spark, landing, schema, 1)
    conform = lambda batch: normalize.conform(batch, normalize.MISO)
    market.ingest_versions(records, conform, table, state, compact_at=3).awaitTermination()
    assert versions.read_version(spark, table).count() == 21
    assert len(list((tmp_path / "t").glob("data-*"))) <= 5
    assert len(versions.version(spark, table).folders) <= 3
    market.ingest_versions(records, conform, table, state, compact_at=3).awaitTermination()
    assert versions.read_version(spark, table).count() == 21
