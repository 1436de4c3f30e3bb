import json
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattframe.operators.timeseries import hourly_mean
from wattframe.plans import views
from wattframe.sources import normalize
from wattframe.streaming import market, state


def test_json_payloads_are_ingested_once_per_file(spark, tmp_path):
    landing, table, state = (str(tmp_path / n) for n in ("landing", "table", "state"))
    (tmp_path / "landing").mkdir()

    def land(name, hours):
        items = [{"LocalTime": f"2025-07-31 {h:02d}:00:00", "Pnode": "A", "LMP": str(h)} for h in hours]
        (tmp_path / "landing" / name).write_text(json.dumps({"items": items}, indent=1))

    def run():
        records = market.read_payload_stream(spark, landing, "LocalTime string, Pnode string, LMP string")
        conform = lambda batch: normalize.conform(batch, normalize.MISO)
        market.ingest(records, conform, table, state).awaitTermination()
        return spark.read.parquet(table)

    land("one.json", (1, 2))
    assert run().count() == 2
    land("two.json", (3, 4, 5))
    rows = run()
    assert rows.count() == 5 and rows.select("batch_id").distinct().count() == 2
    assert sorted(r.price for r in rows.collect()) == [1.0, 2.0, 3.0, 4.0, 5.0]
    assert run().count() == 5


@pytest.mark.parametrize("files", [1, 1000])
def test_batch_size_does_not_matter(spark, small, tmp_path, files):
    raw = views.pjm_raw(spark, small)
    raw.repartition(4).write.csv(str(tmp_path / "in"), header=True)
    records = market.read_csv_stream(
        spark, str(tmp_path / "in"), ", ".join(f"{c} string" for c in raw.columns), files
    )
    conform = lambda batch: normalize.conform(batch, normalize.PJM)
    market.ingest(records, conform, str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()
    streamed = normalize.cleaned(spark.read.parquet(str(tmp_path / "t")).drop("batch_id"))
    batch = normalize.normalize_pjm(raw)
    assert streamed.exceptAll(batch).isEmpty() and batch.exceptAll(streamed).isEmpty()


def test_stream_hours_equal_batch_hours(spark, small, tmp_path):
    table = str(tmp_path / "t")
    market.hourly(views.market_stream(spark, small), table, str(tmp_path / "s")).awaitTermination()
    batch = hourly_mean(views.market(spark, small)).withColumnRenamed("price", "mean")
    streamed = market.hourly_means(spark, table)
    both = streamed.join(batch, ["settlement_point", "timestamp"])
    assert both.count() == streamed.count() == batch.count() > 0
    assert both.where(F.abs(F.col("price") - F.col("mean")) > 1e-9).count() == 0


def _land(spark, path, rows):
    schema = "iso string, timestamp timestamp, settlement_point string, price double"
    start = datetime(2025, 7, 31)
    made = [("PJM", start + timedelta(minutes=m), "A", p) for m, p in rows]
    spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_late_rows_count_however_late(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "t", "s"))
    for rows in ([(10, 10.0), (130, 1.0)], [(20, 30.0), (900, 1.0)], [(30, None), (40, 50.0)]):
        market.hourly(_land(spark, source, rows), table, state).awaitTermination()
    means = {r.timestamp.hour: r.price for r in market.hourly_means(spark, table).collect()}
    assert means == {0: 30.0, 2: 1.0, 15: 1.0}


def test_replays_are_dropped_and_late_rows_and_corrections_kept(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "t", "s"))
    for rows in ([(1200, 20.0), (1260, 21.0), (1260, 21.0)], [(180, 3.0), (1260, 21.0)], [(1260, 22.0), (60, None), (60, None)]):
        market.drop_replays(_land(spark, source, rows), table, state).awaitTermination()
    kept = [(r.timestamp.hour, r.price) for r in spark.read.parquet(table).collect()]
    assert sorted(kept, key=str) == sorted([(20, 20.0), (21, 21.0), (3, 3.0), (21, 22.0), (1, None)], key=str)


def _days(spark, source, days, per_day=20):
    """One landed file a day."""
    for day in days:
        _land(spark, source, [(1440 * day + 60 * (i % 24), float(i % 7)) for i in range(per_day)])
    schema = "iso string, timestamp timestamp, settlement_point string, price double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)


def _held(spark, checkpoint):
    """Bytes of state that a stream holds at its latest version."""
    values = spark.read.format("statestore").load(checkpoint).select("value.groupState.*")
    return values


def test_rows_without_a_time_and_very_late_ones_are_stored_once(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "t", "s"))
    schema = "iso string, timestamp timestamp, settlement_point string, price double"
    at = datetime(2025, 7, 31)
    rows = [("PJM", None, "A", 1.0), ("PJM", None, None, None), (None, at - timedelta(days=900), "A", 2.0), ("PJM", at, "A", None)]
    for _ in range(3):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        market.drop_replays(spark.readStream.schema(schema).parquet(source), table, state).awaitTermination()
    kept = [(r.iso, r.timestamp, r.settlement_point, r.price) for r in spark.read.schema(schema).parquet(table).collect()]
    assert sorted(kept, key=str) == sorted(rows, key=str)


def test_a_batch_within_open_days_does_not_read_the_table(spark, tmp_path, monkeypatch):
    source, table, state = (str(tmp_path / n) for n in ("in", "t", "s"))
    market.drop_replays(_days(spark, source, range(4)), table, state).awaitTermination()
    monkeypatch.setattr(market, "stored_events", None)
    _land(spark, source, [(1440 * 3 + 60 * i, 9.0) for i in range(5)])
    _land(spark, source, [(1440 * 4, 1.0), (1440 * 3, 9.0)])
    market.drop_replays(_days(spark, source, []), table, state).awaitTermination()
    assert spark.read.parquet(table).where("price = 9.0").count() == 5


def test_state_holds_open_days_only_and_survives_restarts(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "t", "s"))
    sizes = []
    for first in range(0, 20, 5):
        market.drop_replays(_days(spark, source, range(first, first + 5)), table, state, horizon="2 days").awaitTermination()
        held = _held(spark, state).agg(F.sum(F.length("seen")).alias("n"), F.count("*").alias("groups")).first()
        assert held.groups <= 8
        sizes.append(held.n // 16)
    # of twenty days three or four are open
    assert max(sizes) <= 5 * 20 and spark.read.parquet(table).count() == 20 * 20
    before = spark.read.parquet(table).count()
    for day in (0, 19):
        _land(spark, source, [(1440 * day + 60 * (i % 24), float(i % 7)) for i in range(20)])
    market.drop_replays(_days(spark, source, []), table, state, horizon="2 days").awaitTermination()
    assert spark.read.parquet(table).count() == before


def test_the_state_is_searched_without_going_through_it():
    rng = np.random.default_rng(0)
    # first hashes that are equal while second ones differ, in any order
    held = [tuple(x) for x in rng.integers(-4, 4, (60, 2))] + [(2**63 - 1, 5), (-(2**63), 5)]
    runs = []
    for i, (a, b) in enumerate(dict.fromkeys(held)):
        runs = state._with_run(runs, np.array([a]), np.array([b]), np.array([i], np.int32))
    lengths = [len(r[0]) for r in runs]
    assert sum(lengths) == len(set(held)) and all(a >= 2 * b for a, b in zip(lengths, lengths[1:]))
    asked = [(a, b) for a in (*range(-5, 5), 2**63 - 1, -(2**63)) for b in range(-5, 6)]
    found = state._held(*(np.array(x) for x in zip(*asked)), runs)
    assert [x for x, yes in zip(asked, found) if yes] == [x for x in asked if x in set(held)]


def test_a_groups_state_is_handed_over_once_a_batch_however_many_rows_come(spark, tmp_path, monkeypatch):
    source, table, checkpoint, calls = (str(tmp_path / n) for n in ("in", "t", "s", "calls"))
    (tmp_path / "calls").mkdir()
    held = state._held

    def counted(*asked):
        # in a task: one file a call
        import tempfile

        tempfile.mkstemp(dir=calls)
        return held(*asked)

    monkeypatch.setattr(state, "_held", counted)
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(most, "20")
    try:
        for _ in range(2):
            stream = _land(spark, source, [(i, float(i % 5)) for i in range(1500)])
            market.drop_replays(stream, table, checkpoint).awaitTermination()
    finally:
        spark.conf.unset(most)
    assert spark.read.parquet(table).count() == 1500
    # two batches of eight groups; with 20 rows at a time there were over 150
    assert 0 < len(list((tmp_path / "calls").iterdir())) <= 2 * 8


def test_packs_hold_all_rows_once_with_their_newest_time():
    at = [None, *range(-(10**12), 10**15, 10**12), None, 5]
    n, zone = len(at), "America/New_York"
    columns = {
        "point": pa.array([None, *("x" * (i % 90) for i in range(n - 1))]),
        "time": pa.array(at, pa.timestamp("us", zone)),
        "h1": pa.array([(-1) ** i * i for i in range(n - 1)] + [0]),
        "h2": pa.array([0] * n),
        "days": pa.array(range(n), pa.int32()),
    }
    batch = pa.RecordBatch.from_pydict(columns)
    rows = batch.select(["point", "time"])
    packs = pa.Table.from_batches(state._packed(iter([batch.slice(0, 7), batch.slice(7)]), ["point", "time"], "time", 3))
    # the last row has the hashes of the first
    days = np.frombuffer(b"".join(packs["days"].to_pylist()), "<i4")
    hashes = np.frombuffer(b"".join(packs["hashes"].to_pylist()), "<i8")[::2]
    want = {h: i for i, h in enumerate(columns["h1"].to_pylist()[:-1])}
    assert len(days) == n - 1 and dict(zip(hashes.tolist(), days.tolist())) == want
    ends = np.cumsum([len(x) // 4 for x in packs["days"].to_pylist()])
    assert all(set(np.mod(hashes[a:b], 3)) == {share} for a, b, share in zip([0, *ends], ends, packs["share"].to_pylist()))
    opened = [pa.ipc.read_record_batch(x.as_buffer(), rows.schema) for x in packs["rows"]]
    assert packs["newest"].to_pylist() == [max((t for t in x["time"].to_pylist() if t is not None), default=None) for x in opened]
    # what comes back is what was kept
    kept = [np.arange(len(x)) % 2 == 0 for x in opened]
    said = {"rows": packs["rows"], "kept": [x.tobytes() for x in kept], "late": [(~x).tobytes() for x in kept]}
    back = pa.Table.from_batches(state._unpacked(pa.table(said).to_batches(), rows.schema))
    assert back.schema == rows.schema.append(pa.field("late", pa.bool_())) and not any(back["late"].to_pylist())
    assert back.drop(["late"]).to_pylist() == [r for x, keep in zip(opened, kept) for r, k in zip(x.to_pylist(), keep) if k]


def test_groups_follow_the_rows():
    assert [state.spread_for(n) for n in (0, 10**6, 10**8)] == [8, 8, 477]


def test_hours_are_stored_once_and_the_open_ones_as_one_snapshot(spark, tmp_path):
    source, table, state = (str(tmp_path / n) for n in ("in", "t", "s"))
    for first in range(0, 12, 4):
        market.hourly(_days(spark, source, range(first, first + 4), 48), table, state, horizon="2 days").awaitTermination()
    _land(spark, source, [(60, 100.0), (1440 * 11, 7.0)])
    market.hourly(_days(spark, source, []), table, state, horizon="2 days").awaitTermination()
    means = market.hourly_means(spark, table).collect()
    want = {}
    for day in range(12):
        for i in range(48):
            want.setdefault((day, i % 24), []).append(float(i % 7))
    want[0, 1].append(100.0)
    want[11, 0].append(7.0)
    start = datetime(2025, 7, 31)
    assert {((r.timestamp - start).days, r.timestamp.hour): r.price for r in means} == pytest.approx({k: sum(v) / len(v) for k, v in want.items()})
    # one row for each ended hour and one more for the late addition; open hours in two snapshots at most
    settled = spark.read.parquet(f"{table}/settled")
    assert settled.count() <= 12 * 24 + 1 and settled.count() >= 8 * 24
    assert len(list((tmp_path / "t" / "open").iterdir())) <= 2
    assert _held(spark, state).agg(F.sum(F.size("totals")).alias("n")).first().n <= 4 * 24
