from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from wattframe.functions.times import feed_time_to_utc
from wattframe.functions.zones import intervals, local_to_utc, with_utc, zone_table
from wattframe.sources import normalize

ZONES = ("America/New_York", "America/Chicago", "Europe/Berlin", "Australia/Lord_Howe", "Asia/Tokyo")


def by_rules(local, zone, again):
    """UTC of a local time; a missing hour counts by the offset before it."""
    rules = ZoneInfo(zone)
    there = [local.replace(tzinfo=rules, fold=f).astimezone(timezone.utc).replace(tzinfo=None) for f in (0, 1)]
    missing = all(t.replace(tzinfo=timezone.utc).astimezone(rules).replace(tzinfo=None) != local for t in there)
    return there[1] if again and not missing else there[0]


def local_rows(spark):
    start = datetime(2021, 1, 1)
    times = [start + timedelta(minutes=30 * i) for i in range(2 * 24 * 365)]
    times += [datetime(1999, 12, 31, 23, 59), datetime(2020, 1, 1), datetime(1987, 4, 26, 3)]
    rows = [(i, t, again) for i, t in enumerate(times) for again in (False, True)]
    return spark.createDataFrame(rows, "id long, local timestamp, again boolean")


@pytest.mark.parametrize("zone", ZONES)
def test_both_passes_follow_the_rules_of_the_zone(spark, zone):
    rows = local_rows(spark).select("*", local_to_utc(F.col("local"), zone, F.col("again")).alias("utc")).collect()
    wrong = [r for r in rows if r.utc != by_rules(r.local, zone, r.again)]
    assert not wrong[:3]


def test_zones_of_a_column_by_a_join(spark):
    rows = local_rows(spark).withColumn("zone", F.get(F.array(*map(F.lit, ZONES)), F.col("id") % 5))
    for r in with_utc(rows, "local", "zone", ZONES, "again").collect():
        assert r.utc == by_rules(r.local, r.zone, r.again)
    odd = spark.createDataFrame([(None, "Asia/Tokyo"), (datetime(2021, 1, 1), "Mars"), (datetime(2021, 1, 1), None)], "t timestamp, zone string")
    assert [r.utc for r in with_utc(odd, "t", "zone", ZONES).collect()] == [None] * 3
    plan = with_utc(rows, "local", "zone", ZONES, "again")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_the_repeated_and_the_missing_hour(spark):
    rows = spark.createDataFrame(
        [("2024-11-03 01:30:00", "false"), ("2024-11-03 01:30:00", "true"), ("2024-11-03 01:30:00", None), ("2024-03-10 02:30:00", "true"),
         ("2024-11-03T01:30:00-05:00", "true"), ("2024-11-03 02:00:00", "x"), (None, "true")],
        "time string, flag string",
    )
    again = F.coalesce(F.col("flag").try_cast("boolean"), F.lit(False))
    got = [r[0] for r in rows.select(feed_time_to_utc(F.col("time"), "America/New_York", again)).collect()]
    at = lambda d, h, m=30: datetime(2024, *d, h, m)
    assert got == [at((11, 3), 5), at((11, 3), 6), at((11, 3), 5), at((3, 10), 7), at((11, 3), 6), at((11, 3), 7, 0), None]


def test_feeds_keep_their_flag(spark):
    rows = [("2024-11-03 01:30:00", "A", "5", f) for f in ("true", "no", None)]
    raw = spark.createDataFrame(rows, "LocalTime string, Pnode string, LMP string, Repeat_Hour_Flag string")
    got = normalize.conform(raw, normalize.MISO).collect()
    assert [(r.timestamp.hour, r.repeat_hour_flag) for r in got] == [(7, True), (6, False), (6, False)]


def test_intervals_of_a_year_have_no_gap(spark):
    for zone in ZONES:
        by_year = {}
        for year, again, begins, ends, _ in intervals(zone):
            by_year.setdefault((year, again), []).append((begins, ends))
        for found in by_year.values():
            assert all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert zone_table(spark, "Asia/Tokyo").where("year = 2000").count() == 2


def test_years_beyond_the_table_are_left_to_the_engine(spark):
    row = spark.range(1).select(local_to_utc(F.to_timestamp(F.lit("2150-01-01 00:00:00")), "America/New_York", F.lit(True)).alias("t")).first()
    assert row.t == datetime(2150, 1, 1, 5)


def test_a_time_that_is_parsed_is_parsed_once(spark):
    texts = spark.createDataFrame([("01-15 12:00:00", False), ("11-03 01:30:00", True), ("11-03 01:30:00", False), (None, True), ("x", False)], "t string, again boolean")
    local = F.try_to_timestamp(F.concat(F.lit("2024-"), F.col("t")))
    moved = texts.select(local_to_utc(local, "America/New_York", F.col("again")).cast("string").alias("utc"))
    assert [r.utc for r in moved.collect()] == ["2024-01-15 17:00:00", "2024-11-03 06:30:00", "2024-11-03 05:30:00", None, None]
    assert moved._jdf.queryExecution().optimizedPlan().toString().count("concat(2024-") == 1
