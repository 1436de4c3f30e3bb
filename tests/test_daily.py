from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.sources import daily
from wattframe.sources.tables import store_market

START = datetime(2025, 3, 1)


def rows(spark, days, points, per_day=30, price=lambda d, i: float(d * 7 + i % 13)):
    made = [(START + timedelta(days=d, minutes=40 * i), points[i % len(points)], price(d, i)) for d in days for i in range(per_day)]
    return spark.createDataFrame(made, "timestamp timestamp, settlement_point string, price double")


def same_as_table(spark, table, store):
    stored = spark.read.parquet(table)
    want = stored.agg(
        F.count("*"), F.min("timestamp"), F.max("timestamp"), F.min("price"), F.max("price"), F.count_distinct("settlement_point")
    ).first()
    got = daily.ingest_stats(spark, store).first()
    assert tuple(want) == (got.n_rows, got.min_timestamp, got.max_timestamp, got.min_price, got.max_price, got.unique_points)
    assert got.unique_timestamps == stored.select("timestamp").distinct().where("timestamp IS NOT NULL").count()
    counts = {r.settlement_point: r["count"] for r in stored.groupBy("settlement_point").count().collect()}
    assert {r.settlement_point: r.n_rows for r in daily.point_counts(spark, store).collect()} == counts
    prices = [r.price for r in stored.where("price IS NOT NULL").collect()]
    for q in (0.1, 0.5):
        assert daily.price_quantile(spark, table, store, q).first()[0] == pytest.approx(float(np.quantile(prices, q)))


def test_only_changed_days_are_read(spark, tmp_path, monkeypatch):
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    assert daily.refresh(spark, table, store) == []
    store_market(rows(spark, range(4), ["A", "B"]), table)
    assert daily.refresh(spark, table, store) == [f"2025-03-0{d}" for d in range(1, 5)]
    assert daily.refresh(spark, table, store) == []
    store_market(rows(spark, [1, 5], ["B", "C"]), table)
    read = []
    on = daily._on
    monkeypatch.setattr(daily, "_on", lambda days: read.append(on(days)) or read[-1])
    assert daily.refresh(spark, table, store) == ["2025-03-02", "2025-03-06"]
    plan = spark.read.parquet(table).where(read[0])
    assert "PartitionFilters: [" in plan._jdf.queryExecution().executedPlan().toString()
    assert {r[0].day for r in plan.select("date").distinct().collect()} == {2, 6}
    same_as_table(spark, table, store)


def test_rows_without_a_time_or_price(spark, tmp_path):
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    odd = spark.createDataFrame([(None, "A", 1.0), (None, None, 2.0), (START, "A", None)], "timestamp timestamp, settlement_point string, price double")
    store_market(rows(spark, [0], ["A"]).unionByName(odd), table)
    assert len(daily.refresh(spark, table, store)) == 2
    same_as_table(spark, table, store)
    store_market(odd, table)
    assert len(daily.refresh(spark, table, store)) == 2
    same_as_table(spark, table, store)


def test_points_in_both_spans(spark, tmp_path):
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    for days, points in ((range(2), ["A", "B", "C"]), (range(3, 5), ["B", "C", "D"]), ([6], ["E"])):
        store_market(rows(spark, days, points), table)
        daily.refresh(spark, table, store)
    pick = lambda a, b: daily.points_in_both(spark, store, a, b).first()[0]
    assert pick(("2025-03-01", "2025-03-02"), ("2025-03-04", "2025-03-05")) == 2
    assert pick(("2025-03-01", "2025-03-05"), ("2025-03-07", "2025-03-07")) == 0


def test_estimates_are_within_the_error(spark, tmp_path):
    table, store = str(tmp_path / "t"), str(tmp_path / "s")
    many = spark.range(60_000).select(
        (F.lit(START) + F.make_dt_interval(secs=F.col("id"))).alias("timestamp"),
        F.concat(F.lit("P"), F.col("id") % 20_000).alias("settlement_point"),
        (F.xxhash64("id") % 1000).cast("double").alias("price"),
    )
    store_market(many, table)
    daily.refresh(spark, table, store)
    assert daily.ingest_stats(spark, store).first().unique_timestamps == pytest.approx(60_000, rel=daily.ESTIMATE_ERROR)
    span = ("2025-03-01", "2025-03-02")
    assert daily.points_in_both(spark, store, span, span).first()[0] == pytest.approx(20_000, rel=daily.ESTIMATE_ERROR)
    near = daily.price_quantile(spark, table, store, 0.5, exact=False).first()[0]
    assert abs(many.where(F.col("price") <= near).count() / 60_000 - 0.5) < 0.005
