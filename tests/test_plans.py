"""Physical plans keep to what scales."""

import re

import pytest
from pyspark.sql import functions as F

from wattframe import workspace
from wattframe.operators import intervals
from wattframe.operators.timeseries import hourly_mean
from wattframe.plans import flows, views
from wattframe.plans.registry import QUERIES
from wattframe.sources import tables

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_matrix_shuffles_twice_and_reads_three_columns(spark, small):
    text = plan(QUERIES["feature_matrix"](spark, small))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>", text)


def test_time_filter_reaches_the_scan(spark, small, tmp_path):
    stored = tables.sink_replace(views.market(spark, small), str(tmp_path / "m"))
    as_of = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    text = plan(tables.scan_days_back(stored, as_of).select("price"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(timestamp,2024-01-13", text)
    assert "ReadSchema: struct<timestamp:timestamp,price:double>" in text


def test_stored_dates_are_pruned(spark, small, tmp_path):
    market = views.market(spark, small).withColumn("iso", F.lit("ERCOT"))
    stored = tables.store_market(market, str(tmp_path / "m"))
    assert stored.count() == market.count()
    as_of = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    recent = tables.scan_days_back(stored, as_of)
    assert re.search(r"PartitionFilters: \[.*date#\d+ >= 2024-01-13", plan(recent))
    assert recent.count() == tables.scan_days_back(market, as_of).count() > 0
    latest = tables.scan_days_back(stored, tables.latest_time(stored))
    assert latest.count() == tables.scan_days_back(market, tables.latest_time(market)).count() > 0


def test_hourly_mean_combines_before_the_shuffle(spark, small):
    text = plan(hourly_mean(views.market(spark, small)))
    assert text.count("partial_avg") >= 1


def test_latest_rows_use_a_bounded_sort(spark, small):
    assert "TakeOrderedAndProject" in plan(QUERIES["scan_latest_n"](spark, small))


def test_split_moves_no_feature_rows(spark, small):
    text = plan(QUERIES["split_train_test"](spark, small))
    main = text.split("Subquery")[0]
    assert len(re.findall(r"Exchange", main)) <= len(re.findall(r"Exchange", plan(views.features(spark, small))))


def test_raw_prices_to_stored_features(spark, small, tmp_path):
    matrix = flows.market_to_features(views.market_dirty(spark, small), tie_break="row_id")
    stored = flows.store_features(matrix, str(tmp_path / "f"))
    points = stored.select("settlement_point").distinct().count()
    hours = 0
    for r in stored.groupBy("settlement_point").agg(F.max("window_id").alias("w"), F.count("*").alias("n")).collect():
        assert r.n == r.w + 1
        hours += r.n
    assert points == 5 and stored.count() == hours
    hub = flows.market_to_features(views.market_dirty(spark, small), tie_break="row_id", top_hub_only=True)
    assert hub.select("settlement_point").distinct().count() == 1


def test_requests_flow(spark, small):
    asked = views.requests(spark, small)
    rows = flows.requests_to_forecasts(asked, views.market(spark, small))
    assert rows.count() == asked.count()


def test_shared_folder_follows_the_setting(spark, monkeypatch):
    path = workspace.shared_folder(spark, "x")
    assert path != workspace.shared_folder(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir"))
    monkeypatch.setattr(workspace, "_base", lambda spark: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_folder(spark, "x")


def test_a_hot_hour_is_split_in_the_interval_join(spark, small):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.shuffle.partitions": "16",
    }
    market = views.market(spark, small).repartition(8)
    hot = market.where(F.col("row_id") == market.agg(F.max("row_id")).scalar())
    copies = hot.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40000)))).repartition(8)
    copies = copies.withColumn("row_id", F.xxhash64("copy"))
    skewed = market.unionByName(copies.drop("copy"))
    features = views.features(spark, small).select("settlement_point", "window_id", "target_time")
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = intervals.nearest_feature(skewed, features, ("window_id",), by=("settlement_point",))
        joined = joined.select("row_id", "settlement_point", "timestamp", "feature_window_id")
        assert len(joined.collect()) == 41000
        assert "skew=true" in plan(joined)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
