import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattframe.operators import cleaning, quantiles, reports


def at(hour, minute=0):
    return f"2025-07-31 {hour:02d}:{minute:02d}:00"


def values(df):
    return [r.price for r in df.orderBy("row_id").collect()]


def test_clean_case(prices):
    rows = prices([(at(h), p) for h, p in enumerate([10.0, None, -999.0, None, 50000.0, 20.0])])
    assert values(cleaning.clean_prices(rows)) == [10.0, 10.0, 0.0, 0.0, 1000.0, 20.0]
    assert values(cleaning.clean_prices(rows, cap=5000.0))[4] == 5000.0


def test_leading_gap_takes_the_median_of_the_filled_column(prices):
    rows = prices([(at(h), p) for h, p in enumerate([None, 10.0, None, 40.0, 30.0])])
    # Filled: null, 10, 10, 40, 30; the median of the four known is 20.
    assert values(cleaning.clean_prices(rows)) == [20.0, 10.0, 10.0, 40.0, 30.0]


def test_wild_value_is_filled_before_it_is_bounded(prices):
    rows = prices([(at(0), 50000.0), (at(1), None)])
    assert values(cleaning.clean_prices(rows)) == [1000.0, 1000.0]


def test_rows_without_time_or_any_price_go(prices):
    rows = prices([(None, 5.0), (at(1), None)])
    assert cleaning.clean_prices(rows).count() == 0
    nan = prices([(at(0), float("nan")), (at(1), 4.0)])
    assert values(cleaning.clean_prices(nan)) == [4.0, 4.0]


def test_points_do_not_fill_each_other(prices):
    rows = prices([(at(0), 1.0, "A"), (at(1), None, "B"), (at(2), None, "A"), (at(3), 9.0, "B")])
    assert values(cleaning.forward_fill(rows)) == [1.0, None, 1.0, 9.0]


def test_null_point_is_a_point(prices):
    rows = prices([(at(0), 1.0, None), (at(5), None, None)])
    assert values(cleaning.forward_fill(rows)) == [1.0, 1.0]


def test_fill_crosses_buckets_and_takes_the_tie_break(prices):
    rows = prices([(at(0, 5), 1.0), (at(0, 5), 2.0), (at(3), None), (at(0, 1), None), (at(0, 5), None)])
    assert values(cleaning.forward_fill(rows, tie_break="row_id")) == [1.0, 2.0, 2.0, None, 2.0]


@pytest.mark.parametrize("unit", ["seconds", "ms"])
def test_fill_against_brute_force(spark, unit):
    rng = random.Random(5)
    start = pd.Timestamp("2025-01-01")
    rows = [
        (i, start + pd.Timedelta(rng.randrange(0, 360000, 20), unit=unit), "hot" if rng.random() < 0.6 else rng.choice("ab"),
         rng.choice([None, None, rng.randrange(100) / 2]))
        for i in range(600)
    ]
    # Copies of one row, one of them without a price.
    rows += [(600 + i, start + pd.Timedelta(minutes=77), "hot", 5.0 if i else None) for i in range(50)]
    df = spark.createDataFrame(
        pd.DataFrame(rows, columns=["row_id", "timestamp", "settlement_point", "price"]).astype(
            {"price": "float64"}
        )
    ).withColumn("price", F.when(~F.isnan("price"), F.col("price")))
    got = values(cleaning.forward_fill(df, tie_break="row_id"))
    for i, ts, point, price in rows:
        if price is None:
            known = [r for r in rows if r[2] == point and r[1] <= ts and r[3] is not None]
            price = max(known, key=lambda r: (r[1], r[0]))[3] if known else None
        assert got[i] == price


@pytest.mark.parametrize(
    "kind, q",
    [("cents", 0.5), ("cents", 0.9), ("narrow", 0.5), ("wild", 0.5), ("wild", 0.0), ("wild", 1.0),
     ("same", 0.5), ("odd", 0.25)],
)
def test_exact_quantile_against_numpy(spark, kind, q):
    rng = np.random.default_rng(3)
    data = {
        "cents": np.round(rng.gamma(2, 20, 1000), 2),
        "narrow": 35 + rng.random(501) * 1e-7,
        "wild": np.concatenate([rng.normal(0, 1e9, 50), rng.normal(0, 1, 51), [1e300, -1e300]]),
        "same": np.full(77, 12.5),
        "odd": np.array([3.0, 1.0, 2.0]),
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in data] + [(None,)], "v double")
    got = quantiles.exact_quantile(df, "v", q).first()[0]
    assert got == pytest.approx(float(np.quantile(data, q)), rel=1e-12)


def test_exact_quantile_narrows_many_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_FEW", 10)
    monkeypatch.setattr(quantiles, "SKETCH_SIZE", 16)
    rng = np.random.default_rng(8)
    data = np.concatenate([rng.normal(0, 1, 400), 10.0 ** rng.integers(-200, 200, 100), np.full(300, 0.25)])
    df = spark.createDataFrame([(float(x),) for x in data], "v double")
    for q in (0.1, 0.5, 0.77):
        assert quantiles.exact_quantile(df, "v", q).first()[0] == pytest.approx(float(np.quantile(data, q)), rel=1e-12)


@pytest.mark.parametrize("kind", ["halves", "hot", "skew"])
def test_exact_quantile_where_values_are_shared(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "_FEW", 5)
    rng = np.random.default_rng(5)
    data = {
        "halves": np.concatenate([np.full(500, 1.0), 1 + rng.random(11), np.full(500, 3.0)]),
        "hot": np.concatenate([np.full(700, 7.0), rng.normal(7, 1, 300)]),
        "skew": np.round(rng.pareto(1.0, 3000), 1),
    }[kind]
    df = spark.createDataFrame([(float(x),) for x in data], "v double").repartition(5)
    for q in (0.0, 0.3, 0.4995, 0.5, 0.501, 1.0):
        assert quantiles.exact_quantile(df, "v", q).first()[0] == pytest.approx(float(np.quantile(data, q)), rel=1e-12)


def test_a_sketch_that_misses_is_widened(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_FEW", 50)
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    elsewhere = spark.range(500, 600).agg(quantiles.sketch(F.col("id"))).first()[0]
    assert quantiles.exact_quantile(df, "v", 0.1, sketched=(1000, elsewhere)).first()[0] == pytest.approx(99.9)


def test_ranks_of_sketches_are_within_the_error(spark):
    df = spark.range(0, 300_000, 1, 12).select((F.xxhash64("id") % 1_000_003).cast("double").alias("v"))
    held = df.groupBy(F.spark_partition_id()).agg(quantiles.sketch(F.col("v")).alias("s"))
    shares = [i / 20 for i in range(1, 20)]
    at = held.agg(F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("s"), F.array(*map(F.lit, shares)))).first()[0]
    below = df.agg(*(F.avg((F.col("v") <= x).cast("int")) for x in at)).first()
    assert max(abs(b - s) for b, s in zip(below, shares)) < quantiles.RANK_ERROR


def test_few_jobs(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_FEW", 2_000)
    df = spark.range(200_000).select(F.col("id").cast("double").alias("v"))
    # without adaptive execution an action is one job
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.sparkContext.setJobGroup("quantile", "counted")
    try:
        assert quantiles.exact_quantile(df, "v").first()[0] == 99_999.5
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("quantile")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # the sketch, the counts, the order, and reading the row that holds the result
    assert len(jobs) <= 5


def test_median_is_left_out_where_nothing_is_empty(spark, prices, monkeypatch):
    monkeypatch.setattr(cleaning, "exact_quantile", None)
    assert values(cleaning.impute_median(prices([(at(0), 1.0)]))) == [1.0]


def test_quantile_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_quantile(df, "v").first()[0] is None


def test_approximate_median_option(prices):
    rows = prices([(at(h), p) for h, p in enumerate([None, 1.0, 2.0, 3.0])])
    assert values(cleaning.impute_median(rows, accuracy=1000))[0] == 2.0


def test_quality_report(prices):
    rows = prices([(None, 1.0), (at(1), None), (at(2), -1.0), (at(3), 2000.0), (at(4), 5.0)])
    report = cleaning.quality_report(rows, cleaning.clean_prices(rows)).first()
    assert report.asDict() == {
        "rows_before": 5, "null_timestamps": 1, "null_prices": 1, "negative_prices": 1,
        "extreme_prices": 1, "rows_after": 4, "rows_lost": 1, "lost_pct": 20.0,
    }


def test_cleaned_prices_have_no_nulls(spark, small):
    from wattframe.plans import views

    clean = cleaning.clean_prices(views.market_dirty(spark, small), tie_break="row_id")
    audit = reports.null_audit(clean, ("timestamp", "price")).first()
    assert audit.total_nulls == 0
    assert clean.agg(F.min("price"), F.max("price")).first()[0] >= 0


def test_features_fill_goes_from_newer_to_older(spark):
    df = spark.createDataFrame(
        [("A", "2025-07-31 01:00:00", None), ("A", "2025-07-31 02:00:00", 2.0), ("A", "2025-07-31 03:00:00", None)],
        "settlement_point string, target_time string, x double",
    )
    got = {r.target_time[11:13]: r.x for r in cleaning.features_fill(df, ["x"]).collect()}
    assert got == {"01": 2.0, "02": 2.0, "03": 0.0}


def test_features_finite(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0), (float("nan"), 1.0), (float("inf"), 1.0), (None, 1.0), (1.0, None)],
        "x double, target_price double",
    )
    assert cleaning.features_finite(df, ["x"]).count() == 1


def test_required_and_feature_columns(spark):
    df = spark.createDataFrame([(1, 2.0)], "window_id int, price_mean double")
    assert cleaning.feature_columns(df) == ["price_mean"]
    with pytest.raises(ValueError, match="price_std"):
        cleaning.require_columns(df, "price_mean", "price_std")


def test_baseline_defaults_for_an_empty_market(prices):
    row = reports.baseline_stats(prices([(at(0), 1.0)]).where(F.lit(False))).first()
    assert (row.baseline_price, row.price_std) == (35.0, 10.0)
