from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.operators import features as feature_ops
from wattframe.operators import timeseries

START = datetime(2025, 7, 28)


@pytest.fixture
def series(spark):
    def make(prices, point="HB", start=START):
        rows = [(point, start + timedelta(hours=i), float(p)) for i, p in enumerate(prices)]
        return spark.createDataFrame(rows, "settlement_point string, timestamp timestamp, price double")

    return make


def test_hourly_mean_spine_and_fill(prices):
    rows = prices(
        [("2025-07-31 00:05:00", 10.0), ("2025-07-31 00:55:00", 20.0), ("2025-07-31 01:00:00", 30.0),
         ("2025-07-31 04:10:00", 50.0)]
    )
    hourly = timeseries.hourly_mean(rows)
    spine = [(r.timestamp.hour, r.price) for r in timeseries.hourly_spine(hourly).orderBy("timestamp").collect()]
    assert spine == [(0, 15.0), (1, 30.0), (2, None), (3, None), (4, 50.0)]
    filled = [(r.timestamp.hour, r.price) for r in timeseries.hourly_filled(hourly).orderBy("timestamp").collect()]
    assert filled == [(0, 15.0), (1, 30.0), (2, 30.0), (3, 30.0), (4, 50.0)]


def test_filled_equals_fill_of_spine_with_leading_nulls(prices):
    rows = prices(
        [("2025-07-31 00:05:00", None), ("2025-07-31 03:00:00", 5.0), ("2025-07-31 06:00:00", None),
         ("2025-07-31 08:00:00", 9.0), ("2025-07-31 09:00:00", None)]
    )
    hourly = timeseries.hourly_mean(rows)
    direct = timeseries.hourly_filled(hourly).orderBy("timestamp").collect()
    steps = timeseries.fill_both_ways(timeseries.hourly_spine(hourly)).orderBy("timestamp").collect()
    assert [(r.timestamp, r.price) for r in direct] == [(r.timestamp, r.price) for r in steps]
    assert [r.price for r in direct] == [5.0] * 8 + [9.0, 9.0]


@pytest.mark.parametrize("hours, windows", [(0, 0), (24, 0), (25, 1), (60, 36)])
def test_window_count(series, spark, hours, windows):
    data = series(range(hours)) if hours else series([1.0]).where(F.lit(False))
    assert timeseries.sliding_windows(data).count() == windows


def test_window_content(series):
    rows = timeseries.sliding_windows(series(range(30))).orderBy("window_id").collect()
    first = rows[0]
    assert first.window_id == 0 and first.target_price == 24.0
    assert first.price_sequence == [float(i) for i in range(24)]
    assert len(first.timestamp_sequence) == 24
    assert first.window_start_time == START and first.window_end_time == START + timedelta(hours=23)
    assert first.target_time == START + timedelta(hours=24)
    assert [r.window_id for r in rows] == list(range(6))


def test_top_hub_ties_go_to_the_first_name(prices):
    rows = prices([("2025-07-31 00:00:00", 1.0, p) for p in "BBAAC"])
    hub = timeseries.top_hub(rows).first()
    assert (hub.settlement_point, hub.n_rows) == ("A", 2)
    assert timeseries.at_top_hub(rows).count() == 2


def expected(window, when):
    x = np.arange(len(window))
    first, last = window[0], window[-1]
    low, high = min(window[-6:]), max(window[-6:])
    mean, std = np.mean(window), np.std(window)
    return {
        "price_mean": mean, "price_std": std, "price_min": min(window), "price_max": max(window),
        "price_median": np.median(window), "trend_slope": np.polyfit(x, window, 1)[0],
        "price_change": last - first, "price_change_pct": (last - first) / first * 100 if first else 0,
        "price_range": max(window) - min(window), "price_volatility": std / mean if mean else 0,
        "price_ma_12": np.mean(window[-12:]), "price_ma_6": np.mean(window[-6:]),
        "hour_of_day": when.hour, "day_of_week": when.weekday(), "is_weekend": int(when.weekday() >= 5),
        "is_peak_hour": int(14 <= when.hour <= 18), "momentum_1h": last - window[-2],
        "momentum_3h": last - window[-4],
        "relative_position": (last - low) / (high - low) if high != low else 0.5,
    }


def test_features_against_numpy(series):
    rng = np.random.default_rng(1)
    prices = np.round(rng.gamma(2, 20, 60), 2)
    rows = feature_ops.feature_matrix(series(prices), digits=None, ratio_digits=None).collect()
    assert len(rows) == 36
    for row in rows:
        window = prices[row.window_id : row.window_id + 24]
        for name, value in expected(window, row.target_time).items():
            assert row[name] == pytest.approx(value, abs=1e-9), name
        assert row.price_min <= row.price_median <= row.price_max
        assert 0 <= row.relative_position <= 1


def test_product_digits(series):
    rng = np.random.default_rng(2)
    row = feature_ops.feature_matrix(series(rng.random(25) * 50)).first()
    assert round(row.price_mean, 4) == row.price_mean and round(row.trend_slope, 6) == row.trend_slope
    assert set(feature_ops.FEATURE_NAMES) <= set(row.asDict())


def test_flat_and_zero_series(series):
    flat = feature_ops.feature_matrix(series([7.0] * 30)).first()
    assert flat.relative_position == 0.5 and flat.trend_slope == 0 and flat.price_volatility == 0
    zero = feature_ops.feature_matrix(series([0.0] * 25)).first()
    assert zero.price_change_pct == 0 and zero.price_volatility == 0


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 12])
def test_short_windows(series, size):
    prices = [3.0, 8.0, 1.0, 9.0, 4.0, 4.5, 2.0, 6.0, 7.0, 5.0, 0.5, 3.5, 2.5]
    row = (
        feature_ops.feature_matrix(series(prices), window_size=size, digits=None, ratio_digits=None)
        .where("window_id = 0").first()
    )
    window = prices[:size]
    assert row.price_ma_12 == pytest.approx(np.mean(window))
    assert row.price_ma_6 == pytest.approx(np.mean(window[-6:]) if size >= 12 else np.mean(window))
    assert row.momentum_1h == (window[-1] - window[-2] if size >= 2 else 0.0)
    assert row.momentum_3h == (window[-1] - window[-4] if size >= 4 else 0.0)
    assert row.price_median == pytest.approx(np.median(window))


def test_sequence_round_trip_and_bad_text(series, spark):
    stored = feature_ops.export_sequences(feature_ops.feature_matrix(series(range(26))))
    back = feature_ops.import_sequences(stored).orderBy("window_id").collect()
    assert back[0].price_sequence == [float(i) for i in range(24)]
    bad = stored.withColumn("price_sequence_json", F.lit("oops"))
    assert feature_ops.import_sequences(bad).orderBy("window_id").first().price_sequence == [24.0] * 24


def test_each_point_has_its_own_windows(series):
    both = series(range(30), "A").union(series(range(100, 126), "B"))
    counts = {
        r.settlement_point: r["count"]
        for r in feature_ops.feature_matrix(both).groupBy("settlement_point").count().collect()
    }
    assert counts == {"A": 6, "B": 2}
