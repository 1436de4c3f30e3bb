"""The nineteen features of a price window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions.arrays import parse_sequence, sequence_json
from wattframe.functions.numbers import ratio_or, round_even
from wattframe.functions.times import time_features
from wattframe.operators.timeseries import POINT, WINDOW_HOURS

# Digits kept of prices, and of slope and volatility.
PRICE_DIGITS = 4
RATIO_DIGITS = 6

FEATURE_NAMES = (
    "price_mean",
    "price_std",
    "price_min",
    "price_max",
    "price_median",
    "trend_slope",
    "price_change",
    "price_change_pct",
    "price_range",
    "price_volatility",
    "price_ma_12",
    "price_ma_6",
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "is_peak_hour",
    "momentum_1h",
    "momentum_3h",
    "relative_position",
)

_RATIOS = {"trend_slope", "price_volatility"}
_CALENDAR = {"hour_of_day", "day_of_week", "is_weekend", "is_peak_hour"}


def _framed(series: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """Each row with the prices, mean and deviation of its window; one sort, one frame."""
    ordered = Window.partitionBy(*keys).orderBy("timestamp")
    window = ordered.rowsBetween(-n, -1)
    return series.select(
        *keys,
        (F.row_number().over(ordered) - (n + 1)).alias("window_id"),
        F.col("timestamp").alias("target_time"),
        F.col("price").alias("target_price"),
        F.avg("price").over(window).alias("_mean"),
        F.stddev_pop("price").over(window).alias("_std"),
        F.collect_list("price").over(window).alias("price_sequence"),
    ).where(F.col("window_id") >= 0)


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _slope(sequence: Column, n: int) -> Column:
    """Least-squares slope against 0..n-1."""
    if n < 2:
        return F.lit(0.0)
    centre = (n - 1) / 2
    spread = sum((i - centre) ** 2 for i in range(n))
    terms = [F.get(sequence, F.lit(i)) * (i - centre) for i in range(n)]
    return _sum(terms) / spread


def feature_matrix(
    series: DataFrame,
    window_size: int = WINDOW_HOURS,
    keys: Sequence[str] = POINT,
    digits: int | None = PRICE_DIGITS,
    ratio_digits: int | None = RATIO_DIGITS,
) -> DataFrame:
    """Gapless hourly prices to one feature row per window of ``window_size`` hours.

    In windows shorter than 12 hours the moving averages are the window's mean;
    a change over more hours than the window holds is 0.
    """
    n = window_size
    prices = [F.get("price_sequence", F.lit(i)) for i in range(n)]
    ranked = F.sort_array("price_sequence")
    low, high, middle, middle_up = (
        F.get(ranked, F.lit(i)) for i in (0, n - 1, (n - 1) // 2, n // 2)
    )
    first, last, mean = prices[0], prices[-1], F.col("_mean")
    recent = F.slice("price_sequence", max(n - 5, 1), min(n, 6))
    staged = _framed(series, n, keys).withColumns(
        {"_low": F.array_min(recent), "_high": F.array_max(recent)}
    )

    def average(count: int) -> Column:
        return _sum(prices[-count:]) / count if n >= 12 else mean

    def change_over(hours: int) -> Column:
        return last - prices[-1 - hours] if n > hours else F.lit(0.0)

    values: dict[str, Column] = {
        "price_mean": mean,
        "price_std": F.col("_std"),
        "price_min": low,
        "price_max": high,
        "price_median": (middle + middle_up) / 2,
        "trend_slope": _slope(F.col("price_sequence"), n),
        "price_change": last - first,
        "price_change_pct": ratio_or((last - first) * 100, first, 0.0),
        "price_range": high - low,
        "price_volatility": ratio_or(F.col("_std"), mean, 0.0),
        "price_ma_12": average(12),
        "price_ma_6": average(6),
        **time_features(F.col("target_time")),
        "momentum_1h": change_over(1),
        "momentum_3h": change_over(3),
        "relative_position": ratio_or(last - F.col("_low"), F.col("_high") - F.col("_low"), 0.5),
    }

    def rounded(name: str) -> Column:
        if name in _CALENDAR:
            return values[name].alias(name)
        return round_even(values[name], ratio_digits if name in _RATIOS else digits).alias(name)

    return staged.select(
        *keys,
        "window_id",
        "target_time",
        "target_price",
        *(rounded(name) for name in FEATURE_NAMES),
        "price_sequence",
    )


def export_sequences(features: DataFrame) -> DataFrame:
    """Price sequence as JSON text, as stored in tables without arrays."""
    return features.withColumn("price_sequence_json", sequence_json(F.col("price_sequence"))).drop(
        "price_sequence"
    )


def import_sequences(features: DataFrame, length: int = WINDOW_HOURS) -> DataFrame:
    """JSON text back to an array; unreadable text gives the target price repeated."""
    return features.withColumn(
        "price_sequence",
        parse_sequence(F.col("price_sequence_json"), F.col("target_price"), length),
    )
