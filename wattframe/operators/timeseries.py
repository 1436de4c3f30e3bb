"""Hourly series and sliding windows.

An hourly series has one row per key and hour, so a key's rows are bounded by
the calendar however many raw rows it has. The ordered steps below run on such
series only; raw rows are averaged first, with partial averages before the
shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINT = ("settlement_point",)
WINDOW_HOURS = 24


def _one_hour():
    return F.make_dt_interval(F.lit(0), F.lit(1))


def top_hub(market: DataFrame, point: str = "settlement_point") -> DataFrame:
    """The point with most rows, and how many; ties go to the first name."""
    return (
        market.groupBy(point)
        .agg(F.count("*").alias("n_rows"))
        .orderBy(F.col("n_rows").desc(), F.col(point))
        .limit(1)
    )


def at_top_hub(market: DataFrame, point: str = "settlement_point") -> DataFrame:
    """Rows of the point with most rows."""
    return market.where(F.col(point) == top_hub(market, point).select(point).scalar())


def hourly_mean(market: DataFrame, keys: Sequence[str] = POINT) -> DataFrame:
    """Mean price per key and hour."""
    return market.groupBy(*keys, F.date_trunc("hour", F.col("timestamp")).alias("timestamp")).agg(
        F.avg("price").alias("price")
    )


def _hours_until_next(keys: Sequence[str]):
    """Hours from a row up to, not including, the key's next row."""
    ordered = Window.partitionBy(*keys).orderBy("timestamp")
    following = F.lead("timestamp").over(ordered)
    last_hour = F.coalesce(following - _one_hour(), F.col("timestamp"))
    return F.sequence(F.col("timestamp"), last_hour, _one_hour())


def hourly_spine(hourly: DataFrame, keys: Sequence[str] = POINT) -> DataFrame:
    """Every hour between a key's first and last; hours without rows have a null price."""
    return (
        hourly.withColumn("_hours", _hours_until_next(keys))
        .select(*keys, "price", F.posexplode("_hours").alias("_step", "timestamp"))
        .select(*keys, "timestamp", F.when(F.col("_step") == 0, F.col("price")).alias("price"))
    )


def fill_both_ways(series: DataFrame, keys: Sequence[str] = POINT) -> DataFrame:
    """Fill null prices from the past, and leading ones from the first known price."""
    ordered = Window.partitionBy(*keys).orderBy("timestamp")
    past = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return series.withColumn(
        "price",
        F.coalesce(
            F.last("price", ignorenulls=True).over(past),
            F.first("price", ignorenulls=True).over(whole),
        ),
    )


def hourly_filled(hourly: DataFrame, keys: Sequence[str] = POINT) -> DataFrame:
    """Gapless hourly prices: what ``fill_both_ways(hourly_spine(...))`` gives.

    Values are filled before the missing hours are written out, which sorts the
    short series once instead of the long one.
    """
    return (
        fill_both_ways(hourly.withColumn("_hours", _hours_until_next(keys)), keys)
        .select(*keys, F.explode("_hours").alias("timestamp"), "price")
    )


def prepare_hourly(market: DataFrame, keys: Sequence[str] = POINT) -> DataFrame:
    """Raw rows to gapless hourly prices."""
    return hourly_filled(hourly_mean(market, keys), keys)


def sliding_windows(
    series: DataFrame, window_size: int = WINDOW_HOURS, keys: Sequence[str] = POINT
) -> DataFrame:
    """Each row with the ``window_size`` rows before it; ids count from 0 within a key.

    Rows with too little before them give no window.
    """
    ordered = Window.partitionBy(*keys).orderBy("timestamp")
    frame = ordered.rowsBetween(-window_size, -1)
    return (
        series.select(
            *keys,
            (F.row_number().over(ordered) - (window_size + 1)).alias("window_id"),
            F.first("timestamp").over(frame).alias("window_start_time"),
            F.last("timestamp").over(frame).alias("window_end_time"),
            F.col("timestamp").alias("target_time"),
            F.collect_list("price").over(frame).alias("price_sequence"),
            F.collect_list("timestamp").over(frame).alias("timestamp_sequence"),
            F.col("price").alias("target_price"),
        )
        .where(F.col("window_id") >= 0)
    )
