"""One-row statistics and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a load should exceed; price and spread assumed for an empty market.
ENOUGH_ROWS = 1000
DEFAULT_PRICE = 35.0
DEFAULT_SPREAD = 10.0

CRITICAL_FEATURES = ("price_mean", "price_std", "trend_slope", "target_price")
OVERVIEW_FEATURES = ("price_mean", "price_std", "trend_slope", "price_volatility")


def ingest_stats(market: DataFrame) -> DataFrame:
    """Time range, price range and number of points of a stored table."""
    return market.agg(
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.countDistinct("settlement_point").alias("unique_points"),
    )


def load_summary(market: DataFrame, enough: int = ENOUGH_ROWS) -> DataFrame:
    """Ranges, distinct times and points, and whether there are enough rows."""
    return market.agg(
        F.count("*").alias("n_rows"),
        (F.count("*") > enough).alias("enough_rows"),
        F.min("timestamp").alias("min_timestamp"),
        F.max("timestamp").alias("max_timestamp"),
        F.countDistinct("timestamp").alias("unique_timestamps"),
        F.countDistinct("settlement_point").alias("unique_points"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
    )


def feature_stats(features: DataFrame) -> DataFrame:
    """Counts, target range and three averages of a feature table."""
    return features.agg(
        F.count("*").alias("total_records"),
        F.countDistinct("window_id").alias("unique_windows"),
        F.min("target_price").alias("min_target_price"),
        F.max("target_price").alias("max_target_price"),
        F.avg("price_mean").alias("avg_price_mean"),
        F.avg("price_std").alias("avg_price_std"),
        F.avg("trend_slope").alias("avg_trend_slope"),
    )


def null_audit(features: DataFrame, columns: Sequence[str] = CRITICAL_FEATURES) -> DataFrame:
    """Nulls per critical column and in all."""
    counted = features.agg(
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns)
    )
    total = sum((F.col(f"null_{c}") for c in columns), F.lit(0).cast("bigint"))
    return counted.withColumn("total_nulls", total)


def feature_overview(
    features: DataFrame, columns: Sequence[str] = OVERVIEW_FEATURES
) -> DataFrame:
    """Mean and sample deviation per feature, one row each."""
    stats = features.agg(
        *(F.avg(c).alias(f"{c}__mean") for c in columns),
        *(F.stddev_samp(c).alias(f"{c}__std") for c in columns),
    )
    pairs = F.array(
        *(
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"{c}__mean").alias("mean"),
                F.col(f"{c}__std").alias("std"),
            )
            for c in columns
        )
    )
    return stats.select(F.inline(pairs))


def target_stats(features: DataFrame, target: str = "target_price") -> DataFrame:
    """Mean, population deviation and range of the target."""
    return features.agg(
        F.avg(target).alias("mean_target"),
        F.stddev_pop(target).alias("std_target"),
        F.min(target).alias("min_target"),
        F.max(target).alias("max_target"),
    )


def type_counts(rows: DataFrame, column: str = "type") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def baseline_stats(recent: DataFrame, price: str = "price") -> DataFrame:
    """Mean and sample deviation of recent prices, with defaults for an empty table."""
    empty = F.count("*") == 0
    return recent.agg(
        F.when(empty, DEFAULT_PRICE).otherwise(F.avg(price)).alias("baseline_price"),
        F.when(empty, DEFAULT_SPREAD).otherwise(F.stddev_samp(price)).alias("price_std"),
    )


def preview(
    features: DataFrame, n: int = 5, order: Sequence[str] = ("window_id",)
) -> DataFrame:
    """First rows in the given order, with the columns worth a look."""
    shown = ["window_id", "target_time", "target_price", "price_mean", "price_std", "trend_slope"]
    extra = [c for c in order if c not in shown]
    return features.orderBy(*order).limit(n).select(*extra, *shown)
