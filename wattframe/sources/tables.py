"""Scans and sinks of the market and feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

MARKET_COLUMNS = ("timestamp", "settlement_point", "price")

# Columns the services read from the feature table.
FORECAST_INPUTS = (
    "price_mean",
    "price_std",
    "trend_slope",
    "price_volatility",
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "is_peak_hour",
    "momentum_1h",
)
FEATURE_SCAN_COLUMNS = ("window_id", "target_time", "target_price", *FORECAST_INPUTS)

# Folder column of market tables stored by market and date.
DATE_FOLDER = "date"

# Fixed value: rows read for documents.
LATEST_FOR_DOCUMENTS = 500


def scan_sorted(
    market: DataFrame, columns: Sequence[str] = MARKET_COLUMNS, order: Sequence[str] = ()
) -> DataFrame:
    """Chosen columns ordered by time and point."""
    return market.select(*columns).orderBy(*(order or ("timestamp", "settlement_point")))


def scan_days_back(market: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Rows of the last ``days`` days up to ``as_of``, both ends included.

    On a table stored by date only the folders of those days are read.
    """
    start = as_of - F.make_dt_interval(F.lit(days))
    rows = market.where(F.col("timestamp").between(start, as_of))
    if DATE_FOLDER in market.columns:
        rows = rows.where(F.col(DATE_FOLDER).between(F.to_date(start), F.to_date(as_of)))
    return rows


def latest_time(market: DataFrame) -> Column:
    """Newest timestamp as a one-row subquery, to stand in for the clock."""
    return market.agg(F.max("timestamp")).scalar()


def scan_latest_n(
    market: DataFrame,
    n: int,
    time_col: str = "timestamp",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """The newest ``n`` rows."""
    return market.orderBy(F.col(time_col).desc(), *(F.col(c) for c in tie_break)).limit(n)


def scan_features(
    features: DataFrame,
    columns: Sequence[str] = FEATURE_SCAN_COLUMNS,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Chosen feature columns, newest target first."""
    keys = [c for c in tie_break if c not in columns]
    return features.select(*columns, *keys).orderBy(
        F.col("target_time").desc(), *(F.col(c) for c in tie_break)
    )


def load_feature_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Stored feature table in window order."""
    return spark.read.parquet(path).orderBy("window_id")


def stored_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, None when nothing is there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def table_rows(spark: SparkSession, path: str) -> int:
    """Rows stored at a path, 0 when nothing is there yet. Runs a job."""
    stored = stored_rows(spark, path)
    return 0 if stored is None else stored.count()


def sink_replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table, replacing what was there, and return it as stored."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def sink_append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Append to a table; one row with the totals before and after and the rows added."""
    spark = df.sparkSession
    before = table_rows(spark, path)
    df.write.mode("append").partitionBy(*partition_by).parquet(path)
    total = spark.read.parquet(path).agg(F.count("*").alias("total_rows"))
    return total.select(
        F.lit(before).cast("bigint").alias("rows_before"),
        "total_rows",
        F.greatest(F.col("total_rows") - before, F.lit(0)).cast("bigint").alias("rows_added"),
    )


def store_market(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Write market rows in folders by market and date, and return the table.

    Rows are gathered by folder first, so a folder gets few files; adaptive
    execution splits a folder that holds very many rows.
    """
    dated = df.withColumn(DATE_FOLDER, F.to_date("timestamp"))
    folders = [c for c in ("iso", DATE_FOLDER) if c in dated.columns]
    dated.hint("rebalance", *folders).write.mode(mode).partitionBy(*folders).parquet(path)
    return df.sparkSession.read.parquet(path)


def sink_audit(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Whether a stored table holds as many rows as the frame it came from."""
    held = df.agg(F.count("*")).scalar()
    counts = stored.agg(F.count("*").alias("stored_rows")).withColumn("frame_rows", held)
    return counts.withColumn("rows_match", F.col("frame_rows") == F.col("stored_rows"))
