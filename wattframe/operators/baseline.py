"""Rule-based forecasts and bulk requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.times import parse_request_time, time_features
from wattframe.operators.forest import CURRENCY, NIGHT_LAST_HOUR, bounded_price
from wattframe.operators.reports import baseline_stats

# Factors by hour and day, and confidences.
PEAK_FACTOR = 1.4
NIGHT_FACTOR = 0.7
WEEKEND_FACTOR = 0.9
BASELINE_CONFIDENCE = 0.65
FALLBACK_PRICE = 35.0
FALLBACK_CONFIDENCE = 0.5
INVALID_TIME = "Invalid timestamp format"


def forecast_baseline(
    requests: DataFrame, recent: DataFrame, time: str = "target_time"
) -> DataFrame:
    """Mean recent price adjusted for peak, night or weekend, for each requested time."""
    calendar = time_features(F.col(time))
    price = baseline_stats(recent).select("baseline_price").scalar()
    factor = (
        F.when(F.col("is_peak_hour") == 1, PEAK_FACTOR)
        .when(F.col("hour_of_day") <= NIGHT_LAST_HOUR, NIGHT_FACTOR)
        .when(F.col("is_weekend") == 1, WEEKEND_FACTOR)
        .otherwise(1.0)
    )
    return requests.withColumns(calendar).select(
        *requests.columns,
        bounded_price(price * factor).alias("predicted_price"),
        F.lit(CURRENCY).alias("currency"),
        F.lit(BASELINE_CONFIDENCE).alias("confidence"),
        F.lit("Baseline").alias("model_type"),
        *calendar,
    )


def with_fallback(forecasts: DataFrame, error: str = "no price") -> DataFrame:
    """Replace a missing price by the fallback price, confidence and an error text."""
    missing = F.col("predicted_price").isNull()
    return forecasts.withColumns(
        {
            "predicted_price": F.coalesce("predicted_price", F.lit(FALLBACK_PRICE)),
            "confidence": F.when(missing, FALLBACK_CONFIDENCE).otherwise(F.col("confidence")),
            "model_type": F.when(missing, "Fallback").otherwise(F.col("model_type")),
            "error": F.when(missing, error),
        }
    )


def parse_requests(
    requests: DataFrame, text: str = "requested", now: Column | None = None
) -> DataFrame:
    """Request texts with the time they stand for, null when unreadable.

    With ``now`` given, an empty request stands for one hour from then.
    """
    time = parse_request_time(F.col(text))
    if now is not None:
        empty = F.coalesce(F.trim(F.col(text)) == "", F.lit(True))
        time = F.when(empty, now + F.make_dt_interval(F.lit(0), F.lit(1))).otherwise(time)
    return requests.withColumn("target_time", time)


def forecast_bulk(requests: DataFrame, recent: DataFrame, text: str = "requested") -> DataFrame:
    """Baseline forecast per request text.

    An unreadable text gets an error and no price; a readable one for which no
    price can be computed gets the fallback.
    """
    forecasts = with_fallback(forecast_baseline(parse_requests(requests, text), recent))
    readable = F.col("target_time").isNotNull()
    return forecasts.select(
        *requests.columns,
        "target_time",
        F.when(readable, F.col("predicted_price")).alias("predicted_price"),
        F.when(readable, F.col("confidence")).alias("confidence"),
        F.when(readable, F.col("model_type")).alias("model_type"),
        F.when(readable, F.col("error")).otherwise(INVALID_TIME).alias("error"),
    )
