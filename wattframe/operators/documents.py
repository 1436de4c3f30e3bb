"""Text documents made from market and feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import bands
from wattframe.functions.numbers import fixed
from wattframe.functions.text import fill
from wattframe.functions.times import day_name, minute_id, minute_text

OBSERVATION = "market_observation"
ANALYSIS = "market_analysis"

# Wording of the two kinds of documents.
OBSERVATION_TEXT = (
    "Power market observation at {point} on {day} {time}. "
    "Electricity price is ${price}/MWh indicating {price_level} during {time_period}. "
    "This represents real-time locational marginal pricing from ERCOT Texas grid operations."
)
ANALYSIS_TEXT = (
    "Power market analysis for {time} showing {trend} price trend with {volatility}. "
    "The 24-hour average price was ${mean}/MWh with standard deviation of ${std}. "
    "Market exhibited {momentum} with price range from ${low} to ${high}/MWh. "
    "This {period} {peak} forecast targets ${target}/MWh for next hour dispatch planning."
)


def _dollars(price: Column) -> Column:
    return fixed(price, 2)


def docs_observation(market: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One document per market row; columns to ``keep`` are carried along."""
    ts, point, price = (F.col(c) for c in ("timestamp", "settlement_point", "price"))
    level = bands.by_upper_bound(price, bands.DOCUMENT_PRICE_BANDS)
    period = bands.by_hour(F.hour(ts), bands.DOCUMENT_HOUR_BANDS)
    return market.select(
        F.concat(F.lit("market_"), point, F.lit("_"), minute_id(ts)).alias("doc_id"),
        fill(
            OBSERVATION_TEXT,
            point=point,
            day=day_name(ts),
            time=minute_text(ts),
            price=_dollars(price),
            price_level=level,
            time_period=period,
        ).alias("text"),
        F.lit(OBSERVATION).alias("type"),
        minute_text(ts).alias("timestamp"),
        point.alias("settlement_point"),
        price.cast("double").alias("price"),
        F.hour(ts).alias("hour"),
        F.weekday(ts).alias("day_of_week"),
        level.alias("price_level"),
        period.alias("time_period"),
        *keep,
    )


def docs_analysis(features: DataFrame) -> DataFrame:
    """One document per feature row; a missing sequence gives a price range of 0."""
    ts = F.col("target_time")
    low = F.coalesce(F.array_min("price_sequence"), F.lit(0.0))
    high = F.coalesce(F.array_max("price_sequence"), F.lit(0.0))
    trend = bands.trend_word(F.col("trend_slope"))
    volatility = bands.volatility_phrase(F.col("price_volatility"))
    weekend, peak = F.col("is_weekend") == 1, F.col("is_peak_hour") == 1
    return features.select(
        F.concat(
            F.lit("analysis_"), F.col("window_id").cast("string"), F.lit("_"), minute_id(ts)
        ).alias("doc_id"),
        fill(
            ANALYSIS_TEXT,
            time=minute_text(ts),
            trend=trend,
            volatility=volatility,
            mean=_dollars(F.col("price_mean")),
            std=_dollars(F.col("price_std")),
            momentum=bands.momentum_word(F.col("momentum_1h")),
            low=_dollars(low),
            high=_dollars(high),
            period=F.when(weekend, "weekend").otherwise("weekday"),
            peak=F.when(peak, "peak demand period").otherwise("off-peak period"),
            target=_dollars(F.col("target_price")),
        ).alias("text"),
        F.lit(ANALYSIS).alias("type"),
        minute_text(ts).alias("timestamp"),
        F.col("target_price").cast("double").alias("target_price"),
        "price_mean",
        "price_std",
        "trend_slope",
        "price_volatility",
        "hour_of_day",
        weekend.alias("is_weekend"),
        peak.alias("is_peak_hour"),
        "momentum_1h",
        (high - low).alias("price_range"),
        trend.alias("trend_direction"),
        volatility.alias("volatility_level"),
    )


def docs_all(observations: DataFrame, analyses: DataFrame) -> DataFrame:
    """Both kinds in one table; metadata a kind lacks is null."""
    return observations.unionByName(analyses, allowMissingColumns=True)


def docs_upsert(
    documents: DataFrame, recency: Sequence[str], doc_id: str = "doc_id"
) -> DataFrame:
    """One row per id, the latest by ``recency``, which has to be unique within an id.

    Only ids and recency are aggregated, combined before the shuffle, so an id with
    very many copies does not gather them in one task and no text is sorted to find
    the latest. The rest of the winner comes by a join.
    """
    order = F.col(recency[0]) if len(recency) == 1 else F.struct(*recency)
    latest = documents.groupBy(doc_id).agg(F.max(order).alias("_latest"))
    same = F.col(f"d.{doc_id}").eqNullSafe(F.col(f"l.{doc_id}"))
    newest = F.col(f"d.{recency[0]}") if len(recency) == 1 else F.struct(*(F.col(f"d.{c}") for c in recency))
    return (
        documents.alias("d")
        .join(latest.alias("l"), same & newest.eqNullSafe(F.col("l._latest")), "left_semi")
    )


def documents_for_embedding(documents: DataFrame) -> DataFrame:
    """Id, text and the metadata as a string map, empty entries left out."""
    fields = [c for c in documents.columns if c not in ("doc_id", "text")]
    entries = F.array(*(F.struct(F.lit(c), F.col(c).cast("string")) for c in fields))
    present = F.filter(entries, lambda e: e["col2"].isNotNull())
    return documents.select("doc_id", "text", F.map_from_entries(present).alias("metadata"))
