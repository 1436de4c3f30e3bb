"""Word scales for prices, hours, trends, volatility and momentum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (exclusive upper price, word). The last word has no bound.
DOCUMENT_PRICE_BANDS = (
    (20, "low price"),
    (40, "moderate price"),
    (60, "high price"),
    (None, "very high price"),
)
PAIR_PRICE_LEVELS = (
    (25, "low"),
    (45, "moderate"),
    (70, "high"),
    (None, "very high"),
)
PAIR_PRICE_CONDITIONS = (
    (25, "low"),
    (45, "normal"),
    (70, "elevated"),
    (None, "spiking"),
)

# Fixed values: (first hour, last hour, word). The last word covers the rest.
DOCUMENT_HOUR_BANDS = (
    (6, 9, "morning ramp-up"),
    (14, 18, "afternoon peak"),
    (19, 22, "evening demand"),
    (None, None, "off-peak hours"),
)
PAIR_HOUR_FACTORS = (
    (6, 9, "morning ramp-up period"),
    (14, 18, "afternoon peak demand"),
    (19, 22, "evening demand period"),
    (None, None, "off-peak hours"),
)
LOAD_BY_HOUR = (
    (14, 18, "high load expected"),
    (19, 22, "peak load possible"),
    (6, 9, "increasing load"),
    (None, None, "low load expected"),
)
STRESS_BY_HOUR = (
    (14, 18, "elevated"),
    (19, 22, "high"),
    (6, 9, "moderate"),
    (None, None, "low"),
)

# Volatility above 0.3 is high, above 0.15 moderate.
VOLATILITY_HIGH = 0.3
VOLATILITY_MODERATE = 0.15


def by_upper_bound(value: Column, scale) -> Column:
    """First word whose bound lies above the value."""
    *bounded, (_, rest) = scale
    chain = F
    for bound, word in bounded:
        chain = chain.when(value < bound, word)
    return chain.when(value.isNotNull(), rest)


def by_hour(hour: Column, scale) -> Column:
    """Word of the hour range that holds the hour."""
    *ranges, (_, _, rest) = scale
    chain = F
    for first, last, word in ranges:
        chain = chain.when(hour.between(first, last), word)
    return chain.when(hour.isNotNull(), rest)


def by_sign(value: Column, margin: float, above: str, below: str, between: str) -> Column:
    """One of three words, by whether the value passes +margin or -margin."""
    return (
        F.when(value > margin, above)
        .when(value < -margin, below)
        .otherwise(between)
    )


def trend_word(slope: Column) -> Column:
    return by_sign(slope, 0.0, "increasing", "decreasing", "stable")


def trend_stance(slope: Column) -> Column:
    return by_sign(slope, 0.1, "bullish", "bearish", "neutral")


def momentum_word(momentum: Column) -> Column:
    return by_sign(momentum, 1.0, "upward momentum", "downward momentum", "stable momentum")


def momentum_pressure(momentum: Column) -> Column:
    return by_sign(momentum, 1.0, "upward pressure", "downward pressure", "stable conditions")


def volatility_level(volatility: Column) -> Column:
    return (
        F.when(volatility > VOLATILITY_HIGH, "high")
        .when(volatility > VOLATILITY_MODERATE, "moderate")
        .otherwise("low")
    )


def volatility_phrase(volatility: Column) -> Column:
    return F.concat(volatility_level(volatility), F.lit(" volatility"))
