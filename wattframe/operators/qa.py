"""Question/answer pairs from market and feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import bands
from wattframe.functions.hashing import keep_share, pick, shuffle_key
from wattframe.functions.numbers import fixed
from wattframe.functions.text import fill
from wattframe.functions.times import clock_on_day

FORECAST = "price_forecast"
DISPATCH = "dispatch_decision"
MARKET = "market_analysis"
OPERATIONAL = "operational"
TECHNICAL = "technical_analysis"

# Feature columns the pairs draw on.
MATCHED = ("trend_slope", "price_volatility", "momentum_1h")

# Share of rows that get a pair of each type.
SHARES = {FORECAST: 0.3, DISPATCH: 0.3, MARKET: 0.25, OPERATIONAL: 0.15, TECHNICAL: 0.5}

# Prices above which dispatch is advised or considered.
DISPATCH_ABOVE = 50
CONSIDER_ABOVE = 35

# Question wordings.
QUESTIONS = {
    FORECAST: (
        "What is the expected price for {time}?",
        "What will electricity prices be at {time}?",
        "Price forecast for {time}?",
        "Expected LMP at {time}?",
    ),
    DISPATCH: (
        "Should we start the gas peaker for {time}?",
        "Recommend dispatch strategy for {time}?",
        "Is it profitable to dispatch Unit 1 at {time}?",
        "Should we increase generation for {time}?",
    ),
    MARKET: (
        "Why are prices {condition} at {time}?",
        "What's driving the price {condition} at {time}?",
        "Market conditions at {time}?",
        "Explain the price volatility at {time}?",
    ),
    OPERATIONAL: (
        "What's the load forecast for {time}?",
        "Peak demand expected at {time}?",
        "Should we prepare for high demand at {time}?",
        "Grid stress indicators for {time}?",
    ),
    TECHNICAL: ("What does the technical analysis show for {time}?",),
}

# Answer wordings.
FORECAST_MATCHED = (
    "The expected price for {time} is ${price}/MWh. Market shows {trend} trend with "
    "{volatility}. This represents {level} pricing for {point}."
)
FORECAST_ALONE = (
    "The current price for {time} is ${price}/MWh, indicating {level} market conditions "
    "at {point}."
)
DISPATCH_ANSWER = (
    "{recommendation}. {reason}. Current market conditions show {level} pricing at {point}."
)
DISPATCH_YES = ("Yes, dispatch recommended", "Price of ${price}/MWh exceeds typical marginal costs")
DISPATCH_MAYBE = ("Consider dispatch", "Price of ${price}/MWh is borderline profitable")
DISPATCH_NO = ("No dispatch recommended", "Price of ${price}/MWh is below marginal costs")
MARKET_MATCHED = (
    "Prices are {condition} at {time} due to {factor} combined with {pressure}. The "
    "${price}/MWh level reflects typical {level} market conditions with current "
    "supply-demand balance."
)
MARKET_ALONE = (
    "Prices are {condition} at {time} primarily due to {factor}. The ${price}/MWh level "
    "indicates {level} market conditions."
)
OPERATIONAL_ANSWER = (
    "For {time}, {load} with {stress} grid stress indicators. Current price of "
    "${price}/MWh suggests {level} demand levels."
)
TECHNICAL_ANSWER = (
    "Technical analysis for {time} shows {stance} trend with {volatility} volatility. "
    "24-hour average is ${mean}/MWh, targeting ${target}/MWh. Market exhibits trend slope "
    "of {slope}."
)


def _slots() -> dict[str, Column]:
    hour = F.hour("timestamp")
    return {
        "time": clock_on_day(F.col("timestamp")),
        "price": fixed(F.col("price"), 2),
        "point": F.col("settlement_point"),
        "level": bands.by_upper_bound(F.col("price"), bands.PAIR_PRICE_LEVELS),
        "condition": bands.by_upper_bound(F.col("price"), bands.PAIR_PRICE_CONDITIONS),
        "factor": bands.by_hour(hour, bands.PAIR_HOUR_FACTORS),
        "load": bands.by_hour(hour, bands.LOAD_BY_HOUR),
        "stress": bands.by_hour(hour, bands.STRESS_BY_HOUR),
        "trend": bands.trend_word(F.col("feature_trend_slope")),
        "volatility": bands.volatility_phrase(F.col("feature_price_volatility")),
        "pressure": bands.momentum_pressure(F.col("feature_momentum_1h")),
    }


def _technical_slots() -> dict[str, Column]:
    return {
        "time": clock_on_day(F.col("target_time")),
        "stance": bands.trend_stance(F.col("trend_slope")),
        "volatility": bands.volatility_level(F.col("price_volatility")),
        "mean": fixed(F.col("price_mean"), 2),
        "target": fixed(F.col("target_price"), 2),
        "slope": fixed(F.col("trend_slope"), 3),
    }


def _question(kind: str, key: Column, slots: dict[str, Column]) -> Column:
    wordings = [fill(w, **slots) for w in QUESTIONS[kind]]
    return F.get(F.array(*wordings), pick(key, len(wordings)))


def _dispatch_case(case: int, slots: dict[str, Column]) -> Column:
    """Recommendation (0) or reason (1) by price."""
    text = [fill(c[case], **slots) for c in (DISPATCH_YES, DISPATCH_MAYBE, DISPATCH_NO)]
    price = F.col("price")
    return (
        F.when(price > DISPATCH_ABOVE, text[0])
        .when(price > CONSIDER_ABOVE, text[1])
        .when(price.isNotNull(), text[2])
    )


def _answer(kind: str, slots: dict[str, Column]) -> Column:
    matched = F.col("feature_target_time").isNotNull() if kind in (FORECAST, MARKET) else None
    if kind == FORECAST:
        return F.when(matched, fill(FORECAST_MATCHED, **slots)).otherwise(
            fill(FORECAST_ALONE, **slots)
        )
    if kind == DISPATCH:
        return fill(
            DISPATCH_ANSWER,
            **slots,
            recommendation=_dispatch_case(0, slots),
            reason=_dispatch_case(1, slots),
        )
    if kind == MARKET:
        return F.when(matched, fill(MARKET_MATCHED, **slots)).otherwise(
            fill(MARKET_ALONE, **slots)
        )
    if kind == OPERATIONAL:
        return fill(OPERATIONAL_ANSWER, **slots)
    return fill(TECHNICAL_ANSWER, **slots)


def _pairs(rows: DataFrame, kinds: Sequence[str], slots, ids: Sequence[str], shares, seed: int):
    """All pairs of the given kinds in one pass over the rows."""
    made = []
    for kind in kinds:
        key = shuffle_key(F.lit(kind), *(F.col(c) for c in ids), seed=seed)
        pair = F.struct(
            *(F.col(c).cast("string").alias(c) for c in ids),
            _question(kind, key, slots).alias("question"),
            _answer(kind, slots).alias("answer"),
            F.lit(kind).alias("type"),
            key.alias("pair_key"),
        )
        made.append(F.when(keep_share(key, shares[kind]), pair))
    return rows.select(F.inline(F.array_compact(F.array(*made))))


# Every row gets its pair.
ALL = dict.fromkeys(SHARES, 1.0)


def _one_kind(rows: DataFrame, kind: str, ids: Sequence[str], seed: int) -> DataFrame:
    slots = _technical_slots() if kind == TECHNICAL else _slots()
    return _pairs(rows, (kind,), slots, ids, ALL, seed).drop("pair_key")


def qa_price_forecast(matched: DataFrame, ids: Sequence[str], seed: int = 42) -> DataFrame:
    """A price question for every market row matched by ``nearest_feature``."""
    return _one_kind(matched, FORECAST, ids, seed)


def qa_dispatch(market: DataFrame, ids: Sequence[str], seed: int = 42) -> DataFrame:
    return _one_kind(market, DISPATCH, ids, seed)


def qa_market_analysis(matched: DataFrame, ids: Sequence[str], seed: int = 42) -> DataFrame:
    return _one_kind(matched, MARKET, ids, seed)


def qa_operational(market: DataFrame, ids: Sequence[str], seed: int = 42) -> DataFrame:
    return _one_kind(market, OPERATIONAL, ids, seed)


def qa_technical(features: DataFrame, ids: Sequence[str], seed: int = 42) -> DataFrame:
    return _one_kind(features, TECHNICAL, ids, seed)


def dispatch_recommendation(market: DataFrame) -> DataFrame:
    """Market rows with the dispatch advice and its reason."""
    slots = {"price": fixed(F.col("price"), 2)}
    return market.withColumns(
        {"recommendation": _dispatch_case(0, slots), "reason": _dispatch_case(1, slots)}
    )


def qa_pairs(
    matched: DataFrame,
    features: DataFrame,
    ids: Sequence[str],
    feature_ids: Sequence[str],
    shares: dict[str, float] = SHARES,
    limit: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Sampled pairs of all types.

    Sampling and wording follow hashed row ids, so runs agree. With a ``limit``
    the first so many in shuffled order are kept; ``pair_key`` gives that order.
    """
    from_market = _pairs(matched, (FORECAST, DISPATCH, MARKET, OPERATIONAL), _slots(), ids, shares, seed)
    from_features = _pairs(features, (TECHNICAL,), _technical_slots(), feature_ids, shares, seed)
    columns = ["question", "answer", "type", "pair_key"]
    pairs = from_market.select(*columns).unionByName(from_features.select(*columns))
    return pairs if limit is None else pairs.orderBy("pair_key").limit(limit)


def qa_text(pairs: DataFrame, end: str = "<|endoftext|>") -> DataFrame:
    """Pairs with the text a model is trained on."""
    text = F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer"), F.lit(end))
    return pairs.withColumn("text", text)
