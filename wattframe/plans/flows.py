"""The three flows a user of the package runs end to end."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.operators.baseline import INVALID_TIME, forecast_bulk, parse_requests
from wattframe.operators.cleaning import PRICE_CAP, clean_prices
from wattframe.operators.features import export_sequences, feature_matrix
from wattframe.operators.forest import TooFewRows, forecast_model, train_forest
from wattframe.operators.retrieval import (
    TOP_K,
    attach_metadata,
    build_prompt,
    cosine_topk,
    render_hits,
    response_context,
)
from wattframe.operators.timeseries import POINT, WINDOW_HOURS, at_top_hub, prepare_hourly
from wattframe.sources.tables import latest_time, scan_days_back, sink_replace


def market_to_features(
    market: DataFrame,
    cap: float = PRICE_CAP,
    window_size: int = WINDOW_HOURS,
    top_hub_only: bool = False,
    keys: Sequence[str] = POINT,
    tie_break: str | None = None,
) -> DataFrame:
    """Raw prices to the feature matrix: clean, average by hour, fill, window, measure."""
    cleaned = clean_prices(market, cap=cap, keys=keys, tie_break=tie_break)
    if top_hub_only:
        cleaned = at_top_hub(cleaned, keys[0])
    return feature_matrix(prepare_hourly(cleaned, keys), window_size, keys)


def store_features(features: DataFrame, path: str) -> DataFrame:
    """Write the matrix with sequences as text and return it as stored."""
    return sink_replace(export_sequences(features), path)


def train_if_possible(features: DataFrame) -> PipelineModel | None:
    """The forest, or None where the features hold too few usable rows. Runs jobs."""
    try:
        return train_forest(features)
    except TooFewRows:
        return None


def requests_to_forecasts(
    requests: DataFrame,
    market: DataFrame,
    model: PipelineModel | None = None,
    text: str = "requested",
    recent_days: int | None = None,
) -> DataFrame:
    """Request texts to forecasts, by the model when there is one, else by rule.

    The rule takes the mean price of the last ``recent_days`` days, by default of
    the whole market. Unreadable texts come back with an error and no price.
    """
    if model is None:
        recent = market if recent_days is None else scan_days_back(market, latest_time(market), recent_days)
        return forecast_bulk(requests, recent, text)
    parsed = parse_requests(requests, text)
    readable = F.col("target_time").isNotNull()
    failed = parsed.where(~readable).withColumn("error", F.lit(INVALID_TIME))
    forecasts = forecast_model(model, parsed.where(readable))
    return forecasts.unionByName(failed, allowMissingColumns=True)


def questions_to_prompts(
    questions: DataFrame,
    vectors: DataFrame,
    metadata: DataFrame,
    encode: Callable[[DataFrame], DataFrame],
    k: int = TOP_K,
) -> tuple[DataFrame, DataFrame]:
    """Questions ``(query_id, question)`` to prompts and to the context they rest on.

    ``encode`` adds an ``embedding`` to a frame with a ``text`` column.
    """
    encoded = encode(questions.withColumnRenamed("question", "text")).select(
        "query_id", "embedding"
    )
    rendered = render_hits(attach_metadata(cosine_topk(vectors, encoded, k), metadata))
    return build_prompt(questions, rendered), response_context(rendered)
