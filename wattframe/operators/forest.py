"""Random-forest forecaster on MLlib."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions.numbers import clamp, round_even
from wattframe.functions.times import time_features
from wattframe.operators.modeldata import SEED, forecast_inputs
from wattframe.operators.trees import NODE_SCHEMA, nodes_of, score
from wattframe.sources.tables import FORECAST_INPUTS

# Size of the forest and rows it needs.
TREES = 50
DEPTH = 10
MIN_ROWS = 10

# Market inputs assumed for a future hour, peak and night factors,
# price bounds, confidence.
DEFAULT_INPUTS = {
    "price_mean": 35.0,
    "price_std": 8.0,
    "trend_slope": 0.0,
    "price_volatility": 0.2,
    "momentum_1h": 0.0,
}
MODEL_PEAK_FACTOR = 1.3
MODEL_NIGHT_FACTOR = 0.8
NIGHT_LAST_HOUR = 6
PRICE_BOUNDS = (15.0, 100.0)
MODEL_CONFIDENCE = 0.85
CURRENCY = "USD/MWh"


class TooFewRows(ValueError):
    """A table holds too few usable rows to fit a forest."""


def _scaler(rows: DataFrame, inputs: Sequence[str]) -> SQLTransformer:
    """Standardising step with the fitted numbers written in, so it is saved with the model."""
    stats = rows.agg(
        F.count("*").alias("n"),
        *(F.avg(c).alias(f"{c}_mean") for c in inputs),
        *(F.stddev_pop(c).alias(f"{c}_std") for c in inputs),
    ).first()
    if stats["n"] < MIN_ROWS:
        raise TooFewRows(f"{stats['n']} usable rows; at least {MIN_ROWS} are needed")
    scaled = ", ".join(
        f"(cast({c} as double) - {stats[f'{c}_mean']!r}D) / {stats[f'{c}_std'] or 1.0!r}D "
        f"AS {c}_scaled"
        for c in inputs
    )
    return SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")


def train_forest(
    features: DataFrame,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
    inputs: Sequence[str] = FORECAST_INPUTS,
    bootstrap: bool = True,
) -> PipelineModel:
    """Fit scaler, assembler and forest. Runs jobs.

    Without ``bootstrap`` every tree sees all rows and all inputs.
    """
    rows = forecast_inputs(features).select(
        *FORECAST_INPUTS, F.col("target_price").cast("double").alias("label")
    )
    # Dealt by their values, so that the forest does not depend on the cluster's cores.
    rows = rows.repartition(*FORECAST_INPUTS).persist()
    pipeline = Pipeline(
        stages=[
            _scaler(rows, inputs),
            VectorAssembler(
                inputCols=[f"{c}_scaled" for c in inputs], outputCol="features"
            ),
            RandomForestRegressor(
                featuresCol="features",
                labelCol="label",
                predictionCol="prediction",
                numTrees=trees,
                maxDepth=depth,
                seed=seed,
                bootstrap=bootstrap,
                featureSubsetStrategy="auto" if bootstrap else "all",
                cacheNodeIds=False,
            ),
        ]
    )
    try:
        return pipeline.fit(rows)
    finally:
        rows.unpersist()


def predict(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Feature rows with the model's ``prediction``; helper columns dropped."""
    helpers = model.stages[1].getInputCols()
    return model.transform(features).drop("features", *helpers)


def r_squared(model: PipelineModel, features: DataFrame) -> float:
    """R2 of the model on the usable rows of a feature table. Runs a job."""
    rows = forecast_inputs(features).withColumn("label", F.col("target_price").cast("double"))
    return RegressionEvaluator(metricName="r2").evaluate(predict(model, rows))


_SCALED = re.compile(r"cast\((\w+) as double\) - (\S+)D\) / (\S+)D AS")


def export_nodes(model: PipelineModel, path: str) -> DataFrame:
    """The forest's nodes as a table, written to a path. Runs jobs."""
    scaler, assembler, forest = model.stages
    spark = SparkSession.active()
    scaling = {c: (float(shift), float(scale)) for c, shift, scale in _SCALED.findall(scaler.getStatement())}
    inputs = [c.removesuffix("_scaled") for c in assembler.getInputCols()]
    forest.write().overwrite().save(f"{path}/stage")
    nodes = nodes_of(spark.read.parquet(f"{path}/stage/data"), inputs, scaling)
    nodes.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    return spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def bounded_price(price: Column) -> Column:
    return round_even(clamp(price, *PRICE_BOUNDS), 2)


def _asked_inputs(requests: DataFrame, time: str) -> DataFrame:
    calendar = time_features(F.col(time))
    return requests.withColumns({**calendar, **{k: F.lit(v) for k, v in DEFAULT_INPUTS.items()}})


def _forecasts(scored: DataFrame, columns: Sequence[str], time: str) -> DataFrame:
    factor = (
        F.when(F.col("is_peak_hour") == 1, MODEL_PEAK_FACTOR)
        .when(F.col("hour_of_day") <= NIGHT_LAST_HOUR, MODEL_NIGHT_FACTOR)
        .otherwise(1.0)
    )
    return scored.select(
        *columns,
        bounded_price(F.col("prediction") * factor).alias("predicted_price"),
        F.lit(CURRENCY).alias("currency"),
        F.lit(MODEL_CONFIDENCE).alias("confidence"),
        F.lit("RandomForest").alias("model_type"),
        F.struct(*time_features(F.col(time))).alias("time_features"),
    )


def forecast_model(model: PipelineModel, requests: DataFrame, time: str = "target_time") -> DataFrame:
    """Price forecast for each requested hour, from calendar features and default inputs."""
    return _forecasts(predict(model, _asked_inputs(requests, time)), requests.columns, time)


def forecast_nodes(
    nodes: DataFrame,
    requests: DataFrame,
    time: str = "target_time",
    inputs: Sequence[str] = FORECAST_INPUTS,
    depth: int = DEPTH,
) -> DataFrame:
    """The same from a table of nodes.

    All inputs follow from the hour and the weekday, so the forest is walked for 168
    combinations at most, however many requests there are.
    """
    asked = _asked_inputs(requests, time)
    return _forecasts(score(asked, nodes, inputs, depth, by=("hour_of_day", "day_of_week")), requests.columns, time)
