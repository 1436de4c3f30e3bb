"""Forecast errors against actual prices and simple baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions.hashing import shuffle_key
from wattframe.operators.modeldata import SEED
from wattframe.operators.quantiles import exact_quantile

# Fixed value: train rows whose mean stands for the last known price.
LAST_ROWS = 3


def _rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def _mae(error: Column) -> Column:
    return F.avg(F.abs(error))


def eval_metrics(
    scored: DataFrame, actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """RMSE, MAE and R2 in one pass."""
    error = F.col(predicted) - F.col(actual)
    spread = F.var_pop(actual)
    return scored.agg(
        _rmse(error).alias("rmse"),
        _mae(error).alias("mae"),
        F.when(spread != 0, 1 - F.avg(error * error) / spread).alias("r2"),
    )


def eval_baselines(
    scored: DataFrame,
    is_test: str = "is_test",
    ids: Sequence[str] = ("settlement_point", "target_time"),
    keys: Sequence[str] = ("settlement_point",),
    time: str = "target_time",
    seed: int = SEED,
) -> DataFrame:
    """Model errors on the test rows next to three baselines.

    ``mean``: mean target of the train rows. ``last``: mean of the last three
    train rows in the split's shuffled order. ``hour``: the target one row
    earlier of the same key, the sound form of a last-hour baseline.
    """
    train = scored.where(~F.col(is_test))
    order = shuffle_key(*(F.col(c) for c in ids), seed=seed)
    mean = train.agg(F.avg("actual")).scalar()
    last = (
        train.select("actual", order.alias("_key"))
        .orderBy(F.col("_key").desc())
        .limit(LAST_ROWS)
        .agg(F.avg("actual"))
        .scalar()
    )
    # One row per key and hour bounds the window.
    before = F.lag("actual").over(Window.partitionBy(*keys).orderBy(time))
    test = (
        scored.withColumn("_hour", before)
        .where(F.col(is_test))
        .withColumns({"_mean": mean, "_last": last})
    )
    errors = {
        "model": F.col("predicted") - F.col("actual"),
        "mean": F.col("_mean") - F.col("actual"),
        "last": F.col("_last") - F.col("actual"),
        "hour": F.col("_hour") - F.col("actual"),
    }
    metrics = test.agg(
        *(_rmse(e).alias(f"{name}_rmse") for name, e in errors.items()),
        *(_mae(e).alias(f"{name}_mae") for name, e in errors.items()),
    )
    model = F.col("model_rmse")
    others = [name for name in errors if name != "model"]
    return metrics.select(
        "*",
        *(
            F.try_divide((F.col(f"{n}_rmse") - model) * 100, F.col(f"{n}_rmse")).alias(
                f"gain_over_{n}_pct"
            )
            for n in others
        ),
        *((model < F.col(f"{n}_rmse")).alias(f"better_than_{n}") for n in others),
    )


def error_profile(scored: DataFrame) -> DataFrame:
    """Bias, spread and extremes of the errors; percentages leave out zero actuals."""
    error = F.col("predicted") - F.col("actual")
    pct = F.when(F.col("actual") != 0, F.abs(error / F.col("actual")) * 100)
    measured = scored.select(error.alias("_error"), pct.alias("_pct"))
    median = exact_quantile(measured, "_pct").scalar()
    return measured.agg(
        F.avg("_error").alias("bias"),
        F.stddev_pop("_error").alias("error_std"),
        F.max(F.abs("_error")).alias("max_abs_error"),
        F.avg("_pct").alias("mean_abs_pct_error"),
    ).withColumn("median_abs_pct_error", median)


def pred_vs_actual(scored: DataFrame) -> DataFrame:
    """Rows with error and percentage error, 0 where the actual is 0."""
    error = F.col("predicted") - F.col("actual")
    return scored.withColumns(
        {
            "error": error,
            "error_pct": F.when(F.col("actual") != 0, error / F.col("actual") * 100).otherwise(0.0),
        }
    )


def metric_history(
    history: DataFrame, keys: Sequence[str] = ("run",), epoch: str = "epoch"
) -> DataFrame:
    """Loss history with change against the epoch before, new-best flag, total reduction.

    A run has one row per epoch, which bounds the window.
    """
    ordered = Window.partitionBy(*keys).orderBy(epoch)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    past = ordered.rowsBetween(Window.unboundedPreceding, -1)
    previous = F.lag("val_loss").over(ordered)
    best = F.min("val_loss").over(past)
    first, last = F.first("train_loss").over(whole), F.last("train_loss").over(whole)
    return history.withColumns(
        {
            "change_pct": F.try_divide((previous - F.col("val_loss")) * 100, previous),
            "is_best": F.coalesce(F.col("val_loss") < best, F.lit(True)),
            "reduction_pct": F.try_divide((first - last) * 100, first),
            "loss_decreased": last < first,
        }
    )
