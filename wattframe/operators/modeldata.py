"""Train/test preparation of a feature matrix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions.hashing import shuffle_key
from wattframe.operators.cleaning import feature_columns, features_fill, features_finite
from wattframe.sources.tables import FORECAST_INPUTS

# Share of test rows and seed.
TEST_SHARE = 0.2
SEED = 42


def assemble(
    features: DataFrame, columns: Sequence[str] | None = None, target: str = "target_price"
) -> DataFrame:
    """Feature vector and target, with the remaining columns kept."""
    inputs = list(columns or feature_columns(features))
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    return assembler.transform(features).withColumn("label", F.col(target).cast("double"))


def forecast_inputs(features: DataFrame) -> DataFrame:
    """The nine forecaster columns, filled, finite rows only."""
    filled = features_fill(features, (*FORECAST_INPUTS, "target_price"))
    return features_finite(filled, FORECAST_INPUTS)


def _cut_key(keyed: DataFrame, rows: Column) -> DataFrame:
    """One row: the key of the last of the first ``rows`` rows in key order.

    Keys are uniform hex text. Counting by the first four digits (65,536 groups
    at most) finds the group of that row, and only that group is ordered.
    """
    prefix = F.substring("_key", 1, 4)
    counts = keyed.groupBy(prefix.alias("_prefix")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_upto", F.sum("_n").over(Window.orderBy("_prefix")))
    counts = counts.withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    holding = counts.withColumn("_rows", rows).where(
        (F.col("_upto") - F.col("_n") < F.col("_rows")) & (F.col("_rows") <= F.col("_upto"))
    )
    group = (
        keyed.withColumn("_prefix", prefix)
        .join(F.broadcast(holding), "_prefix")
        .withColumn(
            "_place",
            F.row_number().over(Window.partitionBy("_prefix").orderBy("_key"))
            + F.col("_upto")
            - F.col("_n"),
        )
    )
    return group.where(F.col("_place") == F.col("_rows")).select("_key")


def split_train_test(
    df: DataFrame,
    ids: Sequence[str],
    test_share: float = TEST_SHARE,
    seed: int = SEED,
    round_up: bool = True,
) -> DataFrame:
    """Mark an exact share of rows, chosen in hashed order of their ids, as test rows.

    The ids must identify a row. The table itself is not shuffled: a hashed key
    is compared with one cut key.
    """
    keyed = df.withColumn("_key", shuffle_key(*(F.col(c) for c in ids), seed=seed))
    wanted = F.col("_total") * F.lit(test_share)
    rows = (F.ceil(wanted - F.lit(1e-9)) if round_up else F.floor(wanted + F.lit(1e-9)))
    cut = _cut_key(keyed.select("_key"), rows.cast("bigint")).scalar()
    return keyed.withColumn("is_test", F.coalesce(F.col("_key") <= cut, F.lit(False))).drop("_key")


def time_cut(df: DataFrame, test_share: float = TEST_SHARE, time: str = "target_time") -> Column:
    """The time from which the last ``test_share`` of the covered span begins."""
    first, last = F.unix_micros(F.min(time)), F.unix_micros(F.max(time))
    return df.agg(F.timestamp_micros(last - F.floor((last - first) * test_share))).scalar()


def split_in_time(df: DataFrame, cut: Column, time: str = "target_time") -> DataFrame:
    """Mark rows from ``cut`` on as test rows: nothing is tested on what came before."""
    return df.withColumn("is_test", F.col(time) >= cut)


def standardize(
    df: DataFrame, columns: Sequence[str], fit_on: Column | None = None
) -> DataFrame:
    """Centre and scale by mean and population deviation of the rows ``fit_on`` selects.

    A column without spread is only centred.
    """
    fitted = df if fit_on is None else df.where(fit_on)
    stats = fitted.agg(
        F.struct(
            *(F.avg(c).alias(f"{c}_mean") for c in columns),
            *(F.stddev_pop(c).alias(f"{c}_std") for c in columns),
        ).alias("s")
    ).scalar()

    def scaled(c: str) -> Column:
        std = F.col(f"_stats.{c}_std")
        return (F.col(c) - F.col(f"_stats.{c}_mean")) / F.when(std == 0, 1.0).otherwise(std)

    return (
        df.withColumn("_stats", stats).withColumns({c: scaled(c) for c in columns}).drop("_stats")
    )
