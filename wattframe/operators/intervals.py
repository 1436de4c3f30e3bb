"""Nearest-in-time correlation of market and feature rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _hours(count: int):
    return F.make_dt_interval(F.lit(0), F.lit(count))


def _answers(
    features: DataFrame,
    columns: Sequence[str],
    by: Sequence[str],
    tie_break: Sequence[str],
    time: str,
) -> DataFrame:
    """Per market hour, intervals of ``row time + 1h`` and what matches in each.

    A row in hour h can match features of hours h-1, h and h+1. Any feature of h
    is close enough; of h-1 only the newest need be tried; within h+1 the answer
    depends on the minute, so that hour is cut at its feature times. Only one
    feature per distinct time is kept, so all this is small next to the market.
    """
    payload = F.struct(F.col(time).alias("t"), *(F.col(c) for c in columns))
    winner = F.min_by(payload, F.struct(*tie_break)) if tie_break else F.min(payload)
    distinct = (
        features.where(F.col(time).isNotNull())
        .groupBy(*by, F.col(time).alias("_t"))
        .agg(winner.alias("_f"))
        .withColumn("_hour", F.date_trunc("hour", "_t"))
    )
    newest = distinct.groupBy(*by, "_hour").agg(
        F.max_by("_f", "_t").alias("_f"), F.min("_t").alias("_first")
    )

    def role(name: str, shift: int):
        return F.struct(F.lit(name).alias("role"), (F.col("_hour") + _hours(shift)).alias("h"))

    def only(name: str, column: str):
        return F.any_value(F.when(F.col("_r.role") == name, F.col(column)), ignoreNulls=True)

    hours = (
        newest.withColumn("_r", F.explode(F.array(role("next", -1), role("same", 0), role("prev", 1))))
        .groupBy(*by, F.col("_r.h").alias("_h"))
        .agg(
            only("next", "_first").alias("_until"),
            only("same", "_f").alias("_same"),
            only("prev", "_f").alias("_prev"),
        )
    )
    none = F.when(F.lit(False), F.col("_same"))
    before_first = hours.select(
        *by, "_h", F.lit(None).cast("timestamp").alias("_from"), "_until",
        none.alias("_next"), "_same", "_prev",
    )
    following = F.lead("_t").over(Window.partitionBy(*by, "_hour").orderBy("_t"))
    after = distinct.select(
        *by,
        (F.col("_hour") - _hours(1)).alias("_h"),
        F.col("_t").alias("_from"),
        following.alias("_until"),
        F.col("_f").alias("_next"),
    ).join(hours.drop("_until"), [*by, "_h"])
    return before_first.unionByName(after)


def nearest_feature(
    market: DataFrame,
    features: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    tie_break: Sequence[str] = (),
    market_time: str = "timestamp",
    feature_time: str = "target_time",
) -> DataFrame:
    """Each market row with the newest feature row less than one hour away, else nulls.

    ``by`` restricts matches to equal keys. Of features with equal time the one
    least by ``tie_break`` counts. The chosen columns come back prefixed with
    ``feature_``.

    Every market row meets at most one interval, so the join adds no rows, needs
    no ranking after it, and an adaptive skew join can split a hot hour.
    """
    answers = _answers(features, columns, by, tie_break, feature_time)
    answers = answers.withColumnsRenamed({key: f"_k_{key}" for key in by})
    time = F.col(market_time)
    reach = time + _hours(1)
    meets = (
        (F.date_trunc("hour", time) == F.col("_h"))
        & (F.col("_from").isNull() | (F.col("_from") < reach))
        & (F.col("_until").isNull() | (reach <= F.col("_until")))
    )
    for key in by:
        meets &= F.col(key) == F.col(f"_k_{key}")
    close = F.when(F.col("_prev.t") > time - _hours(1), F.col("_prev"))
    matched = market.join(answers, meets, "left").withColumn(
        "_match", F.coalesce("_next", "_same", close)
    )
    return matched.select(
        *market.columns,
        F.col("_match.t").alias(f"feature_{feature_time}"),
        *(F.col(f"_match.{c}").alias(f"feature_{c}") for c in columns if c != feature_time),
    )
