"""Price cleaning, feature filling and quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.functions.numbers import clamp, coerce_double, is_finite
from wattframe.operators.quantiles import approx_quantile, exact_quantile
from wattframe.workspace import cut_lineage

# Bounds of a plausible price.
PRICE_FLOOR = 0.0
PRICE_CAP = 1000.0

POINT = ("settlement_point",)

# Columns of a feature table that are not model inputs.
NON_FEATURES = frozenset(
    {
        "window_id",
        "target_time",
        "target_price",
        "price_sequence",
        "price_sequence_json",
        "settlement_point",
    }
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail when a needed column is not there."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present are {df.columns}")
    return df


def feature_columns(df: DataFrame) -> list[str]:
    """Model inputs: every column but ids, times, targets and sequences."""
    return [c for c in df.columns if c not in NON_FEATURES]


def coerce_price(df: DataFrame, price: str = "price") -> DataFrame:
    return df.withColumn(price, coerce_double(F.col(price)))


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    """Equality of the columns of two aliased tables, null matching null."""
    same = F.lit(True)
    for c in columns:
        same &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return same


def _carry(
    places: DataFrame, keys: Sequence[str], within: Sequence[str], by: str, known: str
) -> DataFrame:
    """``known`` of each place, or the last one before it among the places of ``within``."""
    upto = (
        Window.partitionBy(*keys, *within)
        .orderBy(by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return places.withColumn("_local", F.last(known, ignorenulls=True).over(upto))


def forward_fill(
    df: DataFrame,
    value: str = "price",
    keys: Sequence[str] = POINT,
    time: str = "timestamp",
    tie_break: str | None = None,
) -> DataFrame:
    """Give a null value the latest known value of its key at or before its time.

    Among known values of one time the one with the greatest ``tie_break`` (else
    the greatest value) counts. Rows with a value are passed through without a
    shuffle. For the others one known value per key and time is kept, combined
    before the shuffle, so copies cost nothing. These are searched within their
    second; what a second knows last is carried within its hour, and what an
    hour knows last from hour to hour. So a task orders the distinct times of one
    second, the seconds of one hour, or the hours of one key, whatever the skew.
    """
    order = F.col(tie_break or value)
    known = F.col(value).isNotNull()
    second, hour = (F.date_trunc(unit, F.col(time)) for unit in ("second", "hour"))
    places = df.groupBy(*keys, time).agg(
        F.max_by(value, F.when(known, order)).alias("_known"),
        F.bool_or(~known).alias("_wanted"),
    )
    places = places.withColumns({"_second": second, "_hour": hour})
    local = _carry(places, keys, ("_hour", "_second"), time, "_known")
    seconds = local.groupBy(*keys, "_hour", "_second").agg(
        F.max_by("_local", time).alias("_last"), F.bool_or("_wanted").alias("_any")
    )
    seconds = _carry(seconds, keys, ("_hour",), "_second", "_last")
    before_second = Window.partitionBy(*keys, "_hour").orderBy("_second")
    seconds = seconds.withColumn("_in_hour", F.lag("_local").over(before_second))
    hours = seconds.groupBy(*keys, "_hour").agg(
        F.max_by("_local", "_second").alias("_last"), F.bool_or("_any").alias("_any")
    )
    hours = _carry(hours, keys, (), "_hour", "_last").withColumn(
        "_before", F.lag("_local").over(Window.partitionBy(*keys).orderBy("_hour"))
    )
    carried = (
        seconds.where("_any")
        .alias("l")
        .join(hours.where("_any").alias("r"), _same("l", "r", (*keys, "_hour")), "left")
        .select(
            *(F.col(f"l.{c}") for c in (*keys, "_second")),
            F.coalesce("l._in_hour", "r._before").alias("_carry"),
        )
    )
    fills = (
        local.where("_wanted")
        .alias("l")
        .join(carried.alias("r"), _same("l", "r", (*keys, "_second")), "left")
        .select(
            *(F.col(f"l.{c}").alias(f"_{c}") for c in (*keys, time)),
            F.coalesce("l._local", "r._carry").alias("_fill"),
        )
    )

    same_place = F.col(time) == F.col(f"_{time}")
    for key in keys:
        same_place &= F.col(key).eqNullSafe(F.col(f"_{key}"))
    columns = [F.col("_fill").alias(value) if c == value else F.col(c) for c in df.columns]
    mended = df.where(~known).join(fills, same_place, "left").select(*columns)
    return df.where(known).unionByName(mended)


def impute_median(
    df: DataFrame, value: str = "price", accuracy: int | None = None
) -> DataFrame:
    """Give what is still null the median of the column, if anything is.

    ``accuracy`` asks for the approximate median instead of the exact one. Runs
    jobs: ``df`` is read to see whether nulls are left, and again for the median.
    """
    if df.where(F.col(value).isNull()).isEmpty():
        return df
    if accuracy is None:
        median = exact_quantile(df, value)
    else:
        median = approx_quantile(df, value, accuracy=accuracy)
    return df.withColumn(value, F.coalesce(F.col(value), median.scalar()))


def clamp_price(
    df: DataFrame, floor: float = PRICE_FLOOR, cap: float = PRICE_CAP, price: str = "price"
) -> DataFrame:
    """Negative prices to the floor, extreme ones to the cap."""
    return df.withColumn(price, clamp(F.col(price), floor, cap))


def clean_prices(
    df: DataFrame,
    floor: float = PRICE_FLOOR,
    cap: float = PRICE_CAP,
    keys: Sequence[str] = POINT,
    tie_break: str | None = None,
    median_accuracy: int | None = None,
) -> DataFrame:
    """Drop rows without a time, fill, impute, bound, drop what is still empty.

    Filling comes before bounding: a wild price can be filled forward and counts
    in the median, and only then is it bounded. The filled rows are checkpointed,
    so filling is done once. Runs jobs.
    """
    require_columns(df, "timestamp", "price", *keys)
    timed = coerce_price(df).dropna(subset=["timestamp"])
    filled = cut_lineage(forward_fill(timed, keys=keys, tie_break=tie_break))
    imputed = impute_median(filled, accuracy=median_accuracy)
    return clamp_price(imputed, floor, cap).dropna(subset=["timestamp", "price"])


def quality_report(before: DataFrame, after: DataFrame, cap: float = PRICE_CAP) -> DataFrame:
    """One row: rows, nulls and out-of-range prices before, rows and losses after."""
    price = F.col("price")
    kept = after.agg(F.count("*")).scalar()
    lost = F.col("rows_before") - F.col("rows_after")
    counted = before.agg(
        F.count("*").alias("rows_before"),
        F.count_if(F.col("timestamp").isNull()).alias("null_timestamps"),
        F.count_if(price.isNull()).alias("null_prices"),
        F.count_if(price < 0).alias("negative_prices"),
        F.count_if(price > cap).alias("extreme_prices"),
    )
    return counted.withColumn("rows_after", kept).withColumns(
        {"rows_lost": lost, "lost_pct": F.try_divide(lost * 100.0, F.col("rows_before"))}
    )


def features_fill(
    features: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = POINT,
    time: str = "target_time",
) -> DataFrame:
    """Fill feature columns from the next newer row of the key, then with 0.

    A key has one feature row per hour, which bounds the window.
    """
    newer = (
        Window.partitionBy(*keys)
        .orderBy(F.col(time).desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return features.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(newer), F.lit(0)) for c in columns}
    )


def features_finite(
    features: DataFrame, columns: Sequence[str], target: str = "target_price"
) -> DataFrame:
    """Rows whose every feature and target is a finite number."""
    keep = is_finite(F.col(target))
    for column in columns:
        keep &= is_finite(F.col(column))
    return features.where(keep)
