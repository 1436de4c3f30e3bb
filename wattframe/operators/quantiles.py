"""Exact quantiles found through sketches.

A KLL sketch of the column, merged from sketches of the partitions, gives two values
that the wanted rank lies between for all but a small chance. Counting the rows below,
at and between them shows whether it does; if not, the range is widened. What lies
between, about one row in two hundred, is sketched in turn if it is still much, and
ordered if it is little, so no task orders more than a bounded number of rows, and
neither a value that many rows share nor very many values make a difference.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a sketch. Ranks are then off by less than the error, a share of the rows, 99 times of 100.
SKETCH_SIZE = 2048
RANK_ERROR = 0.0025
#: Rows that one task may put in order.
_FEW = 1_000_000


def sketch(value: Column) -> Column:
    """Aggregate: the sketch of the values that are not null."""
    return F.kll_sketch_agg_double(value.cast("double"), F.lit(SKETCH_SIZE))


def _between(rows: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Rows within an open range; the bounds reach the scan as filters."""
    if low is None:
        return rows
    return rows.where((F.col("_v") > low) & (F.col("_v") < high))


def _ordered(rows: DataFrame, ranks: list[int]) -> list[float]:
    """Values at the ranks among few rows. Runs a job."""
    counts = rows.groupBy("_v").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_v"))
    reached = counts.select("_v", upto.alias("_upto"))
    return list(reached.agg(*(F.min(F.when(F.col("_upto") > r, F.col("_v"))) for r in ranks)).first())


def _bounds(rows: DataFrame, held: bytes, low: float, high: float) -> tuple[float, float]:
    """Values at two shares of the rows by a sketch; the least and the greatest at 0 and 1."""
    shares = F.array(F.lit(max(low, 0.0)), F.lit(min(high, 1.0)))
    at = F.kll_sketch_get_quantile_double(F.lit(bytearray(held)), shares)
    return tuple(rows.sparkSession.range(1, numPartitions=1).select(at.alias("at")).first()["at"])


def _values(rows: DataFrame, n: int, held: bytes, ranks: list[int]) -> list[float]:
    """Values at two neighbouring ranks of ``n`` rows with their sketch. Runs jobs."""
    found: dict[int, float] = {}
    wanted, below, inside, error = sorted(set(ranks)), 0, n, RANK_ERROR
    low = high = None
    while wanted:
        part = _between(rows, low, high)
        if inside <= _FEW:
            found |= zip(wanted, _ordered(part, [r - below for r in wanted]))
            break
        if held is None:
            held = part.agg(sketch(F.col("_v"))).first()[0]
        first, last = ((r - below) / inside for r in (wanted[0], wanted[-1]))
        a, b = _bounds(rows, held, first - error, last + error)
        v = F.col("_v")
        parts = part.agg(*map(F.count_if, (v < a, v == a, (v > a) & (v < b), (v == b) & (v > a)))).first()
        ends = [below + sum(parts[: i + 1]) for i in range(4)]
        if wanted[0] < ends[0] or wanted[-1] >= ends[3]:
            # with the least and the greatest as bounds only a sketch of other rows misses
            held, error = (held, error * 8) if error < 1 else (None, error)
            continue
        found |= {r: a if r < ends[1] else b for r in wanted if r < ends[1] or r >= ends[2]}
        wanted = [r for r in wanted if r not in found]
        below, inside, low, high, held, error = ends[1], parts[2], a, b, None, RANK_ERROR
    return [found[r] for r in ranks]


def exact_quantile(
    df: DataFrame,
    value: str,
    q: float = 0.5,
    alias: str = "quantile",
    sketched: tuple[int, bytes] | None = None,
) -> DataFrame:
    """One row with the interpolated quantile of a column; null values are left out.

    Values are finite. Runs jobs: one for the number of rows and the sketch, which is
    spared where ``sketched`` gives them, one to order few rows, and for many rows one
    more for each time that they are narrowed, to a two-hundredth.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    n, held = sketched or rows.agg(F.count("*"), sketch(F.col("_v"))).first()
    found = None
    if n:
        place = (n - 1) * q
        low, high = _values(rows, n, held, [math.floor(place), min(math.floor(place) + 1, n - 1)])
        part = place - math.floor(place)
        found = low + (high - low) * part if part else low
    return df.sparkSession.range(1, numPartitions=1).select(F.lit(found).cast("double").alias(alias))


def approx_quantile(
    df: DataFrame, value: str, q: float = 0.5, accuracy: int = 10000, alias: str = "quantile"
) -> DataFrame:
    """One row with an approximate quantile, for callers that can do with one pass."""
    return df.agg(F.percentile_approx(value, q, accuracy).alias(alias))
