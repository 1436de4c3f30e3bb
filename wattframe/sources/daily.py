"""Summaries of a stored table by day, and reports from them.

``refresh`` compares the files of each date folder with those that were there when the
day was last summed up, and reads the days that have changed, no others. A day's summary
has its exact counts and ranges, a KLL sketch of the prices, an HLL sketch of the times
and a theta sketch of the points; next to it are its rows by point. Reports merge these
and do not read the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.operators.quantiles import exact_quantile, sketch
from wattframe.sources.tables import DATE_FOLDER
from wattframe.workspace import file_states

#: Binary logarithm of the size of the HLL and theta sketches.
LG_SIZE = 12
#: Relative error of their estimates, three standard deviations; small sets are exact.
ESTIMATE_ERROR = 0.05

_SUMMARY = (
    f"{DATE_FOLDER} date, files string, n_rows bigint, n_prices bigint, min_timestamp timestamp, max_timestamp timestamp, "
    "min_price double, max_price double, prices binary, times binary, points binary"
)
_COUNTS = f"{DATE_FOLDER} date, settlement_point string, n bigint"
_NO_DATE = "__HIVE_DEFAULT_PARTITION__"


def _states(spark: SparkSession, table: str) -> dict[str, str]:
    """For each date folder how many files it has, their bytes and the latest change."""
    found: dict[str, list[tuple[int, int]]] = {}
    for path, size, changed in file_states(spark, table):
        folders = [f for f in path.split("/") if f.startswith(f"{DATE_FOLDER}=")]
        name = path.rpartition("/")[2]
        if folders and not name.startswith(("_", ".")):
            found.setdefault(folders[-1].partition("=")[2], []).append((size, changed))
    return {day: f"{len(s)}/{sum(x for x, _ in s)}/{max(t for _, t in s)}" for day, s in found.items()}


def _stored(spark: SparkSession, store: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{store}/{name}")


def _known(spark: SparkSession, store: str) -> dict[str, str]:
    if not file_states(spark, f"{store}/days"):
        return {}
    rows = _stored(spark, store, "days", _SUMMARY).select(F.coalesce(F.col(DATE_FOLDER).cast("string"), F.lit(_NO_DATE)), "files")
    # one row for each day
    return dict(rows.collect())


def _on(days: Sequence[str]) -> Column:
    """Rows of these date folders; the filter picks folders, so other days are not opened."""
    dated = F.col(DATE_FOLDER).cast("date").isin([F.lit(d).cast("date") for d in days if d != _NO_DATE])
    return dated | F.col(DATE_FOLDER).isNull() if _NO_DATE in days else dated


def refresh(spark: SparkSession, table: str, store: str) -> list[str]:
    """Sum up the days whose files have changed, and say which they were. Runs jobs.

    Summaries of a day are replaced as a whole. A run that fails half-way leaves days
    to the next, since a day's files are noted with its summary, which is written last.
    """
    now, known = _states(spark, table), _known(spark, store)
    days = sorted(d for d, files in now.items() if known.get(d) != files)
    if not days:
        return []
    rows = spark.read.parquet(table).where(_on(days))
    files = F.create_map(*(F.lit(x) for d in days for x in (d, now[d])))

    def put(name: str, df: DataFrame) -> None:
        writer = df.repartition(DATE_FOLDER).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(DATE_FOLDER).parquet(f"{store}/{name}")

    put("points", rows.groupBy(DATE_FOLDER, "settlement_point").agg(F.count("*").alias("n")))
    put(
        "days",
        rows.groupBy(DATE_FOLDER)
        .agg(
            F.count("*").alias("n_rows"),
            F.count("price").alias("n_prices"),
            F.min("timestamp").alias("min_timestamp"),
            F.max("timestamp").alias("max_timestamp"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            sketch(F.col("price")).alias("prices"),
            F.hll_sketch_agg(F.unix_micros("timestamp"), F.lit(LG_SIZE)).alias("times"),
            F.theta_sketch_agg("settlement_point", F.lit(LG_SIZE)).alias("points"),
        )
        .withColumn("files", files[F.coalesce(F.col(DATE_FOLDER).cast("string"), F.lit(_NO_DATE))]),
    )
    return days


def ingest_stats(spark: SparkSession, store: str) -> DataFrame:
    """Ranges, rows and points of the whole table; distinct times are an estimate."""
    points = _stored(spark, store, "points", _COUNTS).agg(F.count_distinct("settlement_point")).scalar()
    return _stored(spark, store, "days", _SUMMARY).agg(
        F.sum("n_rows").alias("n_rows"),
        F.min("min_timestamp").alias("min_timestamp"),
        F.max("max_timestamp").alias("max_timestamp"),
        F.min("min_price").alias("min_price"),
        F.max("max_price").alias("max_price"),
        F.hll_sketch_estimate(F.hll_union_agg("times")).alias("unique_timestamps"),
    ).withColumn("unique_points", points)


def point_counts(spark: SparkSession, store: str) -> DataFrame:
    """Rows of each point."""
    return _stored(spark, store, "points", _COUNTS).groupBy("settlement_point").agg(F.sum("n").alias("n_rows"))


def top_point(spark: SparkSession, store: str) -> DataFrame:
    """The point with the most rows, the first by name of several."""
    return point_counts(spark, store).orderBy(F.desc("n_rows"), "settlement_point").limit(1)


def points_in_both(spark: SparkSession, store: str, one: tuple[str, str], other: tuple[str, str]) -> DataFrame:
    """How many points were seen in both spans of days, both ends included, as an estimate."""
    days = _stored(spark, store, "days", _SUMMARY)

    def seen(span: tuple[str, str]) -> Column:
        within = F.col(DATE_FOLDER).between(F.lit(span[0]).cast("date"), F.lit(span[1]).cast("date"))
        return F.theta_union_agg(F.when(within, F.col("points")), F.lit(LG_SIZE))

    spans = days.agg(seen(one).alias("one"), seen(other).alias("other"))
    return spans.select(F.theta_sketch_estimate(F.theta_intersection("one", "other")).alias("points_in_both"))


def price_quantile(spark: SparkSession, table: str, store: str, q: float = 0.5, exact: bool = True) -> DataFrame:
    """Quantile of all prices; the sketches of the days narrow the rows that are read for the exact one."""
    days = _stored(spark, store, "days", _SUMMARY)
    merged = F.kll_merge_agg_double("prices")
    if not exact:
        return days.agg(F.kll_sketch_get_quantile_double(merged, F.lit(q)).alias("quantile"))
    n, held = days.agg(F.sum("n_prices"), merged).first()
    return exact_quantile(spark.read.parquet(table), "price", q, sketched=(n, bytes(held)))
