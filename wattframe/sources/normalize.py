"""One schema for all markets: name resolution, UTC times, defaults."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions.numbers import coerce_double
from wattframe.functions.times import MARKET_ZONES, feed_time_to_utc
from wattframe.operators.cleaning import clean_prices
from wattframe.workspace import cut_lineage

COMMON_COLUMNS = (
    "timestamp",
    "repeat_hour_flag",
    "settlement_point",
    "price",
    "iso",
    "location_type",
    "location_id",
)


@dataclass(frozen=True)
class FeedNames:
    """Column names a market may use, in order of preference, in lower case.

    ``*_parts`` are looked for inside names when no preferred name is there.
    """

    iso: str
    time: tuple[str, ...]
    price: tuple[str, ...]
    point: tuple[str, ...]
    kind: tuple[str, ...]
    date: tuple[str, ...] = ()
    interval: tuple[str, ...] = ()
    repeat: tuple[str, ...] = ("repeat_hour_flag", "repeathourflag", "repeated_hour", "dst_flag")
    time_parts: tuple[str, ...] = ("time", "date")
    price_parts: tuple[str, ...] = ("lmp",)
    point_parts: tuple[str, ...] = ("location", "node")


# Names seen in the two markets' feeds, and their price cap.
PJM = FeedNames(
    iso="PJM",
    time=(
        "datetime_beginning_ept",
        "datetime_beginning_utc",
        "datetime_beginning",
        "timestamp",
        "intervalstartutc",
        "interval_start_utc",
    ),
    price=("lmp", "total_lmp", "totallmp", "rt_lmp", "price"),
    point=("pnode_id", "pnode", "location", "pnodeid"),
    kind=("type", "locationtype", "location_type"),
)
MISO = FeedNames(
    iso="MISO",
    time=("timestamp", "intervalstart", "interval_start", "localtime", "interval_start_local"),
    date=("marketdate", "mkt_dt", "date"),
    interval=("marketinterval", "mkt_interval", "interval", "time", "hourending", "he"),
    price=("lmp", "totallmp", "total_lmp", "price"),
    point=("pnode", "node", "location", "settlementpoint"),
    kind=("locationtype", "pricetype", "type"),
)
FEED_PRICE_CAP = 5000.0
DEFAULT_KIND = "PNODE"


def find_column(
    columns: Sequence[str], names: Sequence[str], parts: Sequence[str] = ()
) -> str | None:
    """Actual column for the first preferred name, else the first that contains a part."""
    by_lower = {c.lower(): c for c in columns}
    for name in names:
        if name in by_lower:
            return by_lower[name]
    return next((c for c in columns if any(p in c.lower() for p in parts)), None)


def _time_text(columns: Sequence[str], names: FeedNames) -> tuple[Column, bool]:
    """Time text of a feed and whether its column already speaks of UTC."""
    whole = find_column(columns, names.time)
    if whole is None:
        day, interval = (find_column(columns, n) for n in (names.date, names.interval))
        if day and interval:
            text = F.concat_ws(" ", F.col(day).cast("string"), F.col(interval).cast("string"))
            return text, False
        whole = find_column(columns, (), names.time_parts)
    if whole is None:
        raise ValueError(f"no time column among {list(columns)}")
    return F.col(whole), "utc" in whole.lower()


def conform(raw: DataFrame, names: FeedNames) -> DataFrame:
    """Raw feed rows in the common schema, times in UTC, prices not yet cleaned."""
    columns = raw.columns
    time_text, already_utc = _time_text(columns, names)
    price = find_column(columns, names.price, names.price_parts)
    if price is None:
        raise ValueError(f"no price column among {list(columns)}")
    point = find_column(columns, names.point, names.point_parts)
    kind = find_column(columns, names.kind)

    def text_or(column: str | None, default: str) -> Column:
        if column is None:
            return F.lit(default)
        return F.coalesce(F.col(column).cast("string"), F.lit(default))

    zone = None if already_utc else MARKET_ZONES[names.iso]
    repeat = find_column(columns, names.repeat)
    # without a flag a time in a repeated hour is taken for its first pass
    second_pass = None if repeat is None else F.coalesce(F.col(repeat).try_cast("boolean"), F.lit(False))
    return raw.select(
        feed_time_to_utc(time_text, zone, second_pass).alias("timestamp"),
        (F.lit(False) if second_pass is None else second_pass).alias("repeat_hour_flag"),
        text_or(point, f"{names.iso}_UNKNOWN").alias("settlement_point"),
        coerce_double(F.col(price)).alias("price"),
        F.lit(names.iso).alias("iso"),
        text_or(kind, DEFAULT_KIND).alias("location_type"),
        text_or(point, f"{names.iso}_UNKNOWN").alias("location_id"),
    )


def cleaned(rows: DataFrame) -> DataFrame:
    """Rows in the common schema with prices filled and bounded."""
    return clean_prices(rows, cap=FEED_PRICE_CAP).select(*COMMON_COLUMNS)


def normalize(raw: DataFrame, names: FeedNames, landed: str | None = None) -> DataFrame:
    """Raw feed rows in the common schema with prices filled and bounded.

    Cleaning reads its rows several times, and feed text is slow to parse, so it is
    parsed once. With ``landed`` the parsed rows are written there, as the feed's
    landed table, and cleaned from it. Else they are checkpointed. Runs jobs.
    """
    rows = conform(raw, names)
    if landed is None:
        rows = cut_lineage(rows)
    else:
        rows.write.mode("overwrite").parquet(landed)
        rows = raw.sparkSession.read.schema(rows.schema).parquet(landed)
    return cleaned(rows)


def normalize_pjm(raw: DataFrame, landed: str | None = None) -> DataFrame:
    return normalize(raw, PJM, landed)


def normalize_miso(raw: DataFrame, landed: str | None = None) -> DataFrame:
    return normalize(raw, MISO, landed)


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """Normalised feeds in one table, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
