"""Offsets of time zones as intervals of local time, and the two passes of a repeated hour.

Where clocks go back, an hour of local time comes twice; a feed's flag tells the second
pass. Where they go forward, an hour is missing; a time in it counts by the offset that
held before, so it lies an hour later on the clock. The intervals are found from the
zone's own rules and looked up by the local year.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Local years with a table of their own; other years are left to the engine, first pass.
YEARS = (1970, 2100)

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
INTERVAL_SCHEMA = "zone string, year int, second_pass boolean, begins long, ends long, offset_seconds long"


def _seconds(year: int) -> int:
    return int((datetime(year, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())


@cache
def transitions(zone: str, years: tuple[int, int] = YEARS) -> tuple[tuple[int, int, int], ...]:
    """``(UTC second, offset before, offset after)`` of each change of a zone's offset.

    A change between two days is narrowed to its second; two changes in one day would
    count as one, which no rule of a market's zone makes.
    """
    rules = ZoneInfo(zone)

    def offset(second: int) -> int:
        return int((_EPOCH + timedelta(seconds=second)).astimezone(rules).utcoffset().total_seconds())

    found = []
    day = 24 * 3600
    for at in range(_seconds(years[0]) - 2 * day, _seconds(years[1] + 1) + 2 * day, day):
        before, after = offset(at), offset(at + day)
        if before == after:
            continue
        low, high = at, at + day
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if offset(middle) == before else (low, middle)
        found.append((high, before, after))
    return tuple(found)


@cache
def intervals(zone: str, years: tuple[int, int] = YEARS) -> tuple[tuple[int, bool, int, int, int], ...]:
    """``(year, second pass, begins, ends, offset)``: intervals of local seconds, without gaps in a year."""
    changes = transitions(zone, years)
    first = changes[0][1] if changes else int(ZoneInfo(zone).utcoffset(datetime(years[0], 1, 1)).total_seconds())
    rows = []
    for second_pass in (False, True):
        # in the second pass of a repeated hour the offset after the change holds already
        begins = [at + (after if second_pass else max(before, after)) for at, before, after in changes]
        offsets = [first, *(after for _, _, after in changes)]
        bounds = [-(1 << 62), *begins, 1 << 62]
        for year in range(years[0], years[1] + 1):
            start, end = _seconds(year), _seconds(year + 1)
            for low, high, offset in zip(bounds, bounds[1:], offsets):
                if low < end and high > start:
                    rows.append((year, second_pass, max(low, start), min(high, end), offset))
    return tuple(rows)


def zone_table(spark: SparkSession, *zones: str) -> DataFrame:
    """The intervals of some zones as a table of two to four rows for each zone, year and pass."""
    return spark.createDataFrame([(zone, *row) for zone in zones for row in intervals(zone)], INTERVAL_SCHEMA)


def _offset(ts: Column, zone: str, second_pass: bool) -> Column:
    """Offset in seconds of a local time, null outside the years of the table."""
    by_year: dict[int, list[Column]] = {}
    for year, of_second, begins, _, offset in intervals(zone):
        if of_second == second_pass:
            by_year.setdefault(year, []).append(F.struct(F.lit(begins).cast("long").alias("begins"), F.lit(offset).cast("long").alias("offset")))
    years = F.array(*(F.array(*rows) for _, rows in sorted(by_year.items())))
    own = F.get(years, F.year(ts) - YEARS[0])
    reached = F.filter(own, lambda i: i["begins"] <= F.unix_seconds(ts))
    return F.try_element_at(reached, F.lit(-1))["offset"]


def local_to_utc(ts: Column, zone: str, second_pass: Column | None = None) -> Column:
    """Zone-less local time to zone-less UTC, row by row.

    ``second_pass`` marks times in the second pass of a repeated hour; null and no
    mark are the first. Elsewhere the mark makes no difference.
    """

    def moved(t: Column) -> Column:
        offset = _offset(t, zone, False)
        if second_pass is not None:
            offset = F.when(second_pass, _offset(t, zone, True)).otherwise(offset)
        return F.coalesce(F.timestamp_micros(F.unix_micros(t) - offset * 1_000_000), F.to_utc_timestamp(t, zone))

    # bound to a variable, a time that has to be parsed is parsed once and not at each mention
    return F.get(F.transform(F.array(ts), moved), F.lit(0))


def with_utc(rows: DataFrame, time: str, zone: str, zones: tuple[str, ...], second_pass: str | None = None, into: str = "utc") -> DataFrame:
    """Rows of several zones with their time in UTC, by a join with the intervals.

    ``zone`` is a column that holds one of ``zones``; the table of these is small and
    known beforehand, so it is broadcast. Other zones, null times and years beyond the
    table get a null.
    """
    table = zone_table(rows.sparkSession, *zones).alias("z")
    local = F.unix_seconds(F.col(f"r.{time}"))
    flag = F.lit(False) if second_pass is None else F.coalesce(F.col(f"r.{second_pass}"), F.lit(False))
    within = (
        (F.col(f"r.{zone}") == F.col("z.zone"))
        & (F.year(f"r.{time}") == F.col("z.year"))
        & (flag == F.col("z.second_pass"))
        & (local >= F.col("z.begins"))
        & (local < F.col("z.ends"))
    )
    moved = F.timestamp_micros(F.unix_micros(F.col(f"r.{time}")) - F.col("z.offset_seconds") * 1_000_000)
    return rows.alias("r").join(F.broadcast(table), within, "left").select("r.*", moved.alias(into))
