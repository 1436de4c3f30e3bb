"""Timestamp parsing, zones and calendar features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattframe.functions.zones import local_to_utc

# Local zone of each market.
MARKET_ZONES = {"PJM": "America/New_York", "MISO": "America/Chicago"}

# Afternoon peak, first and last hour.
PEAK_HOURS = (14, 18)

# Layouts tried after the ISO form.
FEED_LAYOUTS = ("M/d/yyyy[ H[:mm[:ss]]]", "M/d/yyyy h:mm[:ss] a", "yyyyMMdd HH:mm[:ss]")

_ZONE_SUFFIX = r"(?i)\d\s*(?:z|utc|[+-]\d{2}:?\d{2})\s*$"


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def weekday_of(ts: Column) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(ts)


def weekend_flag(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def peak_flag(ts: Column) -> Column:
    return F.hour(ts).between(*PEAK_HOURS).cast("int")


def time_features(ts: Column) -> dict[str, Column]:
    """The four calendar features of a timestamp, by name."""
    return {
        "hour_of_day": hour_of(ts),
        "day_of_week": weekday_of(ts),
        "is_weekend": weekend_flag(ts),
        "is_peak_hour": peak_flag(ts),
    }


def parse_feed_time(text: Column, layouts: Sequence[str] = FEED_LAYOUTS) -> Column:
    """Lenient timestamp: ISO first, then the given layouts, else null."""
    text = F.trim(text.cast("string"))
    return F.coalesce(
        F.try_to_timestamp(text),
        *(F.try_to_timestamp(text, F.lit(layout)) for layout in layouts),
    )


def feed_time_to_utc(text: Column, zone: str | None, second_pass: Column | None = None) -> Column:
    """Feed time text to UTC.

    A value that carries its own zone is converted from that zone; a bare value
    is read as ``zone`` local time, or as UTC when ``zone`` is None. ``second_pass``
    marks bare values in the second pass of a repeated hour.
    """
    carries_zone = text.cast("string").rlike(_ZONE_SUFFIX)
    time = parse_feed_time(text)
    bare = F.to_utc_timestamp(time, "UTC") if zone is None else local_to_utc(time, zone, second_pass)
    return F.when(carries_zone, F.to_utc_timestamp(time, F.current_timezone())).otherwise(bare)


_OFFSET = r"(?:[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:[.]\d+)?)?)?)?"
_FRACTION = r"(?:[.,](\d{1,6})\d*)?"
# Parts of an ISO stamp, with separators and without.
_ISO_FORMS = (
    rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})T(\d{{2}})(?::(\d{{2}})(?::(\d{{2}}){_FRACTION})?)?{_OFFSET}$",
    rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(?:(\d{{2}})(?:(\d{{2}}){_FRACTION})?)?{_OFFSET}$",
)


def _iso_time(text: Column, form: str) -> Column:
    year, month, day, hour, minute, second, fraction = (F.regexp_extract(text, form, i) for i in range(1, 8))

    def clock(part: Column) -> Column:
        return F.when(part == "", "00").otherwise(part)

    stamp = F.concat(
        F.concat_ws("-", year, month, day), F.lit(" "), F.concat_ws(":", hour, clock(minute), clock(second)),
        F.lit("."), F.rpad(fraction, 6, "0"),
    )
    return F.when(text.rlike(form), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))


def parse_request_time(text: Column) -> Column:
    """Request stamp: ISO with ``T``, or a blank form.

    ISO stamps may be basic or extended, and stop at the hour or minute. ``Z`` and
    offsets are dropped, not converted: the clock time counts as it is written.
    """
    iso = F.replace(text, F.lit("Z"), F.lit(""))
    return F.when(
        F.contains(text, F.lit("T")), F.coalesce(*(_iso_time(iso, form) for form in _ISO_FORMS))
    ).otherwise(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def minute_id(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmm")


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def clock_on_day(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "HH:mm"), F.lit(" on "), day_name(ts))
