"""Readers for landed market feeds: positional JSON, enveloped JSON, CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the members that may hold the records, in order.
ENVELOPE_KEYS = ("items", "data", "Items")

POSITIONAL_FIELDS = ("timestamp", "repeat_hour_flag", "settlement_point", "price")


_BAD = "payload is no readable JSON: "
_SHOWN = 80


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text) == "", F.lit(True))


def _top(text: Column) -> Column:
    """Members of a payload's top level, their values as JSON texts; null when unreadable."""
    return F.from_json(text, "map<string,string>")


def _is_list(text: Column) -> Column:
    return F.startswith(F.ltrim(text), F.lit("["))


def _records_text(text: Column, keys: Sequence[str]) -> Column:
    """JSON text of the list of records: the first member that is there and not empty, or a bare list."""
    members = F.transform(F.array(*map(F.lit, keys)), lambda k: F.try_element_at(F.col("_top"), k))
    filled = F.filter(members, lambda m: m.isNotNull() & ~m.rlike(r"^\s*(\[\s*\]|null)?\s*$"))
    return F.when(_is_list(text), text).otherwise(F.get(filled, F.lit(0)))


def _parsed(payloads: DataFrame, text_col: str, keys: Sequence[str], element: str) -> DataFrame:
    """``_records`` of each payload, and ``_bad`` where it cannot be read. Blank texts hold no records."""
    text = F.col(text_col)
    return (
        payloads.withColumn("_top", F.when(~_is_list(text), _top(text)))
        .withColumn("_text", _records_text(text, keys))
        .withColumn("_records", F.from_json("_text", f"array<{element}>"))
        .withColumn(
            "_bad",
            ~_blank(text)
            & ((~_is_list(text) & F.col("_top").isNull()) | (F.col("_text").isNotNull() & F.col("_records").isNull())),
        )
    )


def bad_payloads(payloads: DataFrame, text_col: str = "value", keys: Sequence[str] = ENVELOPE_KEYS) -> DataFrame:
    """The payloads that the readers cannot read, to be reported."""
    parsed = _parsed(payloads, text_col, keys, "string")
    return parsed.where("_bad").select(*payloads.columns)


def _exploded(parsed: DataFrame, text_col: str, skip_bad: bool) -> DataFrame:
    if skip_bad:
        records = F.when(~F.col("_bad"), F.col("_records"))
    else:
        message = F.concat(F.lit(_BAD), F.substring(text_col, 1, _SHOWN))
        records = F.when(F.col("_bad"), F.raise_error(message).cast(parsed.schema["_records"].dataType)).otherwise(
            F.col("_records")
        )
    return parsed.select(F.explode(records).alias("record"))


def parse_positional(payloads: DataFrame, text_col: str = "value", skip_bad: bool = False) -> DataFrame:
    """Texts holding ``{"data": [[time, flag, point, price], ...]}`` to typed rows.

    An unreadable price becomes null; an unreadable time fails the query. So does
    an unreadable payload, unless ``skip_bad`` leaves these to ``bad_payloads``.
    """
    rows = _exploded(_parsed(payloads, text_col, ("data",), "array<string>"), text_col, skip_bad)
    at = {name: F.col("record")[i] for i, name in enumerate(POSITIONAL_FIELDS)}
    price = at["price"].try_cast("double")
    return rows.select(
        F.to_timestamp(at["timestamp"]).alias("timestamp"),
        at["repeat_hour_flag"].cast("boolean").alias("repeat_hour_flag"),
        at["settlement_point"].alias("settlement_point"),
        F.when(~F.isnan(price), price).alias("price"),
    )


def unwrap_envelope(
    payloads: DataFrame,
    record_schema: T.StructType | str,
    text_col: str = "value",
    keys: Sequence[str] = ENVELOPE_KEYS,
    skip_bad: bool = False,
) -> DataFrame:
    """Payload texts to one row per record, typed by ``record_schema``.

    The first member of ``keys`` that is there and not empty holds the records; a
    bare list counts as the records themselves. An unreadable payload fails the
    query, unless ``skip_bad`` leaves these to ``bad_payloads``.
    """
    return (
        _exploded(_parsed(payloads, text_col, keys, "string"), text_col, skip_bad)
        .select(F.from_json("record", record_schema).alias("record"))
        .select("record.*")
    )


def require_rows(df: DataFrame, what: str = "feed") -> DataFrame:
    """Fail on an empty payload. Runs a one-row job."""
    if df.isEmpty():
        raise ValueError(f"{what} was read but holds no rows")
    return df


def read_feed(
    spark: SparkSession,
    path: str,
    record_schema: T.StructType | str,
    format: str = "json",
    keys: Sequence[str] = ENVELOPE_KEYS,
    check_empty: bool = True,
) -> DataFrame:
    """Landed responses of one market.

    ``json`` files hold one response each; ``csv`` files have a header row.
    """
    if format == "json":
        payloads = spark.read.text(path, wholetext=True)
        df = unwrap_envelope(payloads, record_schema, keys=keys)
    elif format == "csv":
        df = spark.read.csv(path, schema=record_schema, header=True, enforceSchema=False)
    elif format == "positional":
        df = parse_positional(spark.read.text(path, wholetext=True))
    else:
        raise ValueError(f"unknown feed format {format!r}")
    return require_rows(df, path) if check_empty else df
