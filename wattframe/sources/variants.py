"""Payloads as semi-structured values: one parse, members found by paths, changes reported.

A payload is parsed once into a variant. Its records are the first of the named members
that is a list with entries, or the payload itself if it is one. Columns are read from a
record by the first of several paths that leads to a value of the column's type, so a
member may be renamed or moved into another between responses without a new schema.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.sources.feeds import ENVELOPE_KEYS

#: A column's type and the paths it may be found at, the likeliest first.
Members = Mapping[str, tuple[str, tuple[str, ...]]]

_LIST = "array<variant>"


def _records(payload: Column, keys: Sequence[str]) -> Column:
    """The list of records, null if there is none."""
    lists = [F.try_variant_get(payload, path, _LIST) for path in (*(f"$.{k}" for k in keys), "$")]
    filled = [F.when(F.size(found) > 0, found) for found in lists]
    return F.coalesce(*filled, *lists)


def read_records(payloads: DataFrame, text_col: str = "value", keys: Sequence[str] = ENVELOPE_KEYS) -> DataFrame:
    """The payloads' other columns with ``record``, one row for each record.

    A payload that is no JSON, or holds no list, gives one row whose ``record`` is null
    and whose ``unreadable`` is true; a blank one or an empty list gives none.
    """
    others = [c for c in payloads.columns if c != text_col]
    text = F.col(text_col)
    parsed = payloads.where(F.coalesce(F.trim(text) != "", F.lit(False))).select(*others, F.try_parse_json(text).alias("_payload"))
    listed = parsed.select(*others, _records(F.col("_payload"), keys).alias("_records"))
    none = F.array(F.lit(None).cast("variant"))
    return listed.select(
        *others,
        F.col("_records").isNull().alias("unreadable"),
        F.explode(F.coalesce("_records", none)).alias("record"),
    )


def typed(records: DataFrame, members: Members) -> DataFrame:
    """Readable records with their members as columns; a value that has not the type is null."""

    def column(name: str, kind: str, paths: Sequence[str]) -> Column:
        return F.coalesce(*(F.try_variant_get("record", path, kind) for path in paths)).alias(name)

    others = [c for c in records.columns if c not in ("record", "unreadable")]
    return records.where(~F.col("unreadable")).select(*others, *(column(n, kind, paths) for n, (kind, paths) in members.items()))


def member_report(records: DataFrame, members: Members) -> DataFrame:
    """``(member, n_records, known)``: the members that records have at their top, and whether a column reads them.

    Members that no column reads, and columns whose members no record has any more,
    show that a feed has changed.
    """
    spark = records.sparkSession
    known = sorted({path.removeprefix("$.").partition(".")[0] for _, paths in members.values() for path in paths})
    pairs = records.where(~F.col("unreadable")).select("record").lateralJoin(spark.tvf.variant_explode(F.col("record").outer()))
    there = pairs.groupBy(F.col("key").alias("member")).agg(F.count("*").alias("n_records"))
    wanted = spark.range(1, numPartitions=1).select(F.explode(F.array(*map(F.lit, known))).alias("member"), F.lit(True).alias("known"))
    both = there.join(F.broadcast(wanted), "member", "full")
    return both.select("member", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("known", F.lit(False)).alias("known"))


def record_schema(records: DataFrame) -> DataFrame:
    """One row: the schema that fits all readable records, as text."""
    return records.where(~F.col("unreadable")).agg(F.schema_of_variant_agg("record").alias("record_schema"))
