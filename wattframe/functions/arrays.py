"""Arrays of prices and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_sequence(text: Column, fallback: Column, length: int = 24) -> Column:
    """JSON list of numbers to an array; unreadable text gives the fallback repeated."""
    parsed = F.from_json(text, "array<double>")
    usable = parsed.isNotNull() & ~F.exists(parsed, lambda x: x.isNull())
    return F.when(usable, parsed).otherwise(F.array_repeat(fallback.cast("double"), length))


def sequence_json(sequence: Column) -> Column:
    return F.to_json(sequence)


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
