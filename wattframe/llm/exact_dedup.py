"""Exact de-duplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. The distinct blocks are
sorted and each gets an integer name; then adjacent names are paired, the distinct
pairs are named in the same way, and so on until one name is left of each text.
Equal texts have equal names and different texts different ones: names are given
to contents, not to hashes, so that nothing can collide.

Only the first level moves text, once. Blocks find their names through two 64-bit
hashes, which is sound since it is verified that no two distinct blocks share
both; if they do, other seeds are taken. Blocks, pairs and groups that hold a
large share of all rows are combined before each shuffle, and the joins that bring
names back are plain equi-joins that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.scratch import Scratch, columns_of, whole_text

BLOCK_BYTES = 4096


def _block_count(block_bytes: int):
    return F.greatest(F.lit(1), F.ceil(F.octet_length("text") / block_bytes)).cast("int")


def _blocks(block_bytes: int):
    """The text's blocks as binaries; an empty text has one empty block."""
    return F.transform(
        F.sequence(F.lit(0), _block_count(block_bytes) - 1),
        lambda i: F.substring(F.col("text").cast("binary"), i * block_bytes + 1, F.lit(block_bytes)),
    )


def _hashes(block, seed: int):
    return F.struct(
        F.xxhash64(F.lit(2 * seed), block).alias("a"), F.xxhash64(F.lit(2 * seed + 1), block).alias("b")
    )


def _named(distinct: DataFrame, *by: str) -> DataFrame:
    """Rows numbered in sorted order; the partition is the upper part of a name."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _name_blocks(texts: DataFrame, scratch: Scratch, block_bytes: int) -> tuple[DataFrame, int]:
    """Names of all distinct blocks by their two hashes, and the seed of the hashes."""
    seed = 0
    while True:
        distinct = texts.select(F.explode(_blocks(block_bytes)).alias("block")).distinct()
        names = scratch.keep(
            _named(distinct, "block").select(_hashes(F.col("block"), seed).alias("h"), "name").select("h.*", "name")
        )
        if names.groupBy("a", "b").count().where("count > 1").isEmpty():
            return names, seed
        scratch.drop(names)
        seed += 1


def _regrouped(parts: DataFrame) -> DataFrame:
    """The names of each row, in order of position."""
    return (
        parts.groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("parts"))
        .select("row", F.col("parts.name").alias("names"))
    )


def _finished(current: DataFrame, level: int) -> DataFrame:
    return current.where(F.size("names") == 1).select(
        "row", F.lit(level).alias("level"), F.col("names")[0].alias("name")
    )


def _pairs(current: DataFrame) -> DataFrame:
    """Adjacent names of unfinished rows; a last single one is paired with -1."""
    pair = F.transform(
        F.sequence(F.lit(0), F.size("names") - 1, F.lit(2)),
        lambda i: F.struct(F.get("names", i).alias("a"), F.coalesce(F.get("names", i + 1), F.lit(-1)).alias("b")),
    )
    return (
        current.where(F.size("names") > 1)
        .select("row", F.posexplode(pair))
        .select("row", "pos", "col.a", "col.b")
    )


def _name_rows(rows: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """``(row, level, name)``: the identity of each row's text."""
    blocks = rows.select("row", F.posexplode("hashes")).select("row", "pos", "col.a", "col.b")
    current = scratch.keep(_regrouped(blocks.join(names, ["a", "b"])))
    found = _finished(current, 0)
    longest = rows.agg(F.max(F.size("hashes"))).first()[0] or 0
    level = 0
    while longest > 1:
        level, longest = level + 1, -(-longest // 2)
        pairs = _pairs(current)
        names = scratch.keep(_named(pairs.select("a", "b").distinct(), "a", "b"))
        current = scratch.keep(_regrouped(pairs.join(names, ["a", "b"])))
        scratch.drop(names)
        found = found.unionByName(_finished(current, level))
    return found


def exact_dedup(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per input row: its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the row with the largest id stays; a null id is smaller than any
    other, and of rows equal in text and id exactly one stays. Null texts count as
    empty, and all empty texts are equal. An empty table gives an empty one. Other
    columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    texts = columns_of(docs, id_column, text_column).select(
        F.col(id_column).alias("id"), whole_text(text_column).alias("text")
    )
    names, seed = _name_blocks(texts, scratch, block_bytes)
    rows = scratch.keep(
        texts.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            F.transform(_blocks(block_bytes), lambda block: _hashes(block, seed)).alias("hashes"),
        )
    )
    named = scratch.keep(
        _name_rows(rows, names, scratch)
        .join(rows.select("row", "id", "text_sha256"), "row")
        .select("row", "id", "text_sha256", "level", "name")
    )
    scratch.drop(rows, names)
    groups = scratch.keep(
        named.groupBy("level", "name").agg(
            F.max(F.struct("id", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size")
        )
    )
    return named.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_column),
        F.col("keep.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
    )
