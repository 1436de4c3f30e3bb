"""Text to vectors, and checks of stored vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.workspace import cut_lineage

# Texts encoded at once and length of a vector.
BATCH = 32
DIMENSION = 384

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def _vectors(encoder: Encoder, texts: list[str]) -> pa.Array | None:
    """Vectors of one batch of texts, None if it fails."""
    try:
        vectors = encoder(texts)
        if len(vectors) != len(texts):
            raise ValueError("encoder returned another number of vectors")
        return pa.array([np.asarray(v, np.float64) for v in vectors], pa.list_(pa.float64()))
    except Exception:
        return None


def _encoded(make_encoder: Callable[[], Encoder], batch_size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()

        def encode(rows: pa.RecordBatch) -> pa.RecordBatch:
            found = _vectors(encoder, rows.column("_text").to_pylist())
            failed = pa.array([found is None] * len(rows))
            vectors = pa.nulls(len(rows), pa.list_(pa.float64())) if found is None else found
            return pa.RecordBatch.from_arrays([rows.column("_id"), vectors, failed], names)

        held: pa.RecordBatch | None = None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not len(rows):
                continue
            keys = rows.column("_key").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            # the last key may go on in the next batch
            for start, end in zip(starts, starts[1:]):
                for at in range(start, end, batch_size):
                    yield encode(rows.slice(at, min(batch_size, end - at)))
            last = starts[-1]
            while len(rows) - last > batch_size:
                yield encode(rows.slice(last, batch_size))
                last += batch_size
            held = rows.slice(last)
        if held is not None:
            yield encode(held)

    return run


def embed_documents(
    documents: DataFrame,
    make_encoder: Callable[[], Encoder],
    batch_size: int = BATCH,
    doc_id: str = "doc_id",
    text: str = "text",
    batch_by: Column | None = None,
) -> DataFrame:
    """Encode texts with a given model, in batches; a failing batch is marked, not fatal.

    ``make_encoder`` is called once per task, so a model is loaded where it runs.
    Texts go to it ``batch_size`` at a time. With ``batch_by``, a number, only texts of
    the same number go together, in the order of their ids: which texts a failing one
    takes along is then the same in every run. Without it batches follow the reading.
    """
    key = F.lit(0) if batch_by is None else batch_by
    rows = documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), F.coalesce(key.cast("long"), F.lit(-1)).alias("_key"))
    if batch_by is not None:
        # a number of partitions that is not joined up again: encoding is work, however short the texts
        n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartition(n, "_key").sortWithinPartitions("_key", "_id", "_text")
    id_type = documents.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(
        _encoded(make_encoder, batch_size, [doc_id, "embedding", "failed"]),
        f"`{doc_id}` {id_type}, embedding array<double>, failed boolean",
    )


def embedding_report(embedded: DataFrame) -> DataFrame:
    """How many documents were stored and how many failed."""
    return embedded.agg(
        F.count_if(~F.col("failed")).alias("stored"), F.count_if("failed").alias("failed")
    )


def term_counts(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", dimension: int = DIMENSION
) -> DataFrame:
    """``(doc_id, slot, n)``: how often the words of a slot occur in each document.

    Words are runs of letters and digits of any script, in lower case. A word's
    slot follows its MD5, so other engines find the same.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"))
    found = documents.select(F.col(doc_id).alias("doc_id"), F.explode(words).alias("word"))
    slot = F.conv(F.substring(F.md5(F.col("word").cast("binary")), 1, 8), 16, 10).cast("long") % dimension
    return found.groupBy("doc_id", slot.cast("int").alias("slot")).agg(F.count("*").alias("n"))


def slot_weights(counts: DataFrame, documents: int) -> DataFrame:
    """``(slot, weight)``: the rarer a slot among the documents, the heavier; a row per slot at most."""
    weight = F.log(F.lit(documents + 1.0) / (F.count("*") + 1.0))
    return counts.groupBy("slot").agg(weight.alias("weight"))


def fit_text_encoder(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", dimension: int = DIMENSION
) -> DataFrame:
    """Slot weights of a set of documents, to encode further texts by. Runs jobs."""
    return cut_lineage(slot_weights(term_counts(documents, doc_id, text, dimension), documents.count()))


def _dense(entries: str, dimension: int, value: Callable[[Column], Column]) -> Column:
    """Values of a map by slot as an array, 0 where a slot is missing.

    Each slot is laid next to the one before it, and the gap between them filled, in one
    pass. A lookup by slot would go through the map, or even build it anew, for each slot.
    """
    found = F.sort_array(F.map_entries(entries))

    def end(slot: int) -> Column:
        return F.array(F.struct(F.lit(slot).alias("key"), F.lit(0.0).alias("value")))

    runs = F.zip_with(
        F.concat(end(-1), found),
        F.concat(found, end(dimension)),
        lambda before, entry: F.concat(
            F.array_repeat(F.lit(0.0), entry["key"] - before["key"] - 1), F.array(value(entry["value"]))
        ),
    )
    return F.slice(F.flatten(runs), 1, dimension)


def encode_text(
    documents: DataFrame,
    weights: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    dimension: int = DIMENSION,
) -> DataFrame:
    """Documents with an ``embedding``: hashed word counts, weighted by rarity, of unit length.

    The built-in encoder. ``weights`` are those of ``fit_text_encoder``, by default
    the documents' own. A document without words has the zero vector. Ids are
    unique. Runs jobs: the counts are checkpointed, as weights and vectors need them.
    """
    counts = term_counts(documents, doc_id, text, dimension)
    if weights is None:
        counts = cut_lineage(counts)
        weights = slot_weights(counts, documents.count())
    # one row per slot, so the dimension bounds what is broadcast
    weighted = counts.join(F.broadcast(weights), "slot").withColumn("x", F.col("n") * F.col("weight"))
    entries = F.map_from_entries(F.collect_list(F.struct("slot", "x")))
    # as a struct a missing id equals another, so that grouping and join go by the same key, and vectors move once
    vectors = weighted.groupBy(F.struct(F.col("doc_id").alias("id")).alias("_doc")).agg(entries.alias("_x"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_norm"))
    at = _dense("_x", dimension, lambda x: F.coalesce(F.try_divide(x, F.col("_norm")), F.lit(0.0)))
    embedded = vectors.select("_doc", at.alias("embedding"))
    zero = F.array_repeat(F.lit(0.0), dimension)
    return (
        documents.join(embedded, F.struct(documents[doc_id].alias("id")) == embedded["_doc"], "left")
        .drop("_doc")
        .withColumn("embedding", F.coalesce("embedding", zero))
    )


def vector_audit(
    vectors: DataFrame,
    documents: DataFrame,
    dimension: int,
    doc_id: str = "doc_id",
    embedding: str = "embedding",
) -> DataFrame:
    """One row: counts, vector lengths, and documents without a vector."""
    length = F.size(embedding)
    missing = documents.join(vectors, doc_id, "left_anti").agg(F.count("*")).scalar()
    documents_count = documents.agg(F.count("*")).scalar()
    audit = vectors.agg(
        F.count("*").alias("vector_count"),
        F.countDistinct(doc_id).alias("unique_ids"),
        F.count_if(F.col(embedding).isNull()).alias("null_vectors"),
        F.count_if(length != dimension).alias("wrong_length"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
    )
    return audit.withColumns(
        {
            "document_count": documents_count,
            "missing_ids": missing,
        }
    ).withColumn(
        "consistent",
        (F.col("wrong_length") == 0)
        & (F.col("null_vectors") == 0)
        & (F.col("missing_ids") == 0)
        & (F.col("vector_count") == F.col("document_count")),
    )
