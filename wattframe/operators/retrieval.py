"""Cosine top-k, hit texts, context and prompts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from wattframe.functions.arrays import dot
from wattframe.functions.numbers import fixed
from wattframe.functions.text import EMPTY_ANSWER, after_last_mark, clean_answer, fill, strip
from wattframe.operators.documents import ANALYSIS, OBSERVATION
from wattframe.workspace import cut_lineage

# Documents per question, and how many of them make the context.
TOP_K = 5
CONTEXT_DOCS = 3
SIMILARITY_DIGITS = 3

# Wording of hits and prompts, and defaults for missing metadata.
OBSERVATION_HIT = (
    "Market observation at {point} on {time}. Price: ${price}/MWh ({level}) during {period}."
)
ANALYSIS_HIT = (
    "Market analysis for {time}. Target price: ${target}/MWh with {trend} trend "
    "and {volatility} volatility."
)
OTHER_HIT = "Document {doc_id}: {type} data"
HIT_DEFAULTS = {
    "type": "unknown",
    "timestamp": "unknown time",
    "price": 0.0,
    "settlement_point": "unknown location",
    "price_level": "unknown level",
    "time_period": "unknown period",
    "target_price": 0.0,
    "trend_direction": "stable",
    "volatility_level": "moderate",
}

# Queries and documents of one tile, and shards whose hits are merged at once.
_QUERY_ROWS = 1024
_SHARD_ROWS = 65_536
_MERGE_SHARDS = 64
# Queries scored at once in a tile.
_SCORE_ROWS = 128
# Similarities closer than this many digits count as equal and are ordered by id.
_TIE_DIGITS = 12


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores, equal ones by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _matrix(vectors: pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Vectors of one length as rows."""
    vectors = vectors.combine_chunks()
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if (lengths != dimension).any():
        raise ValueError(f"document vectors do not all have {dimension} numbers like the queries")
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(values).all():
        raise ValueError("document vectors hold nulls or numbers that are not finite")
    return values.reshape(len(vectors), dimension)


def _score_tile(k: int, schema: pa.Schema):
    """The k best documents of a shard for each query of a block."""

    def score(tile: pa.Table) -> pa.Table:
        queries = tile.filter(pc.is_valid(tile["query_id"]))
        documents = tile.filter(pc.is_valid(tile["doc_id"]))
        if not queries.num_rows or not documents.num_rows:
            return schema.empty_table()
        dimension = len(queries["embedding"][0])
        units = _unit_rows(_matrix(queries["embedding"], dimension))
        matrix = _unit_rows(_matrix(documents["embedding"], dimension))
        ids = documents["doc_id"].to_numpy()
        places, found, scores = [], [], []
        for start in range(0, len(units), _SCORE_ROWS):
            block = np.round(matrix @ units[start : start + _SCORE_ROWS].T, _TIE_DIGITS)
            for i in range(block.shape[1]):
                best_ids, best = _best(ids, block[:, i], k)
                places += [start + i] * len(best)
                found.append(best_ids)
                scores.append(best)
        columns = [
            queries["query_id"].take(pa.array(places)),
            pa.array(np.concatenate(found)),
            pa.array(np.concatenate(scores)),
            pa.array([tile["shard"][0].as_py()] * len(places)),
        ]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return score


def _ranked(hits: DataFrame, k: int, *by: str) -> DataFrame:
    best = Window.partitionBy(*by).orderBy(F.col("similarity").desc(), F.col("doc_id"))
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def cosine_topk(
    documents: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    query_rows: int = _QUERY_ROWS,
    shard_rows: int = _SHARD_ROWS,
) -> DataFrame:
    """The k most similar documents of each query, exactly; equal ones by document id.

    Takes ``(doc_id, embedding)`` and ``(query_id, embedding)``. A zero vector is
    similar to nothing (0); rows without an id or vector take no part. Queries are
    dealt into blocks and documents into shards; a task scores one block against
    one shard and hands on the k best of each query, which are merged shard by
    shard. Runs a job that counts both sides.
    """
    present = F.col("embedding").isNotNull()
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    documents = documents.where(present & F.col("doc_id").isNotNull()).select("doc_id", vector)
    queries = queries.where(present & F.col("query_id").isNotNull()).select("query_id", vector)
    shards = max(1, -(-documents.count() // shard_rows))
    blocks = max(1, -(-queries.count() // query_rows))

    def place(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # A query goes to every shard and a document to every block of queries.
    tiles = (
        documents.select("*", place("doc_id", shards).alias("shard"), every(blocks).alias("block"))
        .unionByName(
            queries.select("*", place("query_id", blocks).alias("block"), every(shards).alias("shard")),
            allowMissingColumns=True,
        )
    )
    schema = StructType(
        [
            StructField("query_id", queries.schema["query_id"].dataType),
            StructField("doc_id", documents.schema["doc_id"].dataType),
            StructField("similarity", DoubleType()),
            StructField("shard", IntegerType()),
        ]
    )
    hits = tiles.groupBy("block", "shard").applyInArrow(_score_tile(k, to_arrow_schema(schema)), schema)
    while shards > _MERGE_SHARDS:
        shards = -(-shards // _MERGE_SHARDS)
        hits = hits.withColumn("shard", F.floor(F.col("shard") / _MERGE_SHARDS).cast("int"))
        hits = _ranked(hits, k, "query_id", "shard").drop("rank")
    return _ranked(hits.drop("shard"), k, "query_id")


def cosine_topk_lsh(
    documents: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    groups: int = 24,
    width: int = 3,
    bucket_length: float = 0.4,
    seed: int = 42,
) -> DataFrame:
    """Approximate top-k: a query is scored against the documents that share a bucket with it.

    A bucket is named by ``width`` projections together; a vector has one bucket
    in each of ``groups`` groups. Queries and documents meet by a join on the
    bucket, which adaptive execution can split, and pairs are scored by column
    expressions. A query has up to k hits, fewer if its buckets hold fewer.
    """

    def unit(df: DataFrame, name: str) -> DataFrame:
        vector = array_to_vector(F.col("embedding").cast("array<double>"))
        normal = Normalizer(inputCol="_vector", outputCol="_unit", p=2.0)
        rows = df.where(F.col("embedding").isNotNull() & F.col(name).isNotNull())
        return normal.transform(rows.select(name, vector.alias("_vector"))).drop("_vector")

    model = BucketedRandomProjectionLSH(
        inputCol="_unit",
        outputCol="_hashes",
        numHashTables=groups * width,
        bucketLength=bucket_length,
        seed=seed,
    ).fit(unit(documents, "doc_id"))

    def in_buckets(units: DataFrame, name: str) -> DataFrame:
        def bucket(group: int) -> Column:
            places = range(group * width, (group + 1) * width)
            return F.xxhash64(F.lit(group), *(vector_to_array(F.col("_hashes")[i])[0].cast("int") for i in places))

        return model.transform(units).select(
            name, F.explode(F.array(*(bucket(g) for g in range(groups)))).alias("bucket")
        )

    asked, held = unit(queries, "query_id"), unit(documents, "doc_id")
    pairs = in_buckets(asked, "query_id").join(in_buckets(held, "doc_id"), "bucket").drop("bucket").distinct()
    scored = (
        pairs.join(asked.withColumn("a", vector_to_array("_unit")).drop("_unit"), "query_id")
        .join(held.withColumn("b", vector_to_array("_unit")).drop("_unit"), "doc_id")
        .select("query_id", "doc_id", F.round(dot(F.col("a"), F.col("b")), _TIE_DIGITS).alias("similarity"))
    )
    # A query with very many candidates is ranked in parts first.
    parts = scored.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_MERGE_SHARDS)))
    return _ranked(_ranked(parts, k, "query_id", "part").drop("rank", "part"), k, "query_id")


def attach_metadata(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Hits with their documents' metadata, all hits kept.

    Runs a job: the hits are checkpointed, which spares later steps from scoring
    again and lets the join be planned by their real size.
    """
    hits = cut_lineage(hits)
    found = metadata.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    return hits.join(found, "doc_id", "left")


def render_hits(hits: DataFrame) -> DataFrame:
    """Text of each hit from its metadata columns, with defaults for missing ones."""
    present = set(hits.columns)

    def meta(name: str) -> Column:
        default = F.lit(HIT_DEFAULTS[name])
        return F.coalesce(F.col(name), default) if name in present else default

    kind = meta("type")
    observation = fill(
        OBSERVATION_HIT,
        point=meta("settlement_point"),
        time=meta("timestamp"),
        price=fixed(meta("price"), 2),
        level=meta("price_level"),
        period=meta("time_period"),
    )
    volatility = meta("volatility_level")
    analysis = fill(
        ANALYSIS_HIT,
        time=meta("timestamp"),
        target=fixed(meta("target_price"), 2),
        trend=meta("trend_direction"),
        volatility=volatility,
    )
    other = fill(OTHER_HIT, doc_id=F.col("doc_id").cast("string"), type=kind)
    text = F.when(kind == OBSERVATION, observation).when(kind == ANALYSIS, analysis)
    return hits.withColumns({"type": kind, "doc_text": text.otherwise(other)})


def response_context(hits: DataFrame, shown: int = CONTEXT_DOCS) -> DataFrame:
    """Per query the number of hits and the first ones with rounded similarity."""
    entry = F.struct(
        "rank",
        F.col("doc_id"),
        F.bround("similarity", SIMILARITY_DIGITS).alias("similarity"),
        "type",
    )
    top = F.collect_list(F.when(F.col("rank") <= shown, entry))
    return hits.groupBy("query_id").agg(
        F.count("*").alias("retrieved_documents"), F.array_sort(top).alias("context_used")
    )


def build_prompt(
    questions: DataFrame, hits: DataFrame, question: str = "question", shown: int = CONTEXT_DOCS
) -> DataFrame:
    """Prompt per question: the first hit texts as context, when there are any."""
    first = F.collect_list(F.when(F.col("rank") <= shown, F.struct("rank", "doc_text")))
    contexts = hits.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(first), lambda h: h["doc_text"]), " ").alias("_text")
    )
    ask = F.concat(F.lit("Q: "), F.col(question), F.lit("\nA:"))
    with_context = F.concat(F.lit("Context: "), F.col("_text"), F.lit("\n\n"), ask)
    usable = F.coalesce(strip(F.col("_text")) != "", F.lit(False))
    return (
        questions.join(contexts, "query_id", "left")
        .withColumn("prompt", F.when(usable, with_context).otherwise(ask))
        .drop("_text")
    )


def clean_answers(responses: DataFrame, text: str = "text", prompt: str | None = None) -> DataFrame:
    """Generated responses cut to the answer and tidied.

    The answer is what follows the last mark. Where there is none, a leading
    ``prompt`` is cut off. An answer of which nothing is left becomes a fixed reply.
    """
    cut = after_last_mark(F.col(text), prompt=None if prompt is None else F.col(prompt))
    answer = clean_answer(cut)
    return responses.withColumn("answer", F.when(answer == "", EMPTY_ANSWER).otherwise(answer))
