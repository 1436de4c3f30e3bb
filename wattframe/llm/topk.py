"""Exact top-k search by inner product, as products of tiles.

Queries are dealt into blocks and candidates into shards of bounded size; a task
multiplies one block with one shard and hands on the k best of each query. The
lists of a query's shards are then merged as a tree, a fixed number of shards at a
time, so that no task sees more than that many lists of a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.llm.scratch import columns_of

QUERY_ROWS = 4096
SHARD_ROWS = 8192
MERGE_SHARDS = 16
LEVELS_PER_UNIT = 256
#: Queries whose scores are held at once within a tile.
_STRIP = 512


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of whole numbers, floor(256 * x)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(LEVELS_PER_UNIT * flat.reshape(len(vectors), -1))


def best_of_tile(
    q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and scores of each query's k best; candidates are sorted by id."""
    reach = float(np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(1, q.shape[1]))
    if reach >= 2.0**62:
        raise ValueError("an inner product would not fit into a long")
    exact = reach < 2.0**53  # then sums of doubles are exact
    if not exact:
        q, c = q.astype(np.int64), c.astype(np.int64)
    n = len(c_ids)
    ties = np.arange(n, dtype=np.int64)
    out = []
    for at in range(0, len(q_ids), _STRIP):
        ids = q_ids[at : at + _STRIP]
        scores = (q[at : at + _STRIP] @ c.T).astype(np.int64)
        own = ids[:, None] == c_ids[None, :]
        if reach * n < 2.0**62:  # the order of ties fits below the score
            keys = scores * n - ties
            keys[own] = np.iinfo(np.int64).min
            best = np.argpartition(keys, n - k, axis=1)[:, n - k :] if n > k else np.tile(ties, (len(ids), 1))
        else:
            masked = np.where(own, np.iinfo(np.int64).min, scores)
            # the complement turns the order round and cannot overflow, as the negative would
            best = np.argsort(~masked, axis=1, kind="stable")[:, : min(n, k)]
        rows = np.repeat(np.arange(len(ids)), best.shape[1])
        best = best.ravel()
        other = ~own[rows, best]
        rows, best = rows[other], best[other]
        out.append((ids[rows], c_ids[best], scores[rows, best]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _tile(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("shard", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        shard = table["shard"][0].as_py() if len(table) else 0
        found = []
        sizes = np.asarray(table["size"])
        wanted = np.asarray(table["is_query"])
        for size in np.unique(sizes[wanted]):
            q, c = (table.filter(pa.array((wanted == w) & (sizes == size))).combine_chunks() for w in (True, False))
            if len(q) and len(c):
                found.append(
                    best_of_tile(
                        np.asarray(q["id"]), _matrix(q["vector"].combine_chunks()),
                        np.asarray(c["id"]), _matrix(c["vector"].combine_chunks()), k,
                    )
                )
        if not found:
            return schema.empty_table()
        a, b, score = (np.concatenate(x) for x in zip(*found))
        return pa.table([a, b, score, np.full(len(a), shard)], schema=schema)

    return run


def _ranked(df: DataFrame, k: int, *by: str | Column) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_topk(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    query_rows: int = QUERY_ROWS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k candidates of highest score of every query.

    Components become floor(256 * x); the score is their integer inner product, ties
    go to the smaller id. Candidates are all rows with another id than the query's.
    A row takes no part if its id or vector is null, or its vector holds a null or
    non-finite component; vectors are compared with those of their own length.
    Repeated rows are candidates each; of a query id given more than once, the best
    over its rows. An empty table gives an empty one.
    """
    finite = F.forall(
        F.col("vector"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("double"))
    )
    rows = (
        columns_of(vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False))), id_column, vector_column, "is_query")
        .select(
            F.col(id_column).cast("long").alias("id"),
            F.col(vector_column).cast("array<double>").alias("vector"),
            "is_query",
        )
        .where(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite)
        .withColumn("size", F.size("vector"))
    )
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    shards = max(1, -(-n // shard_rows))
    blocks = max(1, -(-n_queries // query_rows))
    # a query goes to every shard and a candidate to every block: each pair of them is a tile
    tiles = (
        rows.withColumn("is_query", F.lit(False))
        .withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
        .unionByName(
            rows.where("is_query")
            .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>")))
        )
    )
    best = tiles.groupBy("block", "shard").applyInArrow(_tile(k), "query_id long, vec_id long, score long, shard long")
    while shards > MERGE_SHARDS:
        shards = -(-shards // MERGE_SHARDS)
        best = best.withColumn("shard", F.floor(F.col("shard") / MERGE_SHARDS))
        best = _ranked(best, k, "query_id", "shard").drop("rank")
    return _ranked(best, k, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
