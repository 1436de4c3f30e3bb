"""A stored inverted-file index for cosine search.

Vectors are assigned to the nearest of some centroids, which are fitted on a bounded
sample, and stored in a folder for each cell: a code of one byte a number for the
difference from the centroid, and the vector itself. A search ranks the centroids for
each query, reads the codes in the folders of the nearest cells only, and scores the best
candidates exactly with their vectors. Cells are dealt into parts of bounded size, so
that a cell that many vectors fall into is scored by many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wattframe.functions.arrays import dot
from wattframe.operators.retrieval import TOP_K, _best, _matrix, _ranked, _TIE_DIGITS, _unit_rows, cosine_topk
from wattframe.workspace import remove, shared_folder

#: Vectors that the centroids are fitted on, about, and rounds of fitting.
SAMPLE_ROWS = 20_000
ROUNDS = 12
#: Vectors of a cell that one task scores.
PART_ROWS = 100_000
#: Most cells, so that the centroids, which every task holds, stay small.
MOST_CELLS = 4096
#: Share of the cells that a search looks into, and candidates scored exactly for each hit asked for.
PROBE_SHARE = 0.2
CANDIDATES = 8


def fit_centroids(units: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Directions that unit vectors gather around; a cell without vectors keeps its own."""
    rng = np.random.default_rng(seed)
    centroids = units[rng.choice(len(units), min(cells, len(units)), replace=False)]
    for _ in range(rounds):
        own = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, units)
        some = np.linalg.norm(sums, axis=1) > 0
        centroids = np.where(some[:, None], _unit_rows(sums), centroids)
    return centroids


def _coded(shared, dimension: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            if not len(batch):
                continue
            units = _unit_rows(_matrix(pa.chunked_array([batch.column("embedding")]), dimension))
            cell = (units @ centroids.T).argmax(axis=1)
            rest = units - centroids[cell]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-30) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(cell.astype(np.int32)),
                    pa.array([c.tobytes() for c in codes], pa.binary()),
                    pa.array(scale),
                    batch.column("embedding"),
                ],
                ["doc_id", "cell", "code", "scale", "embedding"],
            )

    return run


def build_index(documents: DataFrame, path: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> None:
    """Write the index of ``(doc_id, embedding)``; every vector is in it. Runs jobs.

    Rows without an id or vector take no part. Centroids are fitted on about
    ``sample_rows`` vectors chosen by a hash of the id; there are about as many as the
    square root of the number of vectors, unless ``cells`` says so.
    """
    spark = documents.sparkSession
    rows = documents.where(F.col("embedding").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("embedding").cast("array<double>").alias("embedding")
    )
    n, dimension = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        raise ValueError("there are no vectors to index")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(min(1.0, sample_rows / n) * 2.0**32)
    sample = rows.where(share).select("embedding").toArrow()
    if not sample.num_rows:
        sample = rows.select("embedding").limit(1).toArrow()
    wanted = cells or min(MOST_CELLS, max(1, math.isqrt(n)))
    centroids = fit_centroids(_unit_rows(_matrix(sample["embedding"], dimension)), wanted)
    shared = spark.sparkContext.broadcast(centroids)
    coded = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("cell", T.IntegerType()),
            T.StructField("code", T.BinaryType()),
            T.StructField("scale", T.DoubleType()),
            rows.schema["embedding"],
        ]
    )
    scratch = shared_folder(spark, "ivf-assigned")
    rows.mapInArrow(_coded(shared, dimension), coded).write.parquet(scratch)
    assigned = spark.read.schema(coded).parquet(scratch)
    # one row for each cell
    sizes = dict(assigned.groupBy("cell").count().collect())
    parts = {c: max(1, math.ceil(m / PART_ROWS)) for c, m in sizes.items()}
    of_cell = spark.createDataFrame(sorted(parts.items()), "cell int, parts int")
    part = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    dealt = assigned.join(F.broadcast(of_cell), "cell").withColumn("part", part).drop("parts")
    dealt.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    listed = [(i, parts.get(i, 0), c.tolist()) for i, c in enumerate(centroids)]
    cells_table = spark.createDataFrame(listed, "cell int, parts int, centroid array<double>")
    cells_table.coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
    remove(spark, scratch)


def _probed(shared, probes: int):
    """Each query once for every part of its nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, parts = shared.value
        for batch in batches:
            if not len(batch):
                continue
            units = _unit_rows(_matrix(pa.chunked_array([batch.column("embedding")]), centroids.shape[1]))
            near = units @ centroids.T
            near[:, parts == 0] = -np.inf
            chosen = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            rows = [(i, int(c), p) for i in range(len(units)) for c in chosen[i] for p in range(parts[c])]
            at, cell, part = (list(x) for x in zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(pa.array(at, pa.int64())), pa.array(cell, pa.int32()), pa.array(part, pa.int32()),
                 batch.column("embedding").take(pa.array(at, pa.int64()))],
                ["query_id", "cell", "part", "embedding"],
            )

    return run


def _score_codes(shared, keep: int, schema: pa.Schema):
    def score(tile: pa.Table) -> pa.Table:
        queries = tile.filter(pc.is_valid(tile["query_id"]))
        held = tile.filter(pc.is_valid(tile["doc_id"]))
        if not queries.num_rows or not held.num_rows:
            return schema.empty_table()
        centroids = shared.value[0]
        cell = tile["cell"][0].as_py()
        units = _unit_rows(_matrix(queries["embedding"], centroids.shape[1]))
        codes = np.frombuffer(b"".join(held["code"].to_pylist()), np.int8).reshape(held.num_rows, -1).astype(np.float32)
        scale, ids = held["scale"].to_numpy(), held["doc_id"].to_numpy()
        found = []
        for unit in units:
            near = unit @ centroids[cell] + scale * (codes @ unit.astype(np.float32))
            found.append(_best(ids, near, keep))
        lengths = [len(best) for best, _ in found]
        columns = [
            queries["query_id"].take(pa.array(np.repeat(np.arange(len(units)), lengths))),
            pa.array(np.concatenate([best for best, _ in found])),
            pa.array(np.concatenate([near for _, near in found]).astype(float)),
            pa.array([cell] * sum(lengths)),
        ]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

    return score


def cosine_topk_ivf(
    spark: SparkSession,
    path: str,
    queries: DataFrame,
    k: int = TOP_K,
    probe_share: float = PROBE_SHARE,
    exact: bool = False,
) -> DataFrame:
    """The k most similar indexed documents of each query, among those of its nearest cells.

    Folders of cells that no query comes near are not read, and of the candidates only
    are vectors compared. ``exact`` searches all vectors instead. Runs small jobs that
    read the centroids and the cells of the queries.
    """
    queries = queries.where(F.col("embedding").isNotNull() & F.col("query_id").isNotNull()).select(
        "query_id", F.col("embedding").cast("array<double>").alias("embedding")
    )
    stored = spark.read.parquet(f"{path}/vectors")
    if exact:
        return cosine_topk(stored.select("doc_id", "embedding"), queries, k)
    table = spark.read.parquet(f"{path}/cells").orderBy("cell").toArrow()
    centroids = np.array(table["centroid"].to_pylist())
    parts = table["parts"].to_numpy()
    shared = spark.sparkContext.broadcast((centroids, parts))
    probes = max(1, math.ceil(probe_share * len(centroids)))
    place = [T.StructField("cell", T.IntegerType()), T.StructField("part", T.IntegerType())]
    asked = queries.mapInArrow(_probed(shared, probes), T.StructType([queries.schema["query_id"], *place, queries.schema["embedding"]]))
    # cells are few, and named so that the scan opens their folders alone
    cells = [r["cell"] for r in asked.select("cell").distinct().collect()]
    within = stored.where(F.col("cell").isin(cells))
    tiles = within.select("doc_id", "cell", "part", "code", "scale").unionByName(asked, allowMissingColumns=True)
    schema = T.StructType(
        [
            queries.schema["query_id"],
            stored.schema["doc_id"],
            T.StructField("near", T.DoubleType()),
            T.StructField("cell", T.IntegerType()),
        ]
    )
    keep = CANDIDATES * k
    coarse = tiles.groupBy("cell", "part").applyInArrow(_score_codes(shared, keep, to_arrow_schema(schema)), schema)
    chosen = _ranked(coarse.withColumnRenamed("near", "similarity"), keep, "query_id").select("query_id", "doc_id", "cell")
    unit = {"v": F.col("embedding"), "length": F.sqrt(dot(F.col("embedding"), F.col("embedding")))}

    def units(df: DataFrame, name: str) -> DataFrame:
        scaled = F.transform("v", lambda x: F.when(F.col("length") > 0, x / F.col("length")).otherwise(0.0))
        return df.withColumns(unit).withColumn(name, scaled).drop("v", "length", "embedding")

    vectors = units(within.select("doc_id", "cell", "embedding").join(chosen.select("doc_id", "cell").distinct(), ["doc_id", "cell"]), "b")
    scored = chosen.join(vectors, ["doc_id", "cell"]).join(units(queries, "a"), "query_id")
    similarity = F.round(dot(F.col("a"), F.col("b")), _TIE_DIGITS)
    return _ranked(scored.select("query_id", "doc_id", similarity.alias("similarity")), k, "query_id")
