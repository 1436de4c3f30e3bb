"""Vector stores: JSON maps and Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORE_SCHEMA = (
    "vectors map<string, array<double>>, "
    "metadata map<string, map<string, string>>, "
    "info map<string, string>"
)


def vectors_from_map(stores: DataFrame, text_col: str = "value") -> DataFrame:
    """Store texts ``{"vectors": {id: [...]}, "metadata": {id: {...}}}`` to one row per id."""
    store = stores.select(
        F.monotonically_increasing_id().alias("store"), F.from_json(F.col(text_col), STORE_SCHEMA).alias("s")
    )

    def entries(field: str, embedding: bool) -> Column:
        pairs = F.coalesce(F.map_entries(f"s.{field}"), F.array())
        return F.transform(
            pairs,
            lambda e: F.struct(
                e["key"].alias("doc_id"),
                F.lit(embedding).alias("is_vector"),
                (e["value"] if embedding else F.lit(None)).cast("array<double>").alias("embedding"),
                (F.lit(None) if embedding else e["value"]).cast("map<string,string>").alias("metadata"),
            ),
        )

    # Each map is gone through once, and an id's two entries meet by (store, id).
    both = F.concat(entries("vectors", True), entries("metadata", False))
    paired = (
        store.select("store", F.explode(both).alias("e"))
        .groupBy("store", "e.doc_id")
        .agg(
            F.get(F.collect_list("e.embedding"), F.lit(0)).alias("embedding"),
            F.get(F.collect_list("e.metadata"), F.lit(0)).alias("metadata"),
            F.bool_or("e.is_vector").alias("has_vector"),
        )
    )
    return paired.where("has_vector").select("doc_id", "embedding", "metadata")


def read_vector_map(spark: SparkSession, path: str) -> DataFrame:
    """Vector stores in JSON files, one store per file."""
    return vectors_from_map(spark.read.text(path, wholetext=True))


def sink_vectors(vectors: DataFrame, path: str, model: str) -> DataFrame:
    """Write the vectors and a one-row description next to them; return the description.

    The vectors go to ``<path>/vectors`` and the description to ``<path>/info``.
    """
    spark = vectors.sparkSession
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    info = stored.agg(
        F.count("*").alias("vector_count"),
        F.max(F.size("embedding")).alias("dimension"),
    ).select(
        "vector_count",
        "dimension",
        F.lit("cosine").alias("metric"),
        F.lit(model).alias("embedding_model"),
    )
    info.write.mode("overwrite").json(f"{path}/info")
    return spark.read.schema(info.schema).json(f"{path}/info")
