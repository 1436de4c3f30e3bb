"""From raw documents to packed sequences, in five stages.

Each stage works on all rows that the one before it kept and is written as Parquet
before the next one begins. Toxic documents and copies go, secrets are masked, and
what is left is packed.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.llm import toxicity
from wattframe.llm.exact_dedup import exact_dedup
from wattframe.llm.packing import pack
from wattframe.llm.scratch import Scratch
from wattframe.llm.secrets import mask_secrets
from wattframe.llm.simhash import simhash_dedup


def _numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc, row, doc_id, text)``: each row as a struct, with a number of its own.

    The numbers are written with the rows. Given anew at a reading they would follow
    the splits of the files, which depend on the cores there are at that moment.
    """
    numbered = scratch.keep(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row")))
    return numbered.select("doc", "row", "doc.doc_id", "doc.text")


def _only(numbered: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows that are kept; their numbers grow with the documents, so they are never broadcast."""
    return numbered.join(kept.hint("merge"), "row", "left_semi").select("doc.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold, empty ones among them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.learnable_id())
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    numbered = _numbered(docs, Scratch(spark, "copies"))
    marked = exact_dedup(numbered.withColumn("key", F.struct("doc_id", "row")), id_column="key")
    return _only(numbered, marked.where("kept").select(F.col("key.row").alias("row")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id; rows without one come last."""
    scratch = Scratch(spark, "near-copies")
    numbered = _numbered(docs, scratch)
    marked = simhash_dedup(numbered, id_column="row", shingle_words=3, max_bits=3)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")
    first = marked.join(numbered.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(order).alias("first"))
    return _only(numbered, scratch.keep(first.select("first.row")))


def mask_found_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked; ``n_chars`` follows the text."""
    masked = mask_secrets(docs)
    changed = F.col("n_secrets") > 0
    values = {
        "text": F.when(changed, F.col("text")).otherwise(F.col("doc.text")),
        "n_chars": F.when(changed, F.length("text").cast("long")).otherwise(F.col("doc.n_chars")),
    }
    return masked.select(*[values.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("secret_scan", mask_found_secrets),
    ("packing", pack_documents),
]

#: Token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for _, stage in STAGES[:-1]:
        out = scratch.keep(stage(spark, docs, sf_dir))
        if written is not None:
            scratch.drop(written)
        docs = written = out
    return STAGES[-1][1](spark, docs, sf_dir)
