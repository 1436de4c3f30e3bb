import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_rows import pairs
from oracle import connect, differences
from test_llm_dedup import brute_components, brute_fingerprint
from test_llm_text import assert_packed, brute_pieces
from wattframe.llm import toxicity
from wattframe.llm.queries import QUERIES, SQL


def test_each_operator_has_one_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, small, name):
    rows = QUERIES[name](spark, small).toPandas()
    assert differences(rows, connect(small).execute(SQL[name]).df()) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_has_a_row_per_document_or_piece(spark, small, name):
    table = "pages" if name.startswith("op8") else "documents"
    n = spark.read.parquet(f"{small}/{table}.parquet").count()
    rows = QUERIES[name](spark, small).count()
    assert rows >= n if name.startswith("op9") else rows == n


def test_pipeline_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.learnable_id())
    clean = toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select("doc.doc_id", "doc.text")
    last = {}
    for i, t in pairs(clean):
        last[t or ""] = max(i, last.get(t or "", i))
    kept = [(i, t) for t, i in last.items()]
    roots = brute_components([i for i, _ in kept], [brute_fingerprint(t) for _, t in kept])
    kept = {i for (i, _), c in zip(kept, roots) if i == c}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in rows} == kept
    assert assert_packed(rows) == -(-sum(r.length for r in rows) // 2048)
    # masked texts differ; all others are packed as they are
    texts = {i: t for i, t in pairs(docs) if i in kept}
    whole = {i: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i) for i in kept}
    same = [i for i in kept if whole[i] == sorted(p[1:] for p in brute_pieces([(i, texts[i])]))]
    assert len(same) >= 0.9 * len(kept)


def test_stages_on_odd_rows(spark, odd_docs, empty_docs, small, tmp_path):
    for name, table in (("odd", odd_docs), ("empty", empty_docs)):
        docs = table.withColumn("lang", F.lit(None).cast("string"))
        for stage, run in corpus_pipeline.STAGES:
            path = str(tmp_path / name / stage)
            run(spark, docs, small).write.parquet(path)
            out = spark.read.parquet(path)
            if stage != "packing":
                assert out.columns == docs.columns
            docs = out
        if name == "empty":
            assert docs.count() == 0
        else:
            # of the copies of one text the greatest id, of the empty texts one
            assert {5, 6, 7, 8} <= {r.doc_id for r in docs.collect()}


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies])
def test_rows_keep_their_numbers_when_files_are_split_anew(spark, tmp_path, stage):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 60)) for _ in range(120)]
    rows = [(i, texts[i % 120]) for i in range(160)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8, "doc_id").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "8000")
        out = stage(spark, docs, "")
        spark.conf.set(name, before)
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        got = sorted(r.text for r in out.collect())
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert got == sorted(texts)
