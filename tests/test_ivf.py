import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.operators import ivf
from wattframe.operators.retrieval import cosine_topk


def vectors(spark, n, dim=16, groups=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    data = centres[rng.integers(0, groups, n)] + 0.4 * rng.normal(size=(n, dim))
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(n, [0.0] * dim), (n + 1, None), (None, [1.0] * dim)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<double>")


def asked(documents, every):
    return documents.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("query_id"), "embedding")


def pairs(hits):
    return {(r.query_id, r.doc_id) for r in hits.collect()}


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    documents = vectors(spark, 4000)
    path = str(tmp_path_factory.mktemp("ivf") / "i")
    ivf.build_index(documents, path)
    return documents, path


def test_every_vector_is_in_the_index_once(spark, indexed):
    documents, path = indexed
    stored = spark.read.parquet(f"{path}/vectors")
    held = documents.where("doc_id IS NOT NULL AND embedding IS NOT NULL")
    assert stored.count() == held.count() and stored.select("doc_id", "embedding").exceptAll(held).isEmpty()
    assert stored.select("cell").distinct().count() > 30


def test_recall_and_scores(spark, indexed):
    documents, path = indexed
    queries = asked(documents, 40)
    exact = cosine_topk(documents, queries, 5)
    near = ivf.cosine_topk_ivf(spark, path, queries, 5)
    want = pairs(exact)
    assert len(want & pairs(near)) >= 0.9 * len(want)
    both = exact.join(near.select("query_id", "doc_id", F.col("similarity").alias("s")), ["query_id", "doc_id"])
    assert both.where(F.abs(F.col("similarity") - F.col("s")) > 1e-9).isEmpty()
    assert near.groupBy("query_id").count().where("count <> 5").isEmpty()


def test_exact_search_and_all_cells(spark, indexed):
    documents, path = indexed
    queries = asked(documents, 200)
    want = sorted(map(tuple, cosine_topk(documents, queries, 3).collect()))
    assert sorted(map(tuple, ivf.cosine_topk_ivf(spark, path, queries, 3, exact=True).collect())) == want
    assert pairs(ivf.cosine_topk_ivf(spark, path, queries, 3, probe_share=1.0)) == {w[:2] for w in want}


def test_only_folders_of_near_cells_are_read(spark, indexed):
    documents, path = indexed
    one = documents.where("doc_id = 7").select(F.col("doc_id").alias("query_id"), "embedding")
    hits = ivf.cosine_topk_ivf(spark, path, one, 5, probe_share=0.05)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("PartitionFilters: [isnotnull(cell", "PartitionFilters: [cell")
    assert hits.where("rank = 1").first().doc_id == 7


def test_a_crowded_cell_is_scored_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ivf, "PART_ROWS", 50)
    same = spark.range(600).select(F.col("id").alias("doc_id"), F.array(F.lit(1.0), F.lit(0.5), F.col("id") / 1e6).alias("embedding"))
    other = spark.createDataFrame([(1000, [-1.0, 0.0, 0.0]), (1001, [0.0, -1.0, 0.0])], "doc_id long, embedding array<double>")
    path = str(tmp_path / "i")
    ivf.build_index(same.unionByName(other), path, cells=3)
    assert spark.read.parquet(f"{path}/vectors").select("cell", "part").distinct().count() >= 12
    queries = asked(same, 150)
    # such near copies differ by less than the codes tell, so other ones of them may be found
    near = {(r.query_id, r["rank"]): r.similarity for r in ivf.cosine_topk_ivf(spark, path, queries, 4, probe_share=1.0).collect()}
    want = {(r.query_id, r["rank"]): r.similarity for r in cosine_topk(same.unionByName(other), queries, 4).collect()}
    assert near.keys() == want.keys() and all(abs(near[k] - want[k]) < 1e-6 for k in want)


def test_nothing_to_index_or_to_ask(spark, indexed, tmp_path):
    documents, path = indexed
    with pytest.raises(ValueError, match="no vectors"):
        ivf.build_index(documents.where("false"), str(tmp_path / "i"))
    assert ivf.cosine_topk_ivf(spark, path, asked(documents, 40).where("false"), 5).count() == 0
