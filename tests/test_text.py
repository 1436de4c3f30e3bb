import hashlib
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.functions.numbers import fixed
from wattframe.functions.text import after_last_mark, clean_answer
from wattframe.operators import documents, embedding, intervals, qa, retrieval
from wattframe.plans.flows import questions_to_prompts


def test_fixed_rounds_like_printf(spark):
    rng = random.Random(0)
    numbers = [0.125, 0.375, 2.675, 35.125, 35.135, -1.005, 0.0, 1234567.891, -0.001]
    numbers += [rng.randrange(-10**6, 10**6) / 2000 for _ in range(3000)]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for row in df.select("x", fixed(F.col("x"), 2).alias("t")).collect():
        assert row.t == f"{row.x:.2f}"


def test_observation_document(prices):
    row = documents.docs_observation(prices([("2025-07-31 15:30:00", 45.5, "HB_NORTH")])).first()
    assert row.doc_id == "market_HB_NORTH_20250731_1530"
    assert row.text == (
        "Power market observation at HB_NORTH on Thursday 2025-07-31 15:30. Electricity price is "
        "$45.50/MWh indicating high price during afternoon peak. This represents real-time "
        "locational marginal pricing from ERCOT Texas grid operations."
    )
    assert (row.price_level, row.time_period, row.hour, row.day_of_week) == ("high price", "afternoon peak", 15, 3)


@pytest.mark.parametrize(
    "price, hour, level, period",
    [(19.99, 5, "low price", "off-peak hours"), (20.0, 6, "moderate price", "morning ramp-up"),
     (40.0, 9, "high price", "morning ramp-up"), (60.0, 13, "very high price", "off-peak hours"),
     (59.9, 22, "high price", "evening demand"), (1.0, 23, "low price", "off-peak hours")],
)
def test_document_bands(prices, price, hour, level, period):
    row = documents.docs_observation(prices([(f"2025-07-31 {hour:02d}:00:00", price)])).first()
    assert (row.price_level, row.time_period) == (level, period)


def feature_row(spark, **changes):
    row = {
        "settlement_point": "HB", "window_id": 3, "target_time": datetime(2025, 8, 2, 15, 0),
        "target_price": 41.0, "price_mean": 35.25, "price_std": 6.0, "trend_slope": 0.2,
        "price_volatility": 0.17, "hour_of_day": 15, "is_weekend": 1, "is_peak_hour": 1,
        "momentum_1h": -1.5, "price_sequence": [30.0, 42.5],
    } | changes
    schema = (
        "settlement_point string, window_id int, target_time timestamp, target_price double, "
        "price_mean double, price_std double, trend_slope double, price_volatility double, "
        "hour_of_day int, is_weekend int, is_peak_hour int, momentum_1h double, "
        "price_sequence array<double>"
    )
    return spark.createDataFrame([tuple(row.values())], schema)


def test_analysis_document(spark):
    row = documents.docs_analysis(feature_row(spark)).first()
    assert row.doc_id == "analysis_3_20250802_1500"
    assert row.text == (
        "Power market analysis for 2025-08-02 15:00 showing increasing price trend with moderate "
        "volatility. The 24-hour average price was $35.25/MWh with standard deviation of $6.00. "
        "Market exhibited downward momentum with price range from $30.00 to $42.50/MWh. This "
        "weekend peak demand period forecast targets $41.00/MWh for next hour dispatch planning."
    )
    assert row.price_range == 12.5
    bare = documents.docs_analysis(feature_row(spark, price_sequence=None, trend_slope=0.0)).first()
    assert "from $0.00 to $0.00" in bare.text and "stable price trend" in bare.text


def test_last_write_wins(spark):
    df = spark.createDataFrame(
        [("a", "old", 1), ("a", "new", 2), ("b", "one", 1)], "doc_id string, text string, version int"
    )
    rows = {r.doc_id: r.text for r in documents.docs_upsert(df, ("version",)).collect()}
    assert rows == {"a": "new", "b": "one"}


def test_metadata_map(spark, prices):
    docs = documents.docs_all(
        documents.docs_observation(prices([("2025-07-31 15:30:00", 45.5)])),
        documents.docs_analysis(feature_row(spark)),
    )
    rows = {r.metadata["type"]: r.metadata for r in documents.documents_for_embedding(docs).collect()}
    assert rows["market_observation"]["price"] == "45.5" and "trend_slope" not in rows["market_observation"]
    assert rows["market_analysis"]["trend_direction"] == "increasing"


ANSWERS = [
    ("One long sentence. One long sentence. Another long one", "One long sentence. Another long one."),
    ("Short. Also short.", ""),
    ("Exactly ten. Eleven chars.", "Exactly ten. Eleven chars."),
    ("\tFirst sentence here.\n Second sentence here. Third sentence here. Fourth sentence here.",
     "First sentence here. Second sentence here. Third sentence here."),
    (" Padded sentence one . x", "Padded sentence one."),
    ("", ""),
]


@pytest.mark.parametrize("text, expected", ANSWERS)
def test_clean_answer(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(clean_answer(F.col("t"))).first()[0] == expected


def test_after_last_mark(spark):
    df = spark.createDataFrame([("Q: a\nA: b\nA: c ",), (" no mark ",)], "t string")
    assert [r[0] for r in df.select(after_last_mark(F.col("t"))).collect()] == ["c", "no mark"]


def vectors(spark, matrix, name="doc_id"):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<double>")


def brute_topk(docs, queries, k):
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    sims = np.round(unit(queries) @ unit(docs).T, 12)
    out = {}
    for q, row in enumerate(sims):
        for rank, d in enumerate(sorted(range(len(row)), key=lambda i: (-row[i], i))[:k], 1):
            out[q, rank] = (d, row[d])
    return out


@pytest.mark.parametrize("query_rows, shard_rows", [(1024, 65_536), (5, 3)])
def test_topk_against_brute_force(spark, query_rows, shard_rows):
    rng = np.random.default_rng(0)
    docs = rng.normal(size=(300, 8))
    docs[100:200] = docs[7]  # a third are copies
    docs[250] = 0.0
    queries = np.vstack([rng.normal(size=(20, 8)), docs[7:8], np.zeros((1, 8))])
    hits = retrieval.cosine_topk(
        vectors(spark, docs).repartition(5), vectors(spark, queries, "query_id"), 5, query_rows, shard_rows
    ).collect()
    want = brute_topk(docs, queries, 5)
    assert len(hits) == len(want)
    for h in hits:
        assert h.doc_id == want[h.query_id, h.rank][0]
        assert h.similarity == pytest.approx(want[h.query_id, h.rank][1], abs=1e-11)
        assert -1 - 1e-9 <= h.similarity <= 1 + 1e-9


def test_topk_with_few_documents_and_no_queries(spark):
    docs = vectors(spark, np.eye(3))
    assert retrieval.cosine_topk(docs, vectors(spark, np.eye(3), "query_id")).count() == 9
    none = vectors(spark, np.eye(3), "query_id").where(F.lit(False))
    assert retrieval.cosine_topk(docs, none).count() == 0


def test_topk_refuses_unequal_vectors(spark):
    docs = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0, 3.0])], "doc_id int, embedding array<double>")
    with pytest.raises(Exception, match="2 numbers"):
        retrieval.cosine_topk(docs.coalesce(1), vectors(spark, np.eye(2), "query_id")).collect()


def test_lsh_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    docs = centres[rng.integers(0, 20, 1000)] + 0.05 * rng.normal(size=(1000, 16))
    queries = centres[:5]
    d, q = vectors(spark, docs), vectors(spark, queries, "query_id")
    exact = {(r.query_id, r.doc_id) for r in retrieval.cosine_topk(d, q).collect()}
    near = {(r.query_id, r.doc_id) for r in retrieval.cosine_topk_lsh(d, q).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_lsh_scores_are_exact_and_copies_of_a_query_are_found(spark):
    rng = np.random.default_rng(4)
    docs, queries = rng.normal(size=(200, 8)), rng.normal(size=(4, 8))
    docs[50:100] = queries[1]
    d, q = vectors(spark, docs), vectors(spark, queries, "query_id")
    want = brute_topk(docs, queries, 200)
    score = {(query, hit[0]): hit[1] for (query, _), hit in want.items()}
    hits = retrieval.cosine_topk_lsh(d, q).collect()
    assert all(h.similarity == pytest.approx(score[h.query_id, h.doc_id], abs=1e-11) for h in hits)
    assert [h.doc_id for h in sorted(hits, key=lambda h: h.rank) if h.query_id == 1] == [50, 51, 52, 53, 54]


def test_hits_context_and_prompt(spark):
    hits = spark.createDataFrame(
        [(1, "a", 0.98765, 1, "market_observation", "2025-07-31 15:30", 45.5, "HB"),
         (1, "b", 0.5, 2, "market_analysis", None, None, None),
         (1, "c", 0.4, 3, None, None, None, None),
         (1, "d", 0.3, 4, "note", None, None, None)],
        "query_id int, doc_id string, similarity double, rank int, type string, timestamp string, price double, settlement_point string",
    )
    rendered = retrieval.render_hits(hits)
    texts = [r.doc_text for r in rendered.orderBy("rank").collect()]
    assert texts == [
        "Market observation at HB on 2025-07-31 15:30. Price: $45.50/MWh (unknown level) during unknown period.",
        "Market analysis for unknown time. Target price: $0.00/MWh with stable trend and moderate volatility.",
        "Document c: unknown data",
        "Document d: note data",
    ]
    context = retrieval.response_context(rendered).first()
    assert context.retrieved_documents == 4
    assert [(c.doc_id, c.similarity) for c in context.context_used] == [("a", 0.988), ("b", 0.5), ("c", 0.4)]
    questions = spark.createDataFrame([(1, "Why?"), (2, "What?")], "query_id int, question string")
    prompts = {r.query_id: r.prompt for r in retrieval.build_prompt(questions, rendered).collect()}
    assert prompts[1] == f"Context: {' '.join(texts[:3])}\n\nQ: Why?\nA:"
    assert prompts[2] == "Q: What?\nA:"


def test_embedding_skips_a_failing_batch(spark):
    docs = spark.createDataFrame(
        [(i, "bad" if i == 40 else f"text {i}") for i in range(100)], "doc_id bigint, text string"
    ).coalesce(1)

    def make_encoder():
        def encode(batch):
            if "bad" in batch:
                raise RuntimeError("no")
            return [[float(len(t)), 1.0] for t in batch]

        return encode

    embedded = embedding.embed_documents(docs, make_encoder)
    report = embedding.embedding_report(embedded).first()
    assert (report.stored, report.failed) == (68, 32)
    assert embedded.where("not failed").first().embedding == [6.0, 1.0]


def test_a_failing_text_takes_its_neighbours_along(spark):
    docs = spark.createDataFrame(
        [(i, "bad" if i in (40, 75) else f"text {i}") for i in range(100)] + [(None, "lost")], "doc_id bigint, text string"
    )

    def make_encoder():
        def encode(batch):
            assert len(batch) <= 10
            if "bad" in batch:
                raise RuntimeError("no")
            return [[float(len(t))] for t in batch]

        return encode

    for parts in (1, 7):
        embedded = embedding.embed_documents(
            docs.repartition(parts), make_encoder, batch_size=10, batch_by=F.floor(F.col("doc_id") / 25)
        )
        rows = embedded.collect()
        # batches of ten and five of each twenty-five
        assert {r.doc_id for r in rows if r.failed} == {*range(35, 45), *range(75, 85)}
        assert all((r.embedding is None) == r.failed for r in rows) and len(rows) == 101
    assert embedding.embed_documents(docs.limit(0), make_encoder).count() == 0
    short = embedding.embed_documents(docs.limit(2), lambda: lambda batch: [[1.0]]).collect()
    assert [r.failed for r in short] == [True, True]


def test_vector_audit(spark):
    vecs = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "doc_id string, embedding array<double>")
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    row = embedding.vector_audit(vecs, docs, 2).first()
    assert (row.vector_count, row.wrong_length, row.missing_ids, row.consistent) == (2, 1, 1, False)
    good = embedding.vector_audit(vecs.limit(1), docs.limit(1), 2).first()
    assert good.consistent is True


def test_question_to_prompt_flow(spark, prices):
    docs = documents.docs_observation(
        prices([("2025-07-31 15:30:00", 45.5, "NORTH"), ("2025-07-31 03:00:00", 12.0, "SOUTH")])
    )
    weights = embedding.fit_text_encoder(docs)
    vecs = embedding.encode_text(docs, weights).select("doc_id", "embedding")
    assert len(vecs.first().embedding) == embedding.DIMENSION
    questions = spark.createDataFrame([(1, "price at south during off-peak hours?")], "query_id int, question string")
    prompts, context = questions_to_prompts(
        questions, vecs, docs.drop("text"), lambda df: embedding.encode_text(df, weights, doc_id="query_id"), k=1
    )
    assert "Market observation at SOUTH" in prompts.first().prompt
    assert context.first().retrieved_documents == 1


def test_words_of_any_script_are_encoded(spark):
    docs = spark.createDataFrame([(1, "prix élevé über größe"), (2, "цена"), (3, None)], "doc_id bigint, text string")
    counts = embedding.term_counts(docs, dimension=1 << 30).groupBy("doc_id").agg(F.sum("n").alias("n"))
    assert {r.doc_id: r.n for r in counts.collect()} == {1: 4, 2: 1}
    vecs = {r.doc_id: r.embedding for r in embedding.encode_text(docs).collect()}
    assert sum(x * x for x in vecs[1]) == pytest.approx(1.0) and not any(vecs[3])


def test_vectors_are_laid_out_slot_by_slot(spark):
    rows = [(1, "north south north"), (2, "gas peaker at noon"), (2, "gas"), (None, "south wind"), (None, "wind"), (3, "!")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    weights = spark.createDataFrame([(i, 1.0 + i) for i in range(8)], "slot int, weight double")
    encoded = embedding.encode_text(docs, weights, dimension=8)
    expected = {}
    for doc_id, text in rows:
        x = expected.setdefault(doc_id, np.zeros(8))
        for word in re.findall("[a-z]+", text):
            x[int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 8] += 1
    for row in encoded.collect():
        x = expected[row.doc_id] * np.arange(1.0, 9.0)
        assert row.embedding == pytest.approx(x / (np.linalg.norm(x) or 1.0))
    # the gathered words of a document are not put together again for each slot
    text = encoded._jdf.queryExecution().optimizedPlan().toString()
    looped = re.findall(r"lambdafunction\(.*", text)
    assert looped and not any("collect_list" in part for part in looped)
    # copies of an id and missing ids are one row each, as they came
    assert sorted(str(r.doc_id) for r in encoded.collect()) == sorted(str(r[0]) for r in rows)
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        embedding.encode_text(docs, weights.union(weights), dimension=8).collect()


def test_answers_without_a_mark(spark):
    rows = [("Why? Because demand was high.", "Why?"), ("Why? no", "Why?"), ("Q: x\nA: Prices rose a lot today. ", None)]
    got = retrieval.clean_answers(spark.createDataFrame(rows, "text string, prompt string"), prompt="prompt")
    assert [r.answer for r in got.collect()] == [
        "Because demand was high.",
        "I'm not sure how to answer that question based on the available market data.",
        "Prices rose a lot today.",
    ]


def moments(spark, stamps, name):
    rows = [(i, s) for i, s in enumerate(stamps)]
    id_name = "row_id" if name == "timestamp" else "window_id"
    return spark.createDataFrame(rows, f"{id_name} bigint, {name} timestamp")


NOON = datetime(2025, 7, 31, 12)


@pytest.mark.parametrize(
    "offsets, expected",
    [([-3600], None), ([-3599], -3599), ([3600], None), ([3599], 3599), ([-3600, -3540, 3540], 3540),
     ([0, 60], 60), ([0], 0), ([-3540, -3600], -3540), ([], None)],
)
def test_nearest_feature_edges(spark, offsets, expected):
    market = moments(spark, [NOON], "timestamp")
    feats = spark.createDataFrame(
        [(i, NOON + timedelta(seconds=o)) for i, o in enumerate(offsets)], "window_id bigint, target_time timestamp"
    )
    row = intervals.nearest_feature(market, feats, ("window_id",)).collect()
    assert len(row) == 1
    want = None if expected is None else NOON + timedelta(seconds=expected)
    assert row[0].feature_target_time == want


def test_nearest_feature_against_brute_force(spark):
    rng = random.Random(8)
    def stamp():
        return NOON + timedelta(seconds=rng.randrange(0, 12 * 3600, 30))

    market = [(i, rng.choice("ab"), stamp()) for i in range(300)]
    feats = [(i, rng.choice("ab"), stamp()) for i in range(40)]
    m = spark.createDataFrame(market, "row_id bigint, settlement_point string, timestamp timestamp")
    f = spark.createDataFrame(feats, "window_id bigint, settlement_point string, target_time timestamp")
    for by in ((), ("settlement_point",)):
        got = {
            r.row_id: r.feature_window_id
            for r in intervals.nearest_feature(m, f, ("window_id",), by=by, tie_break=("window_id",)).collect()
        }
        assert len(got) == 300
        for i, point, ts in market:
            near = [
                x for x in feats
                if abs((x[2] - ts).total_seconds()) < 3600 and (not by or x[1] == point)
            ]
            want = max(near, key=lambda x: (x[2], -x[0]))[0] if near else None
            assert got[i] == want


def test_pair_answers(spark):
    rows = spark.createDataFrame(
        [(1, datetime(2025, 7, 31, 15, 30), "HB", 52.0, NOON, 0.2, 0.4, 2.0),
         (2, datetime(2025, 7, 31, 3, 0), "HB", 36.0, None, None, None, None),
         (3, datetime(2025, 7, 31, 20, 0), "HB", 20.0, NOON, -0.2, 0.1, -2.0)],
        "row_id int, timestamp timestamp, settlement_point string, price double, "
        "feature_target_time timestamp, feature_trend_slope double, feature_price_volatility double, "
        "feature_momentum_1h double",
    )

    def answers(df):
        return [r.answer for r in df.orderBy("row_id").collect()]

    assert answers(qa.qa_price_forecast(rows, ("row_id",)))[:2] == [
        "The expected price for 15:30 on Thursday is $52.00/MWh. Market shows increasing trend with high "
        "volatility. This represents high pricing for HB.",
        "The current price for 03:00 on Thursday is $36.00/MWh, indicating moderate market conditions at HB.",
    ]
    assert answers(qa.qa_dispatch(rows, ("row_id",))) == [
        "Yes, dispatch recommended. Price of $52.00/MWh exceeds typical marginal costs. Current market "
        "conditions show high pricing at HB.",
        "Consider dispatch. Price of $36.00/MWh is borderline profitable. Current market conditions show "
        "moderate pricing at HB.",
        "No dispatch recommended. Price of $20.00/MWh is below marginal costs. Current market conditions "
        "show low pricing at HB.",
    ]
    assert answers(qa.qa_market_analysis(rows, ("row_id",)))[1:] == [
        "Prices are normal at 03:00 on Thursday primarily due to off-peak hours. The $36.00/MWh level "
        "indicates moderate market conditions.",
        "Prices are low at 20:00 on Thursday due to evening demand period combined with downward pressure. "
        "The $20.00/MWh level reflects typical low market conditions with current supply-demand balance.",
    ]
    assert answers(qa.qa_operational(rows, ("row_id",)))[2] == (
        "For 20:00 on Thursday, peak load possible with high grid stress indicators. Current price of "
        "$20.00/MWh suggests low demand levels."
    )


def test_technical_pair(spark):
    row = qa.qa_technical(feature_row(spark), ("window_id",)).first()
    assert row.question == "What does the technical analysis show for 15:00 on Saturday?"
    assert row.answer == (
        "Technical analysis for 15:00 on Saturday shows bullish trend with moderate volatility. 24-hour "
        "average is $35.25/MWh, targeting $41.00/MWh. Market exhibits trend slope of 0.200."
    )


def test_pairs_are_sampled_limited_on_request_and_repeatable(spark, small):
    from wattframe.plans import views

    market, features = views.market(spark, small), views.features(spark, small)
    matched = intervals.nearest_feature(market, features, ("window_id", *qa.MATCHED), by=("settlement_point",))
    ids = ("row_id",), ("settlement_point", "window_id")
    assert qa.qa_pairs(matched, features, *ids).count() > 1000
    one = qa.qa_pairs(matched, features, *ids, limit=120).collect()
    assert len(one) == 120 and one == qa.qa_pairs(matched, features, *ids, limit=120).collect()
    assert {r.type for r in one} == set(qa.SHARES)
    assert all(r.answer.endswith(".") and "{" not in r.question + r.answer for r in one)
