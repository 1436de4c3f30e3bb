import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.operators import baseline, comparison, evaluation, forest, modeldata, trees
from wattframe.sources.tables import FORECAST_INPUTS
from wattframe.plans import views


@pytest.fixture(scope="module")
def features(spark, small):
    rows = views.features(spark, small).persist()
    yield rows
    rows.unpersist()


def test_assemble_leaves_out_ids(features):
    row = modeldata.assemble(features).first()
    assert len(row.features) == 19 and row.label == row.target_price


@pytest.mark.parametrize("n, share, expected", [(10, 0.2, 2), (11, 0.2, 3), (97, 0.2, 20), (1, 0.2, 1)])
def test_split_is_exact_and_repeatable(spark, n, share, expected):
    df = spark.range(n)
    marked = modeldata.split_train_test(df, ["id"], share)
    rows = {r.id: r.is_test for r in marked.collect()}
    assert len(rows) == n and sum(rows.values()) == expected
    again = {r.id: r.is_test for r in modeldata.split_train_test(df.repartition(5), ["id"], share).collect()}
    assert rows == again


def test_split_rounding_down_and_seed(spark):
    df = spark.range(97)
    train = modeldata.split_train_test(df, ["id"], 0.8, round_up=False).where("is_test").count()
    assert train == 77
    one, two = (
        {r.id for r in modeldata.split_train_test(df, ["id"], seed=s).where("is_test").collect()}
        for s in (42, 43)
    )
    assert one != two


def test_split_in_time(features):
    cut = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    marked = modeldata.split_in_time(features, cut)
    assert marked.where("is_test").agg(F.min("target_time")).first()[0].day == 20


def test_standardize_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 7.0, True), (3.0, 7.0, True), (9.0, 8.0, False)], "x double, c double, train boolean")
    rows = modeldata.standardize(df, ["x", "c"], fit_on=F.col("train")).collect()
    assert [r.x for r in rows] == [-1.0, 1.0, 7.0]
    assert [r.c for r in rows] == [0.0, 0.0, 1.0]


def test_forest_fits_saves_and_reloads(features, tmp_path):
    model = forest.train_forest(features, trees=5, depth=5)
    assert forest.r_squared(model, features) > 0.05
    forest.save_model(model, str(tmp_path / "m"))
    again = forest.load_model(str(tmp_path / "m"))
    usable = modeldata.forecast_inputs(features)
    pick = ["settlement_point", "window_id", "prediction"]
    one = forest.predict(model, usable).select(pick).orderBy(pick).collect()
    two = forest.predict(again, usable).select(pick).orderBy(pick).collect()
    assert one == two


def test_forest_needs_rows(features):
    with pytest.raises(ValueError, match="at least 10"):
        forest.train_forest(features.orderBy("settlement_point", "window_id").limit(9))


def test_model_forecast_is_bounded(spark, features):
    model = forest.train_forest(features, trees=3, depth=3)
    asked = spark.createDataFrame([("2025-07-31 17:00:00",), ("2025-07-31 03:00:00",), ("2025-08-02 12:00:00",)], "t string")
    asked = asked.select(F.to_timestamp("t").alias("target_time"))
    rows = forest.forecast_model(model, asked).orderBy("target_time").collect()
    raw = forest.predict(
        model,
        asked.withColumns(
            {**{k: F.lit(v) for k, v in forest.DEFAULT_INPUTS.items()},
             "hour_of_day": F.hour("target_time"), "day_of_week": F.weekday("target_time"),
             "is_weekend": (F.weekday("target_time") >= 5).cast("int"),
             "is_peak_hour": F.hour("target_time").between(14, 18).cast("int")}
        ),
    ).orderBy("target_time").collect()
    for row, plain, factor in zip(rows, raw, (0.8, 1.3, 1.0)):
        assert row.predicted_price == pytest.approx(min(max(plain.prediction * factor, 15), 100), abs=0.005)
        assert row.confidence == 0.85 and row.model_type == "RandomForest"
    assert rows[2].time_features.is_weekend == 1


def test_requests_by_model_keep_unreadable_ones(spark, features, prices):
    from wattframe.plans.flows import requests_to_forecasts

    model = forest.train_forest(features, trees=2, depth=2)
    asked = spark.createDataFrame([("2025-07-31T17:00:00",), ("nope",)], "requested string")
    market = prices([("2025-07-30 00:00:00", 30.0)])
    rows = {r.requested: r for r in requests_to_forecasts(asked, market, model).collect()}
    assert rows["nope"].predicted_price is None and rows["nope"].error == "Invalid timestamp format"
    assert 15 <= rows["2025-07-31T17:00:00"].predicted_price <= 100


STAMPS = [
    ("2025-07-31T15:30:00", 49.0, None),
    ("2025-07-31T17:00:00", 49.0, None),
    ("2025-07-31T03:00:00", 24.5, None),
    ("2025-07-31 15:30:00", 49.0, None),
    ("2025-07-31T15:30:00Z", 49.0, None),
    ("2025-08-02T12:00:00", 31.5, None),
    ("2025-07-31T12:00:00", 35.0, None),
    ("2025-07-31T15:30:00+00:00", 49.0, None),
    ("2025-07-31T15:30:00.5-05:30", 49.0, None),
    ("2025-07-31T15", 49.0, None),
    ("20250731T153000", 49.0, None),
    ("2025-07-31T15:30", 49.0, None),
    ("2025-13-31T15:30", None, "Invalid timestamp format"),
    ("2025-0731T15:30", None, "Invalid timestamp format"),
    ("nope", None, "Invalid timestamp format"),
]


def test_bulk_forecast(spark, prices):
    market = prices([("2025-07-30 00:00:00", 30.0), ("2025-07-30 01:00:00", 40.0)])
    asked = spark.createDataFrame([(s,) for s, _, _ in STAMPS], "requested string")
    rows = {r.requested: r for r in baseline.forecast_bulk(asked, market).collect()}
    for stamp, price, error in STAMPS:
        assert rows[stamp].predicted_price == price and rows[stamp].error == error
    assert rows["2025-07-31T15:30:00Z"].target_time.hour == 15
    assert rows["nope"].confidence is None and rows["2025-07-31T12:00:00"].confidence == 0.65


def test_empty_request_means_an_hour_from_now(spark):
    asked = spark.createDataFrame([("",), (None,), ("2025-07-31T03:00:00",)], "requested string")
    now = F.to_timestamp(F.lit("2025-07-31 10:30:00"))
    rows = baseline.parse_requests(asked, now=now).collect()
    assert [r.target_time.hour for r in rows] == [11, 11, 3]
    assert baseline.parse_requests(asked).where("target_time is null").count() == 2


def test_fallback_when_no_price_can_be_computed(spark, prices):
    market = prices([("2025-07-30 00:00:00", None)])
    asked = spark.createDataFrame([("2025-07-31T12:00:00",)], "requested string")
    row = baseline.forecast_bulk(asked, market).first()
    assert (row.predicted_price, row.confidence, row.model_type, row.error) == (35.0, 0.5, "Fallback", "no price")


def test_baseline_of_an_empty_market(spark, prices):
    market = prices([("2025-07-30 00:00:00", 1.0)]).where(F.lit(False))
    asked = spark.createDataFrame([("2025-07-31T12:00:00",)], "requested string")
    assert baseline.forecast_bulk(asked, market).first().predicted_price == 35.0


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 16.0), (0.0, 3.0)], "actual double, predicted double")
    row = evaluation.eval_metrics(df).first()
    errors, actual = np.array([2.0, -4.0, 3.0]), np.array([10.0, 20.0, 0.0])
    assert row.rmse == pytest.approx(np.sqrt((errors**2).mean()))
    assert row.mae == pytest.approx(3.0)
    assert row.r2 == pytest.approx(1 - (errors**2).sum() / ((actual - actual.mean()) ** 2).sum())
    profile = evaluation.error_profile(df).first()
    assert profile.bias == pytest.approx(errors.mean()) and profile.error_std == pytest.approx(errors.std())
    assert profile.max_abs_error == 4.0
    assert profile.mean_abs_pct_error == pytest.approx(20.0) and profile.median_abs_pct_error == pytest.approx(20.0)
    rows = evaluation.pred_vs_actual(df).collect()
    assert [r.error_pct for r in rows] == pytest.approx([20.0, -20.0, 0.0])


def test_loss_history(spark):
    losses = [(1, 9.0, 8.0), (2, 7.0, 6.0), (3, 6.0, 6.5), (4, 5.0, 5.0), (5, 3.0, 5.0)]
    df = spark.createDataFrame([("r", *x) for x in losses], "run string, epoch int, train_loss double, val_loss double")
    rows = evaluation.metric_history(df).orderBy("epoch").collect()
    assert rows[0].change_pct is None
    assert rows[1].change_pct == pytest.approx(25.0) and rows[2].change_pct == pytest.approx(-100 / 12)
    assert [r.is_best for r in rows] == [True, True, False, True, False]
    assert all(r.loss_decreased and r.reduction_pct == pytest.approx(200 / 3) for r in rows)


# Published scores of ten questions: (base, tuned) where known, and the averages.
PUBLISHED = [(54.934112548828125, 120.9764175415039), (26.291893005371094, 98.60986328125),
             (46.948734283447266, 70.79470825195312), (32.88509750366211, 88.19097137451172)]


def test_model_comparison_on_published_scores(spark):
    df = spark.createDataFrame([(f"q{i}", *s) for i, s in enumerate(PUBLISHED)], "question string, base_perplexity double, fine_tuned_perplexity double")
    row = comparison.model_comparison(df).first()
    base, tuned = np.mean([s[0] for s in PUBLISHED]), np.mean([s[1] for s in PUBLISHED])
    assert row.improvement_pct == pytest.approx((base - tuned) / base * 100)
    assert (row.questions_improved, row.total_questions, row.test_passed) == (0, 4, False)
    first = comparison.question_improvement(df).orderBy("question").first()
    assert first.improvement == pytest.approx(-66.04230499267578) and first.improved is False
    nested = comparison.report_documents(df.withColumn("run", F.lit("a")), ("run",)).first()
    assert len(nested.detailed_results) == 4 and nested.summary_statistics.total_questions == 4


def test_eval_baselines_by_hand(spark):
    rows = [("A", h, float(v), float(v) + 1, h >= 4) for h, v in enumerate([10, 20, 30, 40, 50, 70])]
    df = spark.createDataFrame(rows, "settlement_point string, target_time int, actual double, predicted double, is_test boolean")
    row = evaluation.eval_baselines(df).first()
    assert row.model_rmse == pytest.approx(1.0)
    assert row.mean_mae == pytest.approx((25 + 45) / 2)
    assert row.hour_mae == pytest.approx((10 + 20) / 2)
    assert row.better_than_mean and row.better_than_hour
    assert row.gain_over_hour_pct == pytest.approx((np.sqrt(250) - 1) / np.sqrt(250) * 100)


def test_nodes_predict_what_the_forest_does(spark, features, tmp_path):
    model = forest.train_forest(features, trees=6, depth=6)
    nodes = forest.export_nodes(model, str(tmp_path / "n"))
    usable = modeldata.forecast_inputs(features)
    rows = trees.score(forest.predict(model, usable).withColumnRenamed("prediction", "own"), nodes, FORECAST_INPUTS, 6)
    differing = rows.where(~(F.abs(F.col("own") - F.col("prediction")) <= 1e-9))
    assert differing.isEmpty() and rows.agg(F.count_distinct("prediction")).first()[0] > 50
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "Exchange" not in plan.split("Subquery")[0].rpartition("Scan")[2]


def test_requests_are_walked_once_for_each_hour_and_weekday(spark, features, tmp_path):
    model = forest.train_forest(features, trees=4, depth=4)
    nodes = forest.export_nodes(model, str(tmp_path / "n"))
    asked = spark.range(500).select((F.lit("2025-07-31").cast("timestamp") + F.make_dt_interval(hours=F.col("id") % 200)).alias("target_time"))
    one = forest.forecast_model(model, asked).orderBy("target_time").collect()
    two = forest.forecast_nodes(nodes, asked, depth=4).orderBy("target_time").collect()
    assert one == two
    nothing = spark.createDataFrame([(None,)], "target_time timestamp")
    assert forest.forecast_nodes(nodes, nothing, depth=4).first().predicted_price is None


def test_a_walk_by_hand(spark):
    nodes = spark.createDataFrame(
        [(0, 0, "x", 1.0, 2.0, 0.5, 1, 2, 9.0), (0, 1, None, None, None, None, -1, -1, 10.0), (0, 2, "y", 0.0, 1.0, 3.0, 3, 4, 9.0),
         (0, 3, None, None, None, None, -1, -1, 20.0), (0, 4, None, None, None, None, -1, -1, 30.0), (1, 0, None, None, None, None, -1, -1, 2.0)],
        trees.NODE_SCHEMA,
    )
    rows = spark.createDataFrame([(2.0, 0.0), (2.1, 3.0), (2.1, 3.1), (None, 1.0)], "x double, y double")
    assert [r.prediction for r in trees.score(rows, nodes, ("x", "y"), 5).collect()] == [6.0, 11.0, 16.0, None]
