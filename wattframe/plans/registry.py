"""Registered queries: one entry per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.functions.numbers import fixed, round_even
from wattframe.functions.times import MARKET_ZONES
from wattframe.functions.zones import local_to_utc, with_utc
from wattframe.operators import (
    baseline,
    cleaning,
    comparison,
    documents,
    embedding,
    evaluation,
    forest,
    intervals,
    ivf,
    modeldata,
    qa,
    quantiles,
    reports,
    retrieval,
    timeseries,
    trees,
)
from wattframe.operators import features as feature_ops
from wattframe.plans import flows, views
from wattframe.sources import evaluation as evaluation_source
from wattframe.sources import daily, feeds, normalize, tables, variants, vectors, versions
from wattframe.sources.tables import FORECAST_INPUTS
from wattframe.streaming import market as market_stream
from wattframe.streaming import state as stream_state
from wattframe.workspace import cut_lineage, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, digits: int = views.CHECK_DIGITS) -> DataFrame:
    """Doubles rounded so that sums taken in different order compare equal."""
    doubles = [name for name, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: round_even(F.col(c), digits) for c in doubles})


def _joined(values: Column, show: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(values, show), ",")


# Sources and sinks


_ENVELOPE_RECORD = "datetime_beginning_ept string, pnode_id string, total_lmp double, type string"


@query
def ingest_positional(spark, sf_dir):
    payloads = views.with_damaged(views.positional_payloads(spark, sf_dir))
    return feeds.parse_positional(payloads, skip_bad=True)


@query
def ingest_envelope(spark, sf_dir):
    payloads = views.with_damaged(views.envelope_payloads(spark, sf_dir))
    return feeds.unwrap_envelope(payloads, _ENVELOPE_RECORD, skip_bad=True)


@query
def ingest_bad_payloads(spark, sf_dir):
    payloads = views.with_damaged(views.envelope_payloads(spark, sf_dir))
    return feeds.bad_payloads(payloads).select("block")


_DRIFTING = {
    "time": ("string", ("$.datetime_beginning_ept", "$.DateTime")),
    "point": ("string", ("$.pnode_id", "$.node.id")),
    "price": ("double", ("$.total_lmp", "$.lmp.total", "$.LMP")),
    "kind": ("string", ("$.type", "$.node.kind")),
    "zone": ("string", ("$.zone",)),
}


@query
def ingest_variants(spark, sf_dir):
    records = variants.read_records(views.drifting_payloads(spark, sf_dir).select("value"))
    return variants.typed(records, _DRIFTING)


@query
def payload_members(spark, sf_dir):
    return variants.member_report(variants.read_records(views.drifting_payloads(spark, sf_dir)), _DRIFTING)


@query
def ingest_json(spark, sf_dir):
    path = shared_folder(spark, "feed-json")
    views.one_file_each(views.envelope_payloads(spark, sf_dir, views.FILE_ROWS), path)
    return feeds.read_feed(spark, path, _ENVELOPE_RECORD, format="json")


@query
def ingest_positional_files(spark, sf_dir):
    path = shared_folder(spark, "feed-positional")
    views.one_file_each(views.positional_payloads(spark, sf_dir, views.FILE_ROWS), path)
    return feeds.read_feed(spark, path, "", format="positional")


@query
def ingest_csv(spark, sf_dir):
    path = shared_folder(spark, "feed-csv")
    views.miso_raw(spark, sf_dir).write.csv(path, header=True)
    schema = "LocalTime string, Pnode string, LMP string, PriceType string"
    return feeds.read_feed(spark, path, schema, format="csv")


@query
def scan_sorted(spark, sf_dir):
    return tables.scan_sorted(views.market(spark, sf_dir))


@query
def scan_days_back(spark, sf_dir):
    market = views.market(spark, sf_dir)
    recent = tables.scan_days_back(market, tables.latest_time(market), days=7)
    return tables.scan_sorted(recent, ("timestamp", "repeat_hour_flag", "settlement_point", "price"))


@query
def scan_stored_days(spark, sf_dir):
    market = views.market(spark, sf_dir).withColumn("iso", F.lit("ERCOT"))
    stored = tables.store_market(market, shared_folder(spark, "market"))
    recent = tables.scan_days_back(stored, tables.latest_time(market), days=7)
    return recent.select("iso", "timestamp", "settlement_point", "price", "row_id")


@query
def scan_feature_matrix(spark, sf_dir):
    path = shared_folder(spark, "feature-matrix")
    tables.sink_replace(feature_ops.export_sequences(views.features(spark, sf_dir)), path)
    stored = tables.load_feature_matrix(spark, path)
    return _rounded(stored.select(*tables.FEATURE_SCAN_COLUMNS, "settlement_point"))


@query
def scan_latest_n(spark, sf_dir):
    market = views.market(spark, sf_dir)
    return tables.scan_latest_n(market, tables.LATEST_FOR_DOCUMENTS, tie_break=("row_id",))


@query
def scan_features(spark, sf_dir):
    return tables.scan_features(views.features(spark, sf_dir), tie_break=("settlement_point",))


@query
def vectors_from_map(spark, sf_dir):
    rows = vectors.vectors_from_map(views.vector_store_texts(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.size("embedding").alias("dimension"),
        _joined(F.col("embedding"), lambda x: fixed(x, 6)).alias("vector"),
        F.col("metadata")["label"].alias("label"),
    )


@query
def read_eval_report(spark, sf_dir):
    path = shared_folder(spark, "eval-report")
    documents_ = comparison.report_documents(views.scored_questions(spark, sf_dir), ("run",))
    evaluation_source.write_eval_report(documents_, path)
    stored = evaluation_source.read_eval_report(spark, path, multi_line=False)
    return _rounded(
        evaluation_source.report_questions(stored).select(
            F.col("evaluation_timestamp").alias("run"),
            "test_passed",
            "question",
            "base_perplexity",
            "fine_tuned_perplexity",
            "improvement",
            "improved",
        )
    )


@query
def sink_replace(spark, sf_dir):
    """A table replaced by nothing, by half of the market, and by that half with the rest added."""
    path = shared_folder(spark, "replace")
    market = views.market(spark, sf_dir)
    half = F.col("row_id") % 2 == 0
    versions.replace(market.where(F.col("row_id") < 0), path)
    versions.replace(market.where(half), path)
    versions.replace(versions.read_version(spark, path).unionByName(market.where(~half)), path)
    return versions.read_version(spark, path)


@query
def sink_append(spark, sf_dir):
    path = shared_folder(spark, "append")
    versions.append(views.market(spark, sf_dir), path)
    return versions.append(views.market_dirty(spark, sf_dir), path).select("rows_before", "total_rows", "rows_added")


@query
def sink_audit(spark, sf_dir):
    path = shared_folder(spark, "audit")
    versions.replace(views.market(spark, sf_dir), path)
    return versions.audit(spark, path)


@query
def sink_vectors(spark, sf_dir):
    rows = views.vectors(spark, sf_dir)
    return vectors.sink_vectors(rows, shared_folder(spark, "vectors"), "given")


# Projection, filters, cleaning


@query
def normalize_pjm(spark, sf_dir):
    return _rounded(normalize.normalize_pjm(views.pjm_raw(spark, sf_dir)))


@query
def normalize_miso(spark, sf_dir):
    return _rounded(normalize.normalize_miso(views.miso_raw(spark, sf_dir)))


@query
def normalize_miso_split(spark, sf_dir):
    return _rounded(normalize.normalize_miso(views.miso_split_raw(spark, sf_dir)))


@query
def union_feeds(spark, sf_dir):
    return _rounded(
        normalize.union_feeds(
            normalize.normalize_pjm(views.pjm_raw(spark, sf_dir)),
            normalize.normalize_miso(views.miso_split_raw(spark, sf_dir)),
        )
    )


@query
def to_utc(spark, sf_dir):
    local, again = F.col("local"), F.col("second_pass")
    return views.local_times(spark, sf_dir).select(
        "row_id",
        local_to_utc(local, MARKET_ZONES["PJM"], again).alias("from_new_york"),
        local_to_utc(local, MARKET_ZONES["MISO"], again).alias("from_chicago"),
        local_to_utc(local, MARKET_ZONES["MISO"]).alias("first_pass"),
    )


@query
def to_utc_by_zone(spark, sf_dir):
    """Rows of both markets in one table, by a join with the zones' intervals."""
    zones = tuple(MARKET_ZONES.values())
    rows = views.local_times(spark, sf_dir).withColumn("zone", F.get(F.array(*map(F.lit, (*zones, "Mars/Base"))), F.col("row_id") % 3))
    return with_utc(rows, "local", "zone", zones, "second_pass").select("row_id", "zone", "utc")


@query
def coerce_price(spark, sf_dir):
    raw = views.miso_raw(spark, sf_dir).select("Pnode", F.col("LMP").alias("price"))
    return cleaning.coerce_price(raw.withColumn("raw_price", F.col("price")))


@query
def ffill_price(spark, sf_dir):
    rows = views.market_dirty(spark, sf_dir).dropna(subset=["timestamp"])
    return cleaning.forward_fill(rows, tie_break="row_id")


@query
def impute_median(spark, sf_dir):
    return _rounded(cleaning.impute_median(views.market_dirty(spark, sf_dir)))


@query
def clamp_price(spark, sf_dir):
    return cleaning.clamp_price(views.market_dirty(spark, sf_dir))


def _clean(spark, sf_dir):
    return cleaning.clean_prices(views.market_dirty(spark, sf_dir), tie_break="row_id")


@query
def clean_prices(spark, sf_dir):
    return _rounded(_clean(spark, sf_dir))


@query
def quality_report(spark, sf_dir):
    before = views.market_dirty(spark, sf_dir)
    return _rounded(cleaning.quality_report(before, _clean(spark, sf_dir)))


@query
def features_fill(spark, sf_dir):
    rows = views.features_dirty(spark, sf_dir).select(
        "settlement_point", *tables.FEATURE_SCAN_COLUMNS
    )
    return cleaning.features_fill(rows, tables.FORECAST_INPUTS)


@query
def features_finite(spark, sf_dir):
    rows = views.features_dirty(spark, sf_dir).select(
        "settlement_point", *tables.FEATURE_SCAN_COLUMNS
    )
    return cleaning.features_finite(rows, tables.FORECAST_INPUTS)


# Time series and windows


@query
def top_hub(spark, sf_dir):
    return timeseries.top_hub(views.market(spark, sf_dir))


@query
def hourly_mean(spark, sf_dir):
    return _rounded(timeseries.hourly_mean(views.market(spark, sf_dir)))


@query
def hourly_spine(spark, sf_dir):
    hourly = timeseries.hourly_mean(views.market(spark, sf_dir))
    return _rounded(timeseries.hourly_spine(hourly))


@query
def hourly_filled(spark, sf_dir):
    return _rounded(timeseries.prepare_hourly(views.market(spark, sf_dir)))


@query
def sliding_windows(spark, sf_dir):
    series = timeseries.prepare_hourly(views.market(spark, sf_dir))
    return _rounded(
        timeseries.sliding_windows(series).drop("price_sequence", "timestamp_sequence")
    )


@query
def window_sequences(spark, sf_dir):
    series = timeseries.prepare_hourly(views.market(spark, sf_dir))
    return timeseries.sliding_windows(series).select(
        "settlement_point",
        "window_id",
        _joined(F.col("price_sequence"), lambda x: fixed(x, 6)).alias("prices"),
        _joined(
            F.col("timestamp_sequence"), lambda t: F.date_format(t, "yyyy-MM-dd HH:mm")
        ).alias("times"),
    )


# Window features


@query
def feature_matrix(spark, sf_dir):
    return _rounded(views.features(spark, sf_dir).drop("price_sequence"))


@query
def feature_matrix_top_hub(spark, sf_dir):
    market = timeseries.at_top_hub(views.market(spark, sf_dir))
    matrix = feature_ops.feature_matrix(
        timeseries.prepare_hourly(market),
        digits=views.CHECK_DIGITS,
        ratio_digits=views.CHECK_DIGITS,
    )
    return _rounded(matrix.drop("price_sequence"))


@query
def parse_sequence(spark, sf_dir):
    stored = feature_ops.export_sequences(views.features(spark, sf_dir))
    damaged = F.when(F.col("window_id") % 9 != 4, F.col("price_sequence_json")).otherwise("oops")
    parsed = feature_ops.import_sequences(stored.withColumn("price_sequence_json", damaged))
    return parsed.select(
        "settlement_point",
        "window_id",
        F.size("price_sequence").alias("n_prices"),
        _joined(F.col("price_sequence"), lambda x: fixed(x, 6)).alias("prices"),
    )


# Aggregations and reports


@query
def ingest_stats(spark, sf_dir):
    return reports.ingest_stats(views.market(spark, sf_dir))


@query
def load_summary(spark, sf_dir):
    market = views.market(spark, sf_dir)
    recent = tables.scan_days_back(market, tables.latest_time(market), days=7)
    return reports.load_summary(recent)


@query
def feature_stats(spark, sf_dir):
    return _rounded(reports.feature_stats(views.features(spark, sf_dir)))


@query
def null_audit(spark, sf_dir):
    return reports.null_audit(views.features_dirty(spark, sf_dir))


@query
def feature_overview(spark, sf_dir):
    return _rounded(reports.feature_overview(views.features(spark, sf_dir)))


@query
def target_stats(spark, sf_dir):
    return _rounded(reports.target_stats(views.features(spark, sf_dir)))


@query
def type_counts(spark, sf_dir):
    return reports.type_counts(_docs(spark, sf_dir))


@query
def baseline_stats(spark, sf_dir):
    return _rounded(reports.baseline_stats(_recent(spark, sf_dir)))


@query
def preview_topn(spark, sf_dir):
    return _rounded(
        reports.preview(views.features(spark, sf_dir), 5, ("window_id", "settlement_point"))
    )


# Model data, forecasting, evaluation


def _recent(spark, sf_dir):
    """What the rule-based forecast takes its mean from: the whole market."""
    return views.market(spark, sf_dir)


_WINDOW_IDS = ("settlement_point", "window_id")


@query
def assemble(spark, sf_dir):
    assembled = modeldata.assemble(views.features(spark, sf_dir))
    return assembled.select(
        *_WINDOW_IDS,
        _joined(vector_to_array("features"), lambda x: fixed(x, 6)).alias("features"),
        "label",
    )


@query
def split_train_test(spark, sf_dir):
    rows = views.features(spark, sf_dir).select(*_WINDOW_IDS, "target_time", "target_price")
    return _rounded(modeldata.split_train_test(rows, _WINDOW_IDS))


@query
def split_in_time(spark, sf_dir):
    rows = views.features(spark, sf_dir).select(*_WINDOW_IDS, "target_time", "target_price")
    return _rounded(modeldata.split_in_time(rows, modeldata.time_cut(rows)))


@query
def standardize(spark, sf_dir):
    rows = views.features(spark, sf_dir).select(*_WINDOW_IDS, *feature_ops.FEATURE_NAMES)
    marked = modeldata.split_train_test(rows, _WINDOW_IDS)
    return _rounded(
        modeldata.standardize(marked, feature_ops.FEATURE_NAMES, fit_on=~F.col("is_test"))
    )


def _trained(spark, sf_dir):
    """Features, stored once since training and scoring both read them, and their forest."""
    rows = cut_lineage(views.features(spark, sf_dir))
    return rows, forest.train_forest(rows)


#: R2 that the forest has to reach on the rows it was fitted on.
_LEAST_R2 = 0.2


@query
def rf_forecast(spark, sf_dir):
    """Predictions of the forest, of the forest reloaded, and of its table of nodes, row by row."""
    rows, model = _trained(spark, sf_dir)
    usable = modeldata.forecast_inputs(rows)
    path = shared_folder(spark, "forest")
    forest.save_model(model, path)
    nodes = forest.export_nodes(model, shared_folder(spark, "nodes"))
    own = forest.predict(model, usable)
    again = forest.predict(forest.load_model(path), own.withColumnRenamed("prediction", "own")).withColumnRenamed(
        "prediction", "reloaded"
    )
    target, error = F.col("target_price"), F.col("target_price") - F.col("own")
    return trees.score(again, nodes, FORECAST_INPUTS, forest.DEPTH).agg(
        F.count("*").alias("scored_rows"),
        F.count_if(F.col("own") == F.col("reloaded")).alias("same_when_reloaded"),
        F.count_if(F.abs(F.col("own") - F.col("prediction")) <= 1e-9).alias("same_by_nodes"),
        (F.count_distinct("own") > 100).alias("predictions_differ"),
        (1 - F.sum(error * error) / (F.var_pop(target) * F.count("*")) >= _LEAST_R2).alias("fits"),
    )


@query
def forecast_model(spark, sf_dir):
    """Prices by the trained forest, through MLlib and through its nodes."""
    _, model = _trained(spark, sf_dir)
    asked = views.market(spark, sf_dir).select("row_id", F.col("timestamp").alias("target_time"))
    nodes = forest.export_nodes(model, shared_folder(spark, "nodes"))
    by_nodes = forest.forecast_nodes(nodes, asked).select("row_id", F.col("predicted_price").alias("by_nodes"))
    priced = forest.forecast_model(model, asked).join(by_nodes, "row_id")
    return priced.select(
        "row_id", "target_time", (F.abs(F.col("predicted_price") - F.col("by_nodes")) < 0.011).alias("same_price"),
        "currency", "confidence", "model_type", "time_features.*",
    )


@query
def forecast_given_forest(spark, sf_dir):
    """Prices of a forest whose nodes follow a rule, over all windows and all requests."""
    nodes = views.given_forest(spark)
    windows = trees.score(modeldata.forecast_inputs(views.features(spark, sf_dir)), nodes, FORECAST_INPUTS, views.GIVEN_DEPTH)
    return windows.select("settlement_point", "window_id", forest.bounded_price(F.col("prediction")).alias("predicted_price"))


@query
def forecast_one_split(spark, sf_dir):
    """A tree of one split by the calendar, trained on all windows, and its price for each request."""
    calendar = ("hour_of_day", "day_of_week", "is_weekend", "is_peak_hour")
    rows = views.features(spark, sf_dir).drop("price_sequence")
    model = forest.train_forest(rows, trees=1, depth=1, inputs=calendar, bootstrap=False)
    nodes = forest.export_nodes(model, shared_folder(spark, "nodes"))
    asked = views.market(spark, sf_dir).select("row_id", F.col("timestamp").alias("target_time"))
    return forest.forecast_nodes(nodes, asked, inputs=calendar, depth=1).select("row_id", "target_time", "predicted_price")


@query
def forecast_few_rows(spark, sf_dir):
    """Too few windows for a forest, so the rule answers."""
    few = views.features(spark, sf_dir).where(
        (F.col("window_id") < forest.MIN_ROWS - 1) & (F.col("settlement_point") == "click")
    )
    return flows.requests_to_forecasts(
        views.requests(spark, sf_dir), _recent(spark, sf_dir), flows.train_if_possible(few)
    )


@query
def forecast_fallback(spark, sf_dir):
    """A market without prices, so every readable request gets the fallback."""
    priceless = views.market(spark, sf_dir).withColumn("price", F.lit(None).cast("double"))
    return baseline.forecast_bulk(views.requests(spark, sf_dir), priceless)


@query
def forecast_baseline(spark, sf_dir):
    asked = views.market(spark, sf_dir).select("row_id", F.col("timestamp").alias("target_time"))
    return baseline.forecast_baseline(asked, _recent(spark, sf_dir))


@query
def forecast_bulk(spark, sf_dir):
    return baseline.forecast_bulk(views.requests(spark, sf_dir), _recent(spark, sf_dir))


@query
def parse_request_ts(spark, sf_dir):
    return baseline.parse_requests(views.requests(spark, sf_dir))


@query
def eval_metrics(spark, sf_dir):
    return _rounded(evaluation.eval_metrics(views.predictions(spark, sf_dir)))


@query
def eval_baselines(spark, sf_dir):
    marked = modeldata.split_train_test(views.predictions(spark, sf_dir), _WINDOW_IDS)
    return _rounded(evaluation.eval_baselines(marked, ids=_WINDOW_IDS))


@query
def error_profile(spark, sf_dir):
    return _rounded(evaluation.error_profile(views.predictions(spark, sf_dir)))


@query
def pred_vs_actual(spark, sf_dir):
    return _rounded(evaluation.pred_vs_actual(views.predictions(spark, sf_dir)))


@query
def metric_history(spark, sf_dir):
    return _rounded(evaluation.metric_history(views.loss_history(spark, sf_dir)))


# Documents, retrieval, pairs, comparison


def _docs(spark, sf_dir):
    return documents.docs_all(
        documents.docs_observation(views.market(spark, sf_dir)),
        documents.docs_analysis(views.features(spark, sf_dir)),
    )


@query
def docs_observation(spark, sf_dir):
    return documents.docs_observation(views.market(spark, sf_dir))


@query
def docs_analysis(spark, sf_dir):
    return _rounded(documents.docs_analysis(views.features(spark, sf_dir)))


@query
def docs_all(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "text", "type", "timestamp", "settlement_point")


@query
def docs_upsert(spark, sf_dir):
    docs = documents.docs_observation(views.market(spark, sf_dir), keep=("row_id",))
    return documents.docs_upsert(docs, ("row_id",)).select("doc_id", "text", "price", "row_id")


@query
def encode_text(spark, sf_dir):
    texts = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return embedding.encode_text(texts).select(
        "doc_id", _joined(F.col("embedding"), lambda x: fixed(x, 6)).alias("vector")
    )


def _embedded(spark, sf_dir):
    texts = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return embedding.embed_documents(texts, views.counting_encoder, batch_by=F.floor(F.col("doc_id") / embedding.BATCH))


@query
def embed_documents(spark, sf_dir):
    return _embedded(spark, sf_dir).select(
        "doc_id", "failed", _joined(F.col("embedding"), lambda x: fixed(x, 1)).alias("vector")
    )


@query
def embedding_report(spark, sf_dir):
    return embedding.embedding_report(_embedded(spark, sf_dir))


@query
def vector_audit(spark, sf_dir):
    texts = views.table(spark, sf_dir, "documents").select("doc_id")
    return embedding.vector_audit(views.vectors(spark, sf_dir), texts, dimension=64)


def _hits(spark, sf_dir):
    return retrieval.cosine_topk(
        views.vectors(spark, sf_dir), views.query_vectors(spark, sf_dir)
    )


def _rendered(spark, sf_dir):
    metadata = views.vector_metadata(spark, sf_dir)
    return retrieval.render_hits(retrieval.attach_metadata(_hits(spark, sf_dir), metadata))


@query
def cosine_topk(spark, sf_dir):
    return _rounded(_hits(spark, sf_dir))


#: Share of the exact hits that the approximate search has to find.
_LEAST_RECALL = 0.9


def _compared(spark, sf_dir, near):
    """Whether hits of an approximate search are enough of the exact ones, and scored alike."""
    near = near.select("query_id", "doc_id", F.col("similarity").alias("near"))
    both = _hits(spark, sf_dir).join(near, ["query_id", "doc_id"], "left")
    return both.agg(
        F.countDistinct("query_id").alias("queries"),
        (F.avg(F.col("near").isNotNull().cast("int")) >= _LEAST_RECALL).alias("recall_reached"),
        F.coalesce(F.max(F.abs(F.col("near") - F.col("similarity"))) < 1e-9, F.lit(False)).alias("similarities_agree"),
    )


@query
def cosine_topk_lsh(spark, sf_dir):
    return _compared(
        spark, sf_dir, retrieval.cosine_topk_lsh(views.vectors(spark, sf_dir), views.query_vectors(spark, sf_dir))
    )


@query
def cosine_topk_ivf(spark, sf_dir):
    index = views.vector_index(spark, sf_dir)
    # the given vectors gather nowhere, so most cells have to be looked into
    near = ivf.cosine_topk_ivf(spark, index, views.query_vectors(spark, sf_dir), probe_share=0.7)
    return _compared(spark, sf_dir, near)


@query
def cosine_topk_ivf_exact(spark, sf_dir):
    index = views.vector_index(spark, sf_dir)
    return _rounded(ivf.cosine_topk_ivf(spark, index, views.query_vectors(spark, sf_dir), exact=True))


@query
def render_hits(spark, sf_dir):
    return _rendered(spark, sf_dir).select("query_id", "rank", "doc_id", "type", "doc_text")


@query
def response_context(spark, sf_dir):
    context = retrieval.response_context(_rendered(spark, sf_dir))
    return context.select("query_id", "retrieved_documents", F.inline("context_used"))


@query
def build_prompt(spark, sf_dir):
    questions = views.table(spark, sf_dir, "embeddings").groupBy(
        F.col("label").alias("query_id")
    ).agg(F.concat(F.lit("What is known about group "), F.max("label"), F.lit("?")).alias("question"))
    return retrieval.build_prompt(questions, _rendered(spark, sf_dir))


@query
def clean_answer(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    marked = F.when(
        F.col("turn") % 2 == 1, F.concat(F.lit("Q: again?\nA:"), F.col("text"))
    ).otherwise(F.col("text"))
    # Even turns have no mark; there the text repeats the prompt, its first word.
    prompt = F.substring_index("text", " ", 1)
    asked = turns.withColumns({"prompt": F.when(F.col("turn") % 2 == 0, prompt), "text": marked})
    answered = retrieval.clean_answers(asked, prompt="prompt")
    return answered.select("conv_id", "turn", "answer")


_MATCHED = ("settlement_point", "window_id", "target_price", *qa.MATCHED)


@query
def nearest_feature(spark, sf_dir):
    return intervals.nearest_feature(
        views.market(spark, sf_dir),
        views.features(spark, sf_dir),
        _MATCHED,
        tie_break=("settlement_point",),
    ).select("row_id", "timestamp", *(f"feature_{c}" for c in ("target_time", *_MATCHED)))


def _matched(spark, sf_dir):
    return intervals.nearest_feature(
        views.market(spark, sf_dir),
        views.features(spark, sf_dir),
        ("window_id", *qa.MATCHED),
        by=("settlement_point",),
    )


@query
def nearest_feature_by_point(spark, sf_dir):
    return _matched(spark, sf_dir).select(
        "row_id",
        "timestamp",
        "settlement_point",
        "feature_target_time",
        "feature_window_id",
        "feature_trend_slope",
    )


@query
def qa_price_forecast(spark, sf_dir):
    return qa.qa_price_forecast(_matched(spark, sf_dir), ("row_id",))


@query
def qa_dispatch(spark, sf_dir):
    return qa.qa_dispatch(views.market(spark, sf_dir), ("row_id",))


@query
def dispatch_recommendation(spark, sf_dir):
    return qa.dispatch_recommendation(views.market(spark, sf_dir)).select(
        "row_id", "price", "recommendation", "reason"
    )


@query
def qa_market_analysis(spark, sf_dir):
    return qa.qa_market_analysis(_matched(spark, sf_dir), ("row_id",))


@query
def qa_operational(spark, sf_dir):
    return qa.qa_operational(views.market(spark, sf_dir), ("row_id",))


@query
def qa_technical(spark, sf_dir):
    return qa.qa_technical(views.features(spark, sf_dir), _WINDOW_IDS)


@query
def qa_pairs(spark, sf_dir):
    return qa.qa_pairs(
        _matched(spark, sf_dir), views.features(spark, sf_dir), ("row_id",), _WINDOW_IDS
    )


@query
def qa_text(spark, sf_dir):
    pairs = qa.qa_pairs(
        _matched(spark, sf_dir), views.features(spark, sf_dir), ("row_id",), _WINDOW_IDS, shares=qa.ALL
    )
    return qa.qa_text(pairs).select("type", "pair_key", "text")


@query
def model_comparison(spark, sf_dir):
    return _rounded(comparison.model_comparison(views.scored_questions(spark, sf_dir)))


# Reports from daily summaries


@query
def ingest_stats_incremental(spark, sf_dir):
    _, store = views.summed_table(spark, sf_dir)
    times = views.market(spark, sf_dir).agg(F.count_distinct("timestamp")).scalar()
    off = F.abs(F.col("unique_timestamps") / times - 1)
    return daily.ingest_stats(spark, store).withColumn("times_within_error", off <= daily.ESTIMATE_ERROR).drop("unique_timestamps")


@query
def type_counts_incremental(spark, sf_dir):
    return daily.point_counts(spark, views.summed_table(spark, sf_dir)[1])


@query
def top_hub_incremental(spark, sf_dir):
    return daily.top_point(spark, views.summed_table(spark, sf_dir)[1])


@query
def points_in_both_spans(spark, sf_dir):
    store = views.summed_table(spark, sf_dir)[1]
    found = daily.points_in_both(spark, store, ("2024-01-01", "2024-01-10"), ("2024-01-20", "2024-01-31"))
    return found.select(F.col("points_in_both").cast("long").alias("points_in_both"))


@query
def median_incremental(spark, sf_dir):
    """The exact median, and whether that of the sketches is within their error."""
    table, store = views.summed_table(spark, sf_dir)
    near = daily.price_quantile(spark, table, store, exact=False).scalar()
    prices = spark.read.parquet(table)
    share = prices.agg(F.avg((F.col("price") <= near).cast("int"))).scalar()
    exact = daily.price_quantile(spark, table, store)
    return _rounded(exact.select(F.col("quantile").alias("median_price"), (F.abs(share - 0.5) <= quantiles.RANK_ERROR).alias("sketch_within_error")))


# Streaming


@query
def stream_ingest(spark, sf_dir):
    landing = shared_folder(spark, "landing")
    raw = views.pjm_raw(spark, sf_dir)
    raw.repartition(views.LANDED_FILES).write.csv(landing, header=True)
    records = market_stream.read_csv_stream(
        spark, landing, ", ".join(f"{c} string" for c in raw.columns), files_per_batch=1
    )
    table = shared_folder(spark, "ingested")
    market_stream.ingest_versions(
        records,
        lambda batch: normalize.conform(batch, normalize.PJM),
        table,
        shared_folder(spark, "ingest-state"),
        compact_at=3,
    ).awaitTermination()
    return _rounded(normalize.cleaned(versions.read_version(spark, table)))


@query
def stream_hourly(spark, sf_dir):
    table = shared_folder(spark, "hourly")
    stream = views.market_stream(spark, sf_dir)
    market_stream.hourly(stream, table, shared_folder(spark, "hourly-state")).awaitTermination()
    return _rounded(market_stream.hourly_means(spark, table))


@query
def stream_dedupe(spark, sf_dir):
    table = shared_folder(spark, "dedupe")
    stream = views.replayed_stream(spark, sf_dir)
    spread = stream_state.spread_for(views.market(spark, sf_dir).count())
    market_stream.drop_replays(stream, table, shared_folder(spark, "dedupe-state"), spread=spread).awaitTermination()
    return spark.read.parquet(table).select("iso", "settlement_point", "timestamp", "price")
