"""Market-shaped views over the given tables, used by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.operators.features import feature_matrix
from wattframe.operators.timeseries import prepare_hourly
from wattframe.operators.ivf import build_index
from wattframe.sources import daily
from wattframe.sources.tables import FORECAST_INPUTS, store_market
from wattframe.workspace import shared_folder

# Digits at which sums taken in different order agree.
CHECK_DIGITS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_market(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.lit(False).alias("repeat_hour_flag"),
        F.col("event_type").alias("settlement_point"),
        F.col("value").alias("price"),
        F.col("event_id").alias("row_id"),
    )


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as prices: the type is the point, the value the price."""
    return _as_market(table(spark, sf_dir, "events"))


def market_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stream = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf_dir)
    )
    return _as_market(stream).withColumn("iso", F.lit("ERCOT"))


def market_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market with missing, negative and wild prices and missing times at fixed rows."""
    slot = F.col("row_id") % 50
    price = F.col("price")
    return market(spark, sf_dir).withColumns(
        {
            "price": F.when(slot == 7, None)
            .when(slot == 13, -price)
            .when(slot == 21, price * 100)
            .otherwise(price),
            "timestamp": F.when(F.col("row_id") % 97 != 5, F.col("timestamp")),
        }
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_matrix(
        prepare_hourly(market(spark, sf_dir)), digits=CHECK_DIGITS, ratio_digits=CHECK_DIGITS
    )


def features_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with missing and infinite values at fixed windows."""
    window = F.col("window_id")
    return features(spark, sf_dir).withColumns(
        {
            "price_std": F.when(window % 7 != 3, F.col("price_std")),
            "momentum_1h": F.when(window % 11 != 0, F.col("momentum_1h")),
            "price_volatility": F.when(window % 13 == 5, F.lit(float("inf"))).otherwise(
                F.col("price_volatility")
            ),
        }
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six-hour mean as a forecast of the next hour."""
    return features(spark, sf_dir).select(
        "settlement_point",
        "window_id",
        "target_time",
        F.col("target_price").alias("actual"),
        F.col("price_ma_6").alias("predicted"),
    )


def _price_text() -> F.Column:
    """Price as feeds write it, with some unreadable entries."""
    return F.when(F.col("row_id") % 50 == 7, "n/a").otherwise(F.col("price").cast("string"))


def _around_clock_changes(ts: Column) -> Column:
    """Local times; each fortieth and the one after it are moved to the days of 2024 when New York's clocks change."""
    row = F.col("row_id")

    def on(day: str) -> Column:
        return F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(day))) + F.floor(row / 40) % 14_400)

    return F.when(ts.isNull(), None).when(row % 40 == 4, on("2024-11-03")).when(row % 40 == 5, on("2024-03-10")).otherwise(ts)


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local times around both changes of the clocks, some flagged as a second pass."""
    rows = market(spark, sf_dir)
    return rows.select(
        "row_id", _around_clock_changes(F.col("timestamp")).alias("local"), (F.col("row_id") % 3 == 0).alias("second_pass")
    )


def pjm_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = market_dirty(spark, sf_dir)
    return rows.select(
        F.date_format(_around_clock_changes(F.col("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("datetime_beginning_ept"),
        F.when(F.col("row_id") % 3 == 0, "true").otherwise("no").alias("repeat_hour_flag"),
        F.when(F.col("row_id") % 31 != 3, F.col("settlement_point")).alias("pnode_id"),
        _price_text().alias("total_lmp"),
        F.lit("ZONE").alias("type"),
    )


def miso_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times in three layouts, one of them with a zone, and a few unreadable ones."""
    ts, row = F.col("timestamp"), F.col("row_id")
    time = (
        F.when(row % 101 == 1, "soon")
        .when(row % 3 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(row % 3 == 1, F.date_format(ts, "M/d/yyyy H:mm:ss"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return market(spark, sf_dir).select(
        time.alias("LocalTime"),
        F.col("settlement_point").alias("Pnode"),
        _price_text().alias("LMP"),
        F.lit("LMP").alias("PriceType"),
    )


def miso_split_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date and minute in two columns."""
    return market(spark, sf_dir).select(
        F.date_format("timestamp", "yyyy-MM-dd").alias("MarketDate"),
        F.date_format("timestamp", "HH:mm").alias("MarketInterval"),
        F.col("settlement_point").alias("Node"),
        _price_text().alias("TotalLMP"),
    )


# Rows per feed payload, and per payload that is a file of its own.
_PAYLOAD_ROWS = 100
FILE_ROWS = 5000
# Files that a landed feed comes in.
LANDED_FILES = 5


def with_damaged(payloads: DataFrame) -> DataFrame:
    """Payloads with a cut-off copy of every seventh, which no reader can read."""
    cut = payloads.where(F.col("block") % 7 == 3)
    short = F.substring("value", F.lit(1), F.length("value") - 3)
    return payloads.unionByName(cut.withColumns({"value": short, "block": F.col("block") + 1_000_000}))


def one_file_each(payloads: DataFrame, path: str) -> None:
    payloads.select("block", "value").write.partitionBy("block").text(path)


def counting_encoder():
    """A stand-in for a model: length, words and lines of a text; texts beyond its window fail."""

    def encode(texts):
        if any(len(t) > 15_000 for t in texts):
            raise ValueError("text is longer than the model's window")
        return [[float(len(t)), float(len(t.split(" "))), float(t.count("\n") + 1)] for t in texts]

    return encode


def replayed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market landed in four files: late rows, replays, corrected prices, rows without a time and some from a year before."""
    landing = shared_folder(spark, "replays")
    time = F.when(F.col("row_id") % 97 == 5, None).when(
        F.col("row_id") % 1009 == 1, F.col("timestamp") - F.make_dt_interval(F.lit(400))
    )
    rows = market(spark, sf_dir).withColumns(
        {"iso": F.lit("ERCOT"), "timestamp": F.when(F.col("row_id") % 97 != 5, F.coalesce(time, "timestamp"))}
    )
    third = F.col("row_id") % 3
    corrected = rows.where(F.col("row_id") % 50 == 7).withColumn("price", F.col("price") + 1)
    for part in (rows.where(third == 1), rows.where(third != 2), rows.where(third == 2), corrected.unionByName(rows)):
        part.coalesce(1).write.mode("append").parquet(landing)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landing)


def _positional_payloads(
    spark: SparkSession, sf_dir: str, rows: int
) -> DataFrame:
    """One JSON text per hundred rows, rows being positional arrays."""
    ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    price = F.when(F.col("row_id") % 50 == 7, '"n/a"').otherwise(F.col("price").cast("string"))
    entry = F.format_string('["%s",false,"%s",%s]', ts, F.col("settlement_point"), price)
    payload = F.concat(
        F.lit('{"data":['), F.array_join(F.collect_list(entry), ","), F.lit("]}")
    )
    block = F.floor(F.col("row_id") / rows)
    return market(spark, sf_dir).groupBy(block.alias("block")).agg(payload.alias("value"))


def _envelope_payloads(spark: SparkSession, sf_dir: str, rows: int) -> DataFrame:
    """One JSON text per hundred rows, in five kinds of envelope."""
    record = F.to_json(
        F.struct(
            F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("datetime_beginning_ept"),
            F.col("settlement_point").alias("pnode_id"),
            F.col("price").alias("total_lmp"),
            F.lit("ZONE").alias("type"),
        )
    )
    block = F.floor(F.col("row_id") / rows)
    blocks = market(spark, sf_dir).groupBy(block.alias("block")).agg(
        F.array_join(F.collect_list(record), ",").alias("records")
    )
    envelopes = F.array(
        F.lit('{"items":[%s]}'),
        F.lit('{"data":[%s],"page":1}'),
        F.lit('{"Items":[%s]}'),
        F.lit("[%s]"),
        F.lit('{"items":[],"data":[%s]}'),
    )
    shape = F.get(envelopes, (F.col("block") % 5).cast("int"))
    return blocks.select("block", F.replace(shape, F.lit("%s"), F.col("records")).alias("value"))


def summed_table(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A table stored in three steps with its summaries, refreshed after each; the last step adds rows to old days."""
    table, store = shared_folder(spark, "market"), shared_folder(spark, "summaries")
    rows = market(spark, sf_dir).withColumn("price", F.when(F.col("row_id") % 50 != 7, F.col("price")))
    held_back = F.col("row_id") % 1000 == 17
    half = F.to_timestamp(F.lit("2024-01-16"))
    for step in (~held_back & (F.col("timestamp") < half), ~held_back & (F.col("timestamp") >= half), held_back):
        store_market(rows.where(step), table)
        daily.refresh(spark, table, store)
    return table, store


# Trees and depth of a forest made by rule.
GIVEN_TREES, GIVEN_DEPTH = 7, 4


def given_forest(spark: SparkSession) -> DataFrame:
    """Nodes of a forest that nothing is trained for: complete trees with inputs, thresholds and values by rule."""
    inner, every = 2**GIVEN_DEPTH - 1, 2 ** (GIVEN_DEPTH + 1) - 1
    numbers = spark.range(GIVEN_TREES * every).select(
        F.floor(F.col("id") / every).cast("int").alias("tree"), (F.col("id") % every).cast("int").alias("node")
    )
    split = F.col("node") < inner
    place = (F.col("tree") * 5 + F.col("node") * 7) % len(FORECAST_INPUTS)
    return numbers.select(
        "tree",
        "node",
        F.when(split, F.get(F.array(*map(F.lit, FORECAST_INPUTS)), place)).alias("input"),
        F.when(split, F.lit(10.0)).alias("shift"),
        F.when(split, F.lit(4.0)).alias("scale"),
        F.when(split, (F.col("tree") * 11 + F.col("node") * 3) % 17 / 2.0 - 4.0).alias("threshold"),
        F.when(split, 2 * F.col("node") + 1).otherwise(-1).alias("left"),
        F.when(split, 2 * F.col("node") + 2).otherwise(-1).alias("right"),
        ((F.col("tree") * 17 + F.col("node") * 29) % 90 + 10.0).alias("value"),
    )


def drifting_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enveloped responses whose records change: as they were, with members moved into others, with members renamed."""
    ts = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    point, price = F.col("settlement_point"), F.col("price")
    kinds = F.array(
        F.to_json(F.struct(ts.alias("datetime_beginning_ept"), point.alias("pnode_id"), price.alias("total_lmp"), F.lit("ZONE").alias("type"))),
        F.to_json(
            F.struct(
                ts.alias("datetime_beginning_ept"),
                F.struct(point.alias("id"), F.lit("ZONE").alias("kind")).alias("node"),
                F.struct(price.alias("total")).alias("lmp"),
            )
        ),
        F.to_json(F.struct(ts.alias("DateTime"), point.alias("pnode_id"), price.cast("string").alias("LMP"), F.lit(1).alias("rev"))),
    )
    block = F.floor(F.col("row_id") / _PAYLOAD_ROWS)
    records = market(spark, sf_dir).select(block.alias("block"), F.get(kinds, (F.floor(F.col("row_id") / 7) % 3).cast("int")).alias("r"))
    blocks = records.groupBy("block").agg(F.array_join(F.collect_list("r"), ",").alias("records"))
    shapes = F.array(F.lit('{"items":[%s]}'), F.lit('{"items":[],"data":[%s]}'), F.lit("[%s]"), F.lit('{"Items":[%s],"page":{"n":1}}'))
    shape = F.get(shapes, (F.col("block") % 4).cast("int"))
    return with_damaged(blocks.select("block", F.replace(shape, F.lit("%s"), F.col("records")).alias("value")))


_kept: dict[tuple, DataFrame] = {}


def _fixture(spark: SparkSession, sf_dir: str, make, rows: int) -> DataFrame:
    """A fixture as it was written by ``keep_fixtures``, else made anew."""
    key = (spark.sparkContext.applicationId, sf_dir, make.__name__, rows)
    return _kept[key] if key in _kept else make(spark, sf_dir, rows)


def keep_fixtures(spark: SparkSession, sf_dir: str) -> None:
    """Write the payload fixtures, so that queries timed later only read them."""
    for make in (_positional_payloads, _envelope_payloads):
        path = shared_folder(spark, "fixture")
        make(spark, sf_dir, _PAYLOAD_ROWS).write.parquet(path)
        key = (spark.sparkContext.applicationId, sf_dir, make.__name__, _PAYLOAD_ROWS)
        _kept[key] = spark.read.parquet(path)


def positional_payloads(spark: SparkSession, sf_dir: str, rows: int = _PAYLOAD_ROWS) -> DataFrame:
    return _fixture(spark, sf_dir, _positional_payloads, rows)


def envelope_payloads(spark: SparkSession, sf_dir: str, rows: int = _PAYLOAD_ROWS) -> DataFrame:
    return _fixture(spark, sf_dir, _envelope_payloads, rows)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecast requests in the accepted forms, and some unreadable ones."""
    ts, row = F.col("timestamp"), F.col("row_id")
    text = (
        F.when(row % 9 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(row % 9 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(row % 9 == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(row % 9 == 3, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(row % 9 == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(row % 9 == 5, F.date_format(ts, "yyyy-MM-dd'T'HH"))
        .when(row % 9 == 6, F.date_format(ts, "yyyyMMdd'T'HHmmss"))
        .when(row % 9 == 7, F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))
        .otherwise("nope")
    )
    return market(spark, sf_dir).select("row_id", text.alias("requested"))


def loss_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loss pair per type and day, standing in for runs and epochs."""
    rows = market(spark, sf_dir)
    return rows.groupBy(
        F.col("settlement_point").alias("run"), F.dayofmonth("timestamp").alias("epoch")
    ).agg(F.avg("price").alias("train_loss"), F.stddev_pop("price").alias("val_loss"))


def scored_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question per type and hour of day with two scores."""
    rows = market(spark, sf_dir)
    hour = F.date_format("timestamp", "HH")
    return rows.groupBy(
        F.col("settlement_point").alias("run"),
        F.concat(F.lit("How was "), F.col("settlement_point"), F.lit(" at "), hour, F.lit("?")).alias(
            "question"
        ),
    ).agg(
        F.avg("price").alias("base_perplexity"),
        F.stddev_pop("price").alias("fine_tuned_perplexity"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), "embedding", "label"
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label as a query."""
    places = vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("pos", "x"))
    means = places.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One entry per vector dimension.
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(ordered, lambda e: e["x"]).alias("embedding")
    )


_indexes: dict[tuple, str] = {}


def vector_index(spark: SparkSession, sf_dir: str) -> str:
    """The inverted-file index of the vectors, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = shared_folder(spark, "ivf")
        build_index(vectors(spark, sf_dir), path)
        _indexes[key] = path
    return _indexes[key]


def vector_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata for vectors, from the market row of the same number; some of it missing."""
    rows = market(spark, sf_dir)
    labelled = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    label = F.col("label")
    return labelled.join(rows, "row_id", "left").select(
        F.col("row_id").alias("doc_id"),
        F.when(label < 5, "market_observation")
        .when(label < 8, "market_analysis")
        .when(label < 9, "note")
        .alias("type"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm").alias("timestamp"),
        F.when(label % 2 == 0, F.col("settlement_point")).alias("settlement_point"),
        F.when(label != 3, F.col("price")).alias("price"),
        F.when(label != 6, F.col("price")).alias("target_price"),
        F.when(F.col("price") < 20, "low price").alias("price_level"),
        F.when(F.col("price") > 20, "increasing").alias("trend_direction"),
    )


def vector_store_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector stores as JSON texts of 64 vectors each."""
    rows = vectors(spark, sf_dir).withColumn("id", F.concat(F.lit("v"), F.col("doc_id")))
    block = F.floor(F.col("doc_id") / 64)
    vector = F.struct("id", F.col("embedding").cast("array<double>"))
    meta = F.struct("id", F.create_map(F.lit("label"), F.col("label").cast("string")))
    stores = rows.groupBy(block.alias("block")).agg(
        F.map_from_entries(F.collect_list(vector)).alias("vectors"),
        F.map_from_entries(F.collect_list(meta)).alias("metadata"),
        F.count("*").alias("n"),
    )
    info = F.create_map(F.lit("vector_count"), F.col("n").cast("string"))
    return stores.select(
        F.to_json(F.struct("vectors", "metadata", info.alias("info"))).alias("value")
    )
