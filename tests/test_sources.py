import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wattframe.functions.times import parse_feed_time
from wattframe.sources import evaluation, feeds, normalize, tables, vectors


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_positional_rows_and_bad_price(spark):
    payload = json.dumps(
        {
            "data": [
                ["2025-07-31T00:30:00", False, "HB_NORTH", 32.61],
                ["2025-07-31T00:35:00", True, "HB_SOUTH", "bad"],
            ]
        }
    )
    rows = feeds.parse_positional(texts(spark, payload)).orderBy("timestamp").collect()
    assert rows[0].asDict() == {
        "timestamp": datetime(2025, 7, 31, 0, 30),
        "repeat_hour_flag": False,
        "settlement_point": "HB_NORTH",
        "price": 32.61,
    }
    assert rows[1].price is None and rows[1].repeat_hour_flag is True


def test_positional_bad_time_fails(spark):
    payload = json.dumps({"data": [["not a time", False, "HB", 1.0]]})
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|CAST_INVALID_INPUT"):
        feeds.parse_positional(texts(spark, payload)).collect()


@pytest.mark.parametrize(
    "payload, expected",
    [
        ('{"items":[{"a":"1"}]}', ["1"]),
        ('{"data":[{"a":"2"}]}', ["2"]),
        ('{"Items":[{"a":"3"}]}', ["3"]),
        ('[{"a":"4"},{"a":"5"}]', ["4", "5"]),
        ('{"items":[],"data":[{"a":"6"}]}', ["6"]),
        ('{"items":[{"a":"7"}],"Items":[{"a":"8"}]}', ["7"]),
        ('{"other":[{"a":"9"}]}', []),
    ],
)
def test_envelopes(spark, payload, expected):
    rows = feeds.unwrap_envelope(texts(spark, payload), "a string").collect()
    assert [r.a for r in rows] == expected


@pytest.mark.parametrize("payload", ['{"items":[{"a":"1"},{"a"', '[{"a":"1"},', "no json", '{"items":{"a":"1"}}'])
def test_unreadable_payloads_fail_or_are_reported(spark, payload):
    both = texts(spark, '{"items":[{"a":"1"}]}').unionByName(texts(spark, payload))
    with pytest.raises(Exception, match="no readable JSON"):
        feeds.unwrap_envelope(both, "a string").collect()
    assert [r.a for r in feeds.unwrap_envelope(both, "a string", skip_bad=True).collect()] == ["1"]
    assert [r.value for r in feeds.bad_payloads(both).collect()] == [payload]
    cut = texts(spark, '{"data":[["2025-07-31T00:30:00",false,"HB",1.0],["2025')
    with pytest.raises(Exception, match="no readable JSON"):
        feeds.parse_positional(cut).collect()
    assert feeds.parse_positional(cut, skip_bad=True).isEmpty()


def test_vector_store_is_read_in_linear_steps(spark):
    store = {"vectors": {f"v{i}": [float(i)] for i in range(300)}, "metadata": {f"v{i}": {"n": str(i)} for i in range(0, 400, 2)}}
    rows = {r.doc_id: r for r in vectors.vectors_from_map(texts(spark, json.dumps(store), json.dumps(store))).collect()}
    assert len(rows) == 300 and rows["v4"].metadata == {"n": "4"} and rows["v5"].metadata is None
    assert rows["v7"].embedding == [7.0]


def test_miso_envelope_has_no_capital_items(spark):
    rows = feeds.unwrap_envelope(texts(spark, '{"Items":[{"a":"3"}]}'), "a string", keys=("items", "data"))
    assert rows.count() == 0


def test_read_feed_formats_and_empty(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"items": [\n{"LMP": "3.5"},\n{"LMP": "4"}]}')
    (tmp_path / "none.json").write_text('{"items": []}')
    (tmp_path / "rows.csv").write_text("LMP,Pnode\n3.5,A\nx,B\n")
    assert feeds.read_feed(spark, str(tmp_path / "one.json"), "LMP string").count() == 2
    rows = feeds.read_feed(spark, str(tmp_path / "rows.csv"), "LMP string, Pnode string", "csv")
    assert {r.Pnode for r in rows.collect()} == {"A", "B"}
    with pytest.raises(ValueError, match="no rows"):
        feeds.read_feed(spark, str(tmp_path / "none.json"), "LMP string")
    with pytest.raises(ValueError, match="unknown feed format"):
        feeds.read_feed(spark, str(tmp_path / "rows.csv"), "LMP string", "xml")


def test_find_column_prefers_names_then_parts():
    assert normalize.find_column(["X", "Total_LMP", "LMP"], ("lmp", "total_lmp")) == "LMP"
    assert normalize.find_column(["X", "rt_lmp_value"], ("lmp",), ("lmp",)) == "rt_lmp_value"
    assert normalize.find_column(["X"], ("lmp",), ("lmp",)) is None


def test_pjm_normalised(spark):
    raw = spark.createDataFrame(
        [
            ("2025-07-31 00:00:00", 51217, "30.5", "ZONE"),
            ("2025-07-31 01:00:00", 51217, None, "ZONE"),
            ("2025-07-31 02:00:00", None, "9000", None),
            ("whenever", 51217, "1", "ZONE"),
        ],
        "datetime_beginning_ept string, pnode_id bigint, total_lmp string, type string",
    )
    df = normalize.normalize_pjm(raw)
    assert tuple(df.columns) == normalize.COMMON_COLUMNS
    rows = df.orderBy("timestamp").collect()
    assert [r.timestamp.hour for r in rows] == [4, 5, 6]
    assert [r.price for r in rows] == [30.5, 30.5, 5000.0]
    assert rows[2].settlement_point == rows[2].location_id == "PJM_UNKNOWN"
    assert rows[2].location_type == "PNODE" and rows[0].location_type == "ZONE"
    assert {r.iso for r in rows} == {"PJM"} and not any(r.repeat_hour_flag for r in rows)


def test_staged_feed_gives_the_same(spark, tmp_path):
    raw = spark.createDataFrame(
        [("2025-07-31 00:00:00", "A", "5"), ("2025-07-31 01:00:00", "A", "x")],
        "LocalTime string, Pnode string, LMP string",
    )
    direct = normalize.normalize_miso(raw).collect()
    staged = normalize.normalize_miso(raw, landed=str(tmp_path / "s")).collect()
    assert sorted(direct) == sorted(staged) and len(direct) == 2


def test_utc_column_and_zoned_value_are_not_shifted_twice(spark):
    raw = spark.createDataFrame(
        [("2025-07-31 10:00:00", "5")], "datetime_beginning_utc string, rt_lmp_value string"
    )
    row = normalize.normalize_pjm(raw).first()
    assert row.timestamp.hour == 10 and row.settlement_point == "PJM_UNKNOWN"
    zoned = spark.createDataFrame(
        [("2025-07-31T10:00:00-04:00", "5"), ("2025-07-31T10:00:00Z", "5")],
        "datetime_beginning_ept string, lmp string",
    )
    hours = [r.timestamp.hour for r in normalize.normalize_pjm(zoned).orderBy("timestamp").collect()]
    assert hours == [10, 14]


def test_miso_whole_and_split_time(spark):
    whole = spark.createDataFrame(
        [("7/31/2025 1:05 PM", "A", "5", "LMP")], "LocalTime string, Pnode string, LMP string, PriceType string"
    )
    assert normalize.normalize_miso(whole).first().timestamp == datetime(2025, 7, 31, 18, 5)
    split = spark.createDataFrame(
        [("2025-07-31", "13:05", "A", "5")],
        "MarketDate string, MarketInterval string, Node string, TotalLMP string",
    )
    row = normalize.normalize_miso(split).first()
    assert row.timestamp == datetime(2025, 7, 31, 18, 5)
    assert row.location_type == "PNODE" and row.settlement_point == "A"


def test_daylight_saving_rows(spark):
    raw = spark.createDataFrame(
        [("2024-03-10 02:30:00", "1"), ("2024-11-03 01:30:00", "1")],
        "datetime_beginning_ept string, lmp string",
    )
    stamps = [r.timestamp for r in normalize.normalize_pjm(raw).orderBy("timestamp").collect()]
    assert stamps == [datetime(2024, 3, 10, 7, 30), datetime(2024, 11, 3, 5, 30)]


@pytest.mark.parametrize(
    "text, expected",
    [("2025-07-31 13", datetime(2025, 7, 31, 13)), ("7/31/2025", datetime(2025, 7, 31)),
     ("7/31/2025 13", datetime(2025, 7, 31, 13)), ("07/31/2025 13:05:09", datetime(2025, 7, 31, 13, 5, 9)),
     ("7/31/2025 1:05 PM", datetime(2025, 7, 31, 13, 5)), ("20250731 13:05", datetime(2025, 7, 31, 13, 5)),
     ("2025-07-31 24", None), ("soon", None)],
)
def test_feed_time_layouts(spark, text, expected):
    row = texts(spark, text).select(parse_feed_time(F.col("value")).alias("t")).first()
    assert row.t == expected


def test_unknown_columns_fail(spark):
    with pytest.raises(ValueError, match="time column"):
        normalize.normalize_pjm(spark.createDataFrame([("1",)], "lmp string"))
    with pytest.raises(ValueError, match="price column"):
        normalize.normalize_miso(spark.createDataFrame([("1",)], "timestamp string"))


def test_union_keeps_columns(spark):
    raw = spark.createDataFrame([("2025-07-31 00:00:00", "5")], "timestamp string, price string")
    both = normalize.union_feeds(normalize.normalize_pjm(raw), normalize.normalize_miso(raw))
    assert tuple(both.columns) == normalize.COMMON_COLUMNS
    assert {r.iso for r in both.collect()} == {"PJM", "MISO"}


def test_sinks_count_and_audit(spark, prices, tmp_path):
    rows = prices([("2025-07-31 00:00:00", 1.0), ("2025-07-31 01:00:00", 2.0)])
    path = str(tmp_path / "t")
    first = tables.sink_append(rows, path).first()
    assert (first.rows_before, first.total_rows, first.rows_added) == (0, 2, 2)
    second = tables.sink_append(rows.limit(1), path).first()
    assert (second.rows_before, second.total_rows, second.rows_added) == (2, 3, 1)
    assert tables.sink_audit(rows, spark.read.parquet(path)).first().rows_match is False
    assert tables.sink_audit(rows, tables.sink_replace(rows, path)).first().rows_match is True


def test_days_back_is_closed_on_both_ends(spark, prices):
    rows = prices(
        [("2025-07-24 12:00:00", 1.0), ("2025-07-24 11:59:59", 2.0), ("2025-07-31 12:00:00", 3.0),
         ("2025-07-31 12:00:01", 4.0)]
    )
    kept = tables.scan_days_back(rows, F.to_timestamp(F.lit("2025-07-31 12:00:00")), 7)
    assert sorted(r.price for r in kept.collect()) == [1.0, 3.0]


def test_vector_map(spark, tmp_path):
    store = {
        "vectors": {"a": [1.0, 2.0], "b": [0.0, 1.0]},
        "metadata": {"a": {"type": "market_observation"}},
        "info": {"vector_count": 2},
    }
    (tmp_path / "v.json").write_text(json.dumps(store, indent=1))
    rows = {r.doc_id: r for r in vectors.read_vector_map(spark, str(tmp_path / "v.json")).collect()}
    assert rows["a"].embedding == [1.0, 2.0] and rows["a"].metadata["type"] == "market_observation"
    assert rows["b"].metadata is None
    info = vectors.sink_vectors(
        vectors.read_vector_map(spark, str(tmp_path / "v.json")), str(tmp_path / "out"), "m"
    ).first()
    assert (info.vector_count, info.dimension, info.embedding_model) == (2, 2, "m")


def test_eval_report_file(spark, tmp_path):
    report = {
        "evaluation_timestamp": "2025-07-31T07:38:40",
        "test_passed": False,
        "summary_statistics": {"avg_base_perplexity": 54.03, "total_questions": 1},
        "detailed_results": [
            {"question": "q", "base_perplexity": 54.9, "fine_tuned_perplexity": 120.9,
             "improvement": -66.0, "improved": False}
        ],
    }
    (tmp_path / "r.json").write_text(json.dumps(report, indent=2))
    stored = evaluation.read_eval_report(spark, str(tmp_path / "r.json"))
    assert stored.first().summary_statistics.total_questions == 1
    question = evaluation.report_questions(stored).first()
    assert question.question == "q" and question.improved is False
