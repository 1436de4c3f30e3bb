from pyspark.sql import functions as F

from wattframe.sources import variants

MEMBERS = {
    "price": ("double", ("$.lmp", "$.LMP", "$.price.total")),
    "point": ("string", ("$.node", "$.location.id")),
}


def payloads(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "n int, value string")


def test_members_are_found_where_they_are(spark):
    rows = payloads(
        spark,
        '{"items":[{"lmp":1.5,"node":"A"},{"LMP":"2.5","location":{"id":7}}]}',
        '[{"price":{"total":3},"node":null},{"lmp":"n/a","LMP":4}]',
        '{"items":[],"data":[{"lmp":5,"node":"B"}],"Items":[{"lmp":9}]}',
    )
    got = variants.typed(variants.read_records(rows), MEMBERS).orderBy("n", "price").collect()
    assert [(r.n, r.price, r.point) for r in got] == [(0, 1.5, "A"), (0, 2.5, "7"), (1, 3.0, None), (1, 4.0, None), (2, 5.0, "B")]


def test_unreadable_payloads_are_told_apart_from_empty_ones(spark):
    rows = payloads(spark, '{"items":[{"lmp":1}', '{"items":[]}', "[]", "", None, "  ", '{"other":[1]}', "17", '{"items":"text"}', '{"data":[{}]}')
    found = variants.read_records(rows)
    assert sorted(r.n for r in found.where("unreadable").collect()) == [0, 6, 7, 8]
    assert [r.n for r in found.where("not unreadable").collect()] == [9]
    assert variants.typed(found, MEMBERS).first().price is None
    assert variants.read_records(payloads(spark)).count() == 0


def test_each_payload_is_parsed_once(spark):
    rows = variants.typed(variants.read_records(payloads(spark, '{"items":[{"lmp":1}]}').repartition(1)), MEMBERS)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange")[0]
    assert below.count("parse_json(") + below.count("ParseJson") <= 2


def test_changed_members_are_reported(spark):
    rows = payloads(spark, '[{"lmp":1,"node":"A"},{"lmp":2,"zone":"Z"}]', "[1]", "broken")
    records = variants.read_records(rows)
    report = {r.member: (r.n_records, r.known) for r in variants.member_report(records, MEMBERS).collect()}
    assert {k: v for k, v in report.items() if k} == {
        "lmp": (2, True), "LMP": (0, True), "price": (0, True), "node": (1, True), "location": (0, True), "zone": (1, False)
    }
    schema = variants.record_schema(records.where("n = 0")).first().record_schema
    assert "lmp" in schema and "zone" in schema
