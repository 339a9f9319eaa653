import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import documents as D
from plumbline.operators import documents as DO
from plumbline.sources.stores import json_documents

PAYLOAD = {"response": {"status_code": 200}, "status": "success",
           "data": {"user_id": 9, "items": ["a", "b"], "name": "Abcz", "score": 9.9, "note": None}}
RULES = [
    ("status", "equals", "success", "pass"), ("status", "equals", "failed", "fail"), ("data.user_id", "not null", "", "pass"),
    ("data.email", "exists", "", "fail"), ("data.email", "not exists", "", "pass"), ("data.items", "count at least", "1", "pass"),
    ("data.items", "count equals", "3", "fail"), ("data.items", "contains", "b", "pass"), ("data.name", "matches regex", "^A.*z$", "pass"),
    ("data.name", "matches regex", "([", "warn"), ("data.score", "greater than", "9.5", "pass"), ("data.name", "greater than", "1", "warn"),
    ("data.note", "is null", "", "pass"), ("data.note", "not empty", "", "fail"), ("data.items", "type is", "list", "pass"),
    ("response.status_code", "equals", "200", "pass"), ("data.user_id", "count at least", "1", "warn"), ("data.user_id", "bogus", "1", "warn"),
    ("data.email", "equals", "x", "fail"), ("data.user_id", "matches regex", "9", "warn"), ("data.user_id", "contains", "9", "warn"),
    ("data.items", "count equals", "two", "warn"), ("data", "type is", " Object ", "pass"),
]


def docs(spark, *texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id int, body string").withColumn("doc", D.parse(F.col("body"))).drop("body")


def test_rules(spark):
    df = docs(spark, json.dumps(PAYLOAD))
    got = DO.check_rules(df, "doc", [D.Rule(*r[:3]) for r in RULES]).orderBy("rule").collect()
    assert [r.status for r in got] == [r[3] for r in RULES]
    one_by_one = df.select(*[D.check_rule(F.col("doc"), D.Rule(*r[:3])).alias(f"r{i}") for i, r in enumerate(RULES)]).first()
    assert [(x.status, x.detail) for x in one_by_one] == [(r.status, r.detail) for r in got]
    detail = {(r.path, r.operator): r.detail for r in got}
    assert detail[("data.email", "exists")] == "field is not present"
    assert detail[("data.name", "greater than")] == "Abcz or '1' is not a number"


def test_status_code_column(spark):
    df = docs(spark, '{"a":1}', "[1,2]", '{"response":{"status_code":500}}').withColumn("code", F.lit(200))
    rules = [D.Rule("response.status_code", "equals", "200"), D.Rule("body", "type is", "list"), D.Rule("body[1]", "equals", "2")]
    got = {(r.id, r.rule): r.status for r in DO.check_rules(df, "doc", rules, status_code="code").collect()}
    assert [got[(i, 1)] for i in range(3)] == ["pass", "pass", "fail"]
    assert got[(1, 2)] == got[(1, 3)] == "pass" and got[(0, 2)] == "fail"


def test_missing_is_not_null(spark):
    df = docs(spark, '{"data":{"user":{"id":5,"tags":["a","b"]},"items":[{"sku":"X"}],"note":null}}')
    row = df.select(
        D.get_path(F.col("doc"), "data.items[0].sku").cast("string").alias("sku"),
        D.get_path(F.col("doc"), "data.items[3].sku").isNull().alias("absent"),
        D.get_path(F.col("doc"), "data.note").isNull().alias("note_absent"),
        F.is_variant_null(D.get_path(F.col("doc"), "data.note")).alias("note_null"),
    ).first()
    assert tuple(row) == ("X", True, False, True)


def test_flatten(spark):
    df = docs(spark, '{"a":{"b":[1,{"c":null}],"e":{}},"l":[]}', "[5]", "{}", '"x"')
    got = sorted((r.id, r.path, r.type) for r in D.flatten(df, "doc").collect())
    assert got == [
        (0, "a.b", "list"), (0, "a.b[0]", "number"), (0, "a.b[1].c", "null"), (0, "a.e", "object"), (0, "l", "list"),
        (1, "", "list"), (1, "[0]", "number"), (3, "", "string"),
    ]
    assert [r.path for r in D.flatten(docs(spark, '{"l":[1,2,3]}'), "doc", list_items=2).orderBy("path").collect()] == ["l", "l[0]", "l[1]"]


def test_bad_json_is_reported(spark):
    df = spark.createDataFrame([('{"a": 1,}',), ("{'a': 1}",), ("  ",), ('{"a":1}',), ("nope",)], "body string")
    got = [r.json_error for r in json_documents(df, "body").collect()]
    assert got == ["remove the comma before a closing } or ]", "JSON needs double quotes, not single quotes", "no JSON text", None, "not valid JSON"]


def test_field_verdicts(spark):
    df = docs(spark, '{"id":123,"email":"abc@gmail.com","status":"active","plan":"gold"}', '{"id":9}')
    table = spark.createDataFrame([(123, "ABC@gmail.com ", "pending", None), (123, "z", "z", "z")], "id bigint, email string, status string, mobile string")
    mapping = [{"api_field": "id", "db_column": "id"}, {"api_field": "email", "db_column": "email"}, {"api_field": "status", "db_column": "status"},
               {"api_field": "plan", "db_column": ""}, {"api_field": "mobile", "db_column": "mobile"}]
    got = DO.field_verdicts(df, "doc", table, ("id", "id"), mapping, keep=["id"])
    first = [(r.field, r.result, r.where) for r in got.filter("id = 0").collect()]
    assert first == [("id", "Match", ""), ("email", "Match", ""), ("status", "Mismatch", "API ≠ DB"), ("plan", "Missing in DB", "DB"), ("mobile", "Missing in API", "API")]
    assert {r.db_rows for r in got.filter("id = 0").collect()} == {2}
    assert all(r.result in ("Missing in DB", "Missing in API and DB") for r in got.filter("id = 1").collect())


def test_three_way_verdicts(spark):
    df = docs(spark, '{"id":1,"status":"active","email":"a","plan":"x","tier":"p"}')
    table = spark.createDataFrame([(1, "pending", "a", "x", "q")], "id bigint, status string, email string, plan string, tier string")
    mapping = [{"api_field": c, "db_column": c, "expected": e} for c, e in (("status", "active"), ("email", "A"), ("plan", "gold"), ("tier", "r"))]
    got = [r.where for r in DO.field_verdicts(df, "doc", table, ("id", "id"), mapping).collect()]
    assert got == ["DB differs from expected (API is correct)", "", "API and DB agree, but differ from expected", "API and DB both differ from expected"]


def test_auto_map(spark):
    fields = spark.createDataFrame([("data.userId",), ("data.email",), ("meta.page",), ("data.items[0].user_id",)], "path string")
    columns = spark.createDataFrame([("user_id", 1), ("email", 2), ("status", 3), ("userid", 4)], "col string, pos int")
    got = {r.api_field: r.db_column for r in DO.auto_map(fields, columns).collect()}
    assert got == {"data.userId": "user_id", "data.email": "email", "data.items[0].user_id": "user_id"}


@pytest.mark.parametrize("path, expected", [("", "$"), ("$", "$"), ("a.b[0].c", '$["a"]["b"][0]["c"]')])
def test_paths(path, expected):
    assert D.spark_path(path) == expected
