"""Joins of text keys with whole numbers."""

from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.operators import links as LK
from plumbline.operators import rules as R
from plumbline.operators import timeline as TL
from plumbline.sources.environment import Link

_ODD = ["5", " 5", "+5", "5.0", "5e0", "05", "5.5", "5.0000000001", "-0", "0", "x5", "5x", "", " ", "٥", "9223372036854775807", "9223372036854775808",
        "-9223372036854775808", "1e400", "NaN", "_5", ".5e1", "\t5\n", None]


def _settled(spark, build):
    """What ``build`` returns without changes of the plan at run time and without broadcasts."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {n: spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        return build()
    finally:
        for n, v in held.items():
            spark.conf.set(n, v)


def test_text_meets_the_number_it_equals_as_a_decimal(spark):
    texts = spark.createDataFrame([(t,) for t in _ODD], "t string")
    numbers = spark.createDataFrame([(5,), (0,), (9223372036854775807,), (-9223372036854775808,), (None,)], "n bigint")
    decimal = F.col("t").try_cast("decimal(38,9)") == F.col("n").try_cast("decimal(38,9)")
    for how in ("inner", "left_semi", "left_anti"):
        want, got = texts.join(numbers, decimal, how).collect(), V.raw_join(texts, "t", numbers, "n", how).collect()
        assert sorted(want, key=str) == sorted(got, key=str)
    small = numbers.where("n < 100 AND n > -100").select(F.col("n").cast("int").alias("n"))
    assert {r.t for r in V.raw_join(texts, "t", small, "n", "left_semi").collect()} == {"5", " 5", "+5", "5.0", "5e0", "05", "5.0000000001", "-0", "0", "٥", ".5e1", "\t5\n"}


def test_texts_that_are_no_numbers_are_dealt_over_tasks(spark):
    child = spark.range(400).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("k"))
    parent = spark.range(10).select(F.col("id").alias("p"))
    def build():
        out = R.orphan_counts(child, "k", parent, "p")
        return out.select("*", F.spark_partition_id().alias("at")).collect()
    rows = _settled(spark, build)
    assert len(rows) == 400 and {r.child_rows for r in rows} == {1}
    assert len({r["at"] for r in rows}) == 4


def test_joins_sort_by_keys_that_are_columns(spark, env_of):
    env = env_of(orders=([(1,), (2,)], "o bigint"), lines=([("1", "2020-01-01"), ("x2", "2020-01-02")], "k string, day string"))
    env = env.with_tables(lines=env.table("lines").withColumn("day", F.to_date("day")))
    def build():
        out = TL.linked_timeline(env, "orders", env.table("orders"), "o", [Link("lines", "k", "orders", "o")])
        return out.collect(), out._jdf.queryExecution().executedPlan().toString()
    rows, plan = _settled(spark, build)
    assert [(r.record, r.row) for r in rows] == [("1", "k=1")]
    for line in plan.splitlines():
        if "SortMergeJoin" in line or "hashpartitioning" in line:
            assert "cast" not in line.lower()


def test_spellings_of_a_number_that_no_key_holds_stay_one_value(env_of):
    env = env_of(lines=([("5.5",), ("5.50",), ("7",), ("07",), ("x",), ("1",)], "k string"), orders=([(1,), (3,)], "o bigint"))
    row = LK.verify_link(env, Link("lines", "k", "orders", "o")).first()
    assert (row.matched_rows, row.orphan_rows, row.orphan_values, row.unused_parents) == (1, 5, 3, 1)


def test_rules_deal_texts_that_are_no_numbers_too(spark, env_of):
    env = env_of(parents=([(1,), (2,)], "p bigint"))
    env = env.with_tables(lines=spark.range(400).select(F.when(F.col("id") < 3, F.col("id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("id").cast("string"))).alias("k")))
    spec = {"source": {"table": "lines", "key": "k"}, "target": {"table": "parents", "key": "p"}, "expect": "exists"}
    rows = _settled(spark, lambda: R.rule_failures(env, spec).select("k", F.spark_partition_id().alias("at")).collect())
    assert len(rows) == 398 and "0" in {r.k for r in rows} and len({r["at"] for r in rows}) == 4
