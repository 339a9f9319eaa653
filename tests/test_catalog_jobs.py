"""Scans of whole catalogs, identifiers of a frame, profiles in parts, batches side by side, stores."""

import threading

import pytest
from pyspark.sql import functions as F

from plumbline import Env
from plumbline.operators import checks as CH
from plumbline.operators import compare as CM
from plumbline.operators import profile as PF
from plumbline.operators import profile_store as PS
from plumbline.operators import search as S
from plumbline.operators import testdata as TD
from plumbline.operators.value_filter import value_filter
from plumbline.sources import stores
from plumbline.sources.environment import Link


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_value_filter_passes_all_values_and_few_others(spark):
    wanted = spark.range(0, 30_000, 3).select(F.col("id").cast("string").alias("value"))
    tested = spark.range(30_000).select("id", value_filter(wanted)(F.col("id").cast("string")).alias("passes"))
    got = tested.groupBy((F.col("id") % 3 == 0).alias("wanted")).agg(F.count_if("passes").alias("n")).collect()
    found = {r.wanted: r.n for r in got}
    assert found[True] == 10_000 and found[False] < 0.05 * 20_000


@pytest.mark.parametrize("values", [[], [None], ["5"]])
def test_value_filter_of_few_values(spark, values):
    wanted = spark.createDataFrame([(v,) for v in values], "value string")
    got = spark.range(2000).filter(value_filter(wanted)(F.col("id").cast("string"))).count()
    assert got == 0 if values != ["5"] else 1 <= got < 400


def test_identifiers_of_a_frame(spark, env_of):
    env = env_of(a=([(1, "x"), (1, None), (2, "7"), (9, "1")], "i long, t string"), b=([(1,)] * 50 + [(None,)], "k int"))
    ids = spark.createDataFrame([(1,), (7,), (7,), (None,)], "id long")
    found = S.search_ids(env, ids, "id", {"a": ["i", "t"], "b": ["k"]})
    assert rows(found, "value", "tbl", "col", "matches") == [("1", "a", "i", 2), ("1", "a", "t", 1), ("1", "b", "k", 50), ("7", "a", "t", 1)]
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("getbit") and "SortAggregate" not in text


def test_generated_links_use_every_parent(spark, env_of):
    env = env_of(p=([(i,) for i in range(3000)] + [(5,), (None,)], "id long"), c=([(1, 1)], "id long, p_id long"))
    env = Env(env.spark, env.loaders, links=(Link("c", "p_id", "p", "id"),))
    made = TD.generate_rows(env, "c", "valid", 6001)
    used = {r.p_id: r.n for r in made.groupBy("p_id").agg(F.count("*").alias("n")).collect()}
    assert set(used) == set(range(3000)) and sorted(used.values()) == [2] * 2999 + [3]
    keys, total = TD.numbered_keys(env.table("p").select(F.col("id").alias("k")))
    assert sorted(r.position for r in keys.collect()) == list(range(3000)) and keys.select(total.alias("n")).first().n == 3000


def test_personal_data_of_parts_adds_up(spark):
    def table(a, b):
        text = F.when(F.col("id") % 4 == 0, F.concat(F.lit("m"), (F.col("id") % 400).cast("string"), F.lit("@x.org"))).when(F.col("id") % 4 == 1, "password=abc").otherwise("plain")
        return spark.range(a, b).select("id", text.alias("note"), F.lit("x").alias("api_token"))

    whole = PF.pii_merged(PF.pii_parts(table(0, 4000)))
    halves = PF.pii_merged(PF.pii_parts(table(0, 1500)).unionByName(PF.pii_parts(table(1500, 4000))))
    exact = ["column", "named", "detector", "rows", "hits"]
    assert rows(whole, *exact) == rows(halves, *exact)
    assert ("note", "", "email", 4000, 1000) in rows(whole, *exact) and ("api_token", "secret", "email", 4000, 0) in rows(whole, *exact) and ("id", "", "", 4000, 0) in rows(whole, *exact)
    found = {(r.column, r.detector): r.distinct_texts for r in halves.collect()}
    assert abs(found["note", "email"] - 100) <= 5 and found["note", "secret"] == 1 and found["id", ""] == 0


def test_profiles_of_parts_merge(spark, tmp_path):
    def table(a, b):
        return spark.range(a, b).select(
            "id", F.when(F.col("id") % 5 != 0, F.col("id") * 1.5).alias("x"), F.when(F.col("id") % 3 != 0, F.concat(F.lit("n"), (F.col("id") % 1000).cast("string"))).otherwise("").alias("t"),
            F.lit("s").alias("password"), F.array("id").alias("nested"))

    files, path = str(tmp_path / "table"), str(tmp_path / "profile")
    table(0, 4000).coalesce(2).write.parquet(files)
    first = PS.merged_profile(PS.update_profile(spark.read.parquet(files), path, stored=False))
    assert {r.column: r.rows for r in first.collect()} == {"id": 4000, "x": 4000, "t": 4000, "nested": 4000}
    table(4000, 10_000).coalesce(1).write.mode("append").parquet(files)
    parts = PS.update_profile(spark.read.parquet(files), path)
    assert parts.select("part").distinct().count() == 3 and parts.count() == 12
    merged = {r.column: r for r in PS.merged_profile(parts).collect()}
    whole = {r.column: r for r in PS.merged_profile(PS.profile_parts(table(0, 10_000), F.lit("all"))).collect()}
    exact = ["rows", "nulls", "empty", "smallest", "largest", "shortest", "longest"]
    for c, r in whole.items():
        assert [r[k] for k in exact] == [merged[c][k] for k in exact]
    assert (merged["x"].nulls, merged["x"].largest, merged["t"].empty, merged["t"].longest, merged["nested"].distinct_values) == (2000, 9999 * 1.5, 3334, 4, 0)
    assert abs(merged["id"].distinct_values - 10_000) < 500 and abs(merged["t"].distinct_values - 1001) < 60
    assert all(abs(merged["id"][f"q{q}"] - q * 100) < 150 for q in (25, 50, 75))
    again = PS.update_profile(spark.read.parquet(files), path)
    assert again.count() == 12


def test_batches_of_two_environments_at_once(spark, env_of):
    """Each batch sees its own tables; a view of the caller of that name stays as it is."""
    spark.range(99).createOrReplaceTempView("t")
    spark.conf.set("spark.sql.ansi.enabled", spark.conf.get("spark.sql.ansi.enabled"))
    envs = {n: env_of(t=([(i,) for i in range(n)], "i int")) for n in (3, 40)}
    checks = [{"id": f"c{k}", "sql": "SELECT * FROM t", "expect": "info"} for k in range(6)]
    found = {}

    def batch(n):
        found[n] = [r.result_rows for r in CH.run_checks(envs[n], checks, connection=str(n)).collect()]

    threads = [threading.Thread(target=batch, args=(n,)) for n in envs]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert found == {3: [3] * 6, 40: [40] * 6} and spark.table("t").count() == 99
    assert not [t for t in spark.catalog.listTables("global_temp") if t.name.startswith("batch_")]
    spark.catalog.dropTempView("t")


def test_batch_summary_names_the_checks(env_of):
    env = env_of(t=([(1,), (2,)], "i int"))
    checks = [{"id": "bad", "sql": "SELECT * FROM t", "alerts": ["rows > 1"]}, {"id": "good", "sql": "SELECT * FROM t WHERE i > 5"},
              {"id": "gone", "sql": "SELECT nothing FROM t"}, {"id": "broken", "sql": "SELECT * FROM nowhere", "alerts": ["query failed"]}]
    got = CH.batch_summary(CH.run_checks(env, checks)).first()
    assert tuple(got) == (4, 1, ["bad"], ["broken", "gone"], ["bad", "broken"])


def test_filtered_differences(spark):
    diff = spark.createDataFrame([("Missing column", "Users", "email"), ("Type differs", "users", "id"), ("Missing column", "orders", "x")], 'difference string, `table` string, `column` string')
    assert rows(CM.filter_differences(diff, ["Missing column"], "USERS."), "column") == [("email",)] and CM.filter_differences(diff).count() == 3


def test_sinks_come_back(spark, tmp_path, env_of):
    people = spark.createDataFrame([(1, "ab@x.org", "s3cret"), (2, None, "t")], "id long, email string, password string")
    stores.write_masked_csv(people, f"{tmp_path}/csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == ["id", "email", "password"] and rows(back.filter("id = 1"), "id", "email", "password") == [("1", "a•••@x.org", "•••• hidden")]
    runs = CH.run_checks(env_of(t=([(1,)], "i int")), [{"id": "one", "sql": "SELECT * FROM t"}], connection="db")
    counts = CH.as_history(runs).select("ran_at", "connection", "check_id", "status", "result_rows").cache()
    stores.write_counts_json(counts, f"{tmp_path}/json")
    assert rows(spark.read.json(f"{tmp_path}/json"), "check_id", "status", "result_rows") == [("one", "failed", 1)]
    stores.write_counts_text(counts, f"{tmp_path}/text")
    line = spark.read.text(f"{tmp_path}/text").first().value
    assert line.split("  ")[1:] == ["db", "one", "failed", "1"]


def test_a_history_has_no_default_limit(spark):
    runs = spark.range(700).select(F.col("id").alias("run_id"), F.lit("c").alias("check_id"), F.lit("db").alias("connection"))
    assert stores.check_history(runs, "db").count() == 700 and [r.run_id for r in stores.check_history(runs, "db", "c", 2).collect()] == [699, 698]
