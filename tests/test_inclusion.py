"""Links and fields found by values."""

import itertools
import random

from pyspark.sql import functions as F

from plumbline import Env
from plumbline.operators import compare as CM
from plumbline.operators import inclusion as IN
from plumbline.operators import links as LK
from plumbline.sources import catalog as C
from plumbline.sources.environment import Link


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def plain(tables):
    """Pairs that share values, by sets: (table, column) twice, shared, sizes, unique."""
    held = {(t, c): [r[i] for r in data if r[i] is not None] for t, (data, cols) in tables.items() for i, c in enumerate(cols)}
    texts = {k: {str(x) for x in v} for k, v in held.items()}
    return sorted(
        (*a, *b, len(texts[a] & texts[b]), len(texts[a]), len(texts[b]), len(held[b]) == len(texts[b]))
        for a, b in itertools.permutations(held, 2) if texts[a] & texts[b])


def env_of_tables(spark, tables, types):
    return Env(spark, {}).with_tables(**{
        t: spark.createDataFrame(data, ", ".join(f"`{c}` {types.get(c, 'long')}" for c in cols)) for t, (data, cols) in tables.items()})


def test_overlaps_against_sets(spark):
    rng = random.Random(1)
    tables = {
        "parents": ([(i, f"n{i}") for i in range(40)], ["id", "name"]),
        "children": ([(i, rng.choice([None, 7, rng.randrange(40)]), str(rng.randrange(45)), rng.choice(["n1", "n2", None, "", " n1"])) for i in range(200)], ["id", "p", "text_p", "label"]),
        "hot": ([(7, None)] * 300 + [(3, None)], ["p", "nothing"]),
        "empty": ([], ["id"]),
    }
    env = env_of_tables(spark, tables, {"name": "string", "text_p": "string", "label": "string", "nothing": "int"})
    found = IN.overlaps(env)
    names = ["tbl", "col", "ref_tbl", "ref_col", "shared", "col_values", "ref_values", "ref_unique"]
    assert rows(found, *names) == plain(tables)
    linked = rows(IN.contained_links(IN.inclusions(found)), "tbl", "col", "ref_tbl", "ref_col")
    assert ("children", "p", "parents", "id") in linked and ("hot", "p", "parents", "id") in linked
    assert not [x for x in linked if x[1] == "text_p" and x[2] == "parents"]  # some texts are no parent's number


def test_more_columns_than_bits(spark):
    wide = spark.range(3).select("id", *[(F.col("id") + i).alias(f"c{i}") for i in range(130)])
    env = Env(spark, {}).with_tables(wide=wide, other=spark.range(2).select((F.col("id") + 61).alias("x"), (F.col("id") + 129).alias("y")))
    got = rows(IN.inclusions(IN.overlaps(env)).filter("tbl = 'other'"), "col", "ref_col")
    assert got == [("x", "c60"), ("x", "c61"), ("y", "c128"), ("y", "c129")]


def test_no_columns(spark):
    env = Env(spark, {}).with_tables(a=spark.range(2).select(F.col("id").cast("double").alias("x")))
    assert IN.overlaps(env).collect() == []


def test_names_need_the_values_and_values_make_links(spark):
    tables = {
        "users": ([(i,) for i in range(10)], ["id"]),
        "orders": ([(100 + i, i % 10, 50 + i % 3, i % 10) for i in range(30)], ["id", "user_id", "shop_id", "buyer"]),
        "shops": ([(i,) for i in range(3)], ["id"]),
        "bills": ([(100 + i, 9 - i % 10) for i in range(30)], ["order_ref", "owner"]),
    }
    env = env_of_tables(spark, tables, {})
    contained = IN.contained_links(IN.inclusions(IN.overlaps(env)))
    configured = C.local_frame(spark, [("owner", "users", "id")], "col string, ref_tbl string, ref_col string")
    links = LK.discover_links(C.catalog_columns(env), None, configured, contained)
    assert rows(links, "tbl", "col", "ref_tbl", "ref_col", "how") == [
        ("bills", "order_ref", "orders", "id", "contained values"), ("bills", "owner", "users", "id", "configured link"),
        ("orders", "buyer", "users", "id", "contained values"), ("orders", "id", "bills", "order_ref", "contained values"),
        ("orders", "user_id", "users", "id", "name pattern")]
    by_name = LK.discover_links(C.catalog_columns(env), None, configured)
    assert ("orders", "shop_id", "shops") in rows(by_name, "tbl", "col", "ref_tbl")
    assert rows(LK.neighbourhood(links, "bills", 2), "tbl", "distance") == [("bills", 0), ("orders", 1), ("users", 1)]
    assert rows(LK.neighbourhood(links, "shops", 2), "tbl", "distance") == [("shops", 0)]
    assert LK.join_path(links, "bills", "shops").count() == 0


def test_fields_by_values(spark):
    tables = {
        "a": ([(i, i * 10, f"x{i}", i % 3, i % 3) for i in range(20)], ["k", "total", "label", "kind", "same"]),
        "b": ([(i, i * 10, f"x{i}", f"y{i}", i % 3) for i in range(19)], ["k", "amount", "text", "label", "same"]),
    }
    env = env_of_tables(spark, tables, {"label": "string", "text": "string"})
    alike = IN.matching_fields(IN.overlaps(env), "a", "b")
    assert rows(CM.suggest_fields(C.catalog_columns(env), "a", "b", ["k"], alike=alike), "source", "target") == [
        ("label", "text"), ("same", "same"), ("total", "amount")]
    assert rows(CM.suggest_fields(C.catalog_columns(env), "a", "b", ["k"]), "source", "target") == [("label", "label"), ("same", "same")]


def test_an_environment_reads_a_schema_once(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    env = Env.from_parquet(spark, str(tmp_path), ["t"])
    assert env.table("t") is env.table("t") and env.only("t").table("t") is env.table("t")


def test_links_verified_together_as_one_by_one(spark):
    """A hot value, NULLs on both sides, a parent that is not unique, an empty child, a link between types."""
    tables = {
        "a": ([(7, None, 1)] * 60 + [(None, 3, 2), (8, 3, 3), (99, 4, None)], ["x", "y", "z"]),
        "b": ([(i, i % 3) for i in range(10)] + [(None, 5)], ["id", "code"]),
        "c": ([(str(i),) for i in range(5)], ["t"]),
        "none": ([], ["x"]),
    }
    env = env_of_tables(spark, tables, {"t": "string"})
    links = [Link("a", "x", "b", "id"), Link("a", "y", "b", "id"), Link("a", "z", "b", "code"), Link("none", "x", "b", "id"), Link("a", "y", "c", "t"), Link("b", "code", "none", "x")]
    together = LK.verify_links(env, links)
    one_by_one = [tuple(LK.verify_link(env, k).first()) for k in links]
    assert sorted(tuple(r) for r in together.collect()) == sorted(one_by_one)
