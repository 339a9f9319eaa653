"""Consistency rules and orphans."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import checks as CH
from plumbline.operators import rules as R
from plumbline.plans import playbooks as PB
from plumbline.plans import star
from plumbline.plans.registry import query

RETURNED = {
    "source": {"table": "orders", "key": "o_orderkey", "filters": [{"col": "o_orderstatus", "op": "equals", "val": "F"}]},
    "target": {"table": "lineitem", "key": "l_orderkey", "filters": [{"col": "l_returnflag", "op": "equals", "val": "R"}]},
    "expect": "exists",
}
_HAS = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND NOT {_HAS}")
def rule_must_have(env):
    return R.rule_failures(env, RETURNED).drop("o_orderdate")


@query(f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND {_HAS}")
def rule_must_not_have(env):
    return R.rule_failures(env, {**RETURNED, "expect": "not exists"}).drop("o_orderdate")


@query(f"""SELECT o_orderkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 500) WHERE NOT {_HAS}""")
def rule_newest(env):
    return R.rule_failures(env, {**RETURNED, "sample": 500}).select("o_orderkey")


def _verdict_sql(source: str, bad: str) -> str:
    return f"""SELECT checked, failed, checked - failed AS passed, round((checked - failed) * 100.0 / checked, 2) AS pass_rate
        FROM (SELECT count(*) AS checked, count(*) FILTER (WHERE {bad}) AS failed FROM {source})"""


@query(_verdict_sql("orders WHERE o_orderstatus = 'F'", f"NOT {_HAS}"))
def rule_verdict(env):
    return R.rule_verdict(env, RETURNED)


@query(_verdict_sql("orders WHERE o_orderstatus = 'F'", _HAS))
def rule_verdict_must_not(env):
    return R.rule_verdict(env, {**RETURNED, "expect": "not exists"})


_NULL_KEYS = "(SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN user_id END AS buyer FROM events)"
NULL_RULE = {"source": {"table": "visits", "key": "buyer"}, "target": {
    "table": "orders", "key": "o_custkey", "filters": [{"col": "o_totalprice", "op": "at least", "val": "400000"}]}}
_BUYS = "EXISTS (SELECT 1 FROM orders WHERE o_custkey = buyer AND o_totalprice >= 400000)"


def _visits(env):
    return env.with_tables(visits=env.table("events").select(
        "event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("buyer")))


@query(f"SELECT event_id FROM {_NULL_KEYS} v WHERE NOT {_BUYS}")
def rule_null_keys_fail(env):
    return R.rule_failures(_visits(env), {**NULL_RULE, "skip_empty_keys": False}).select("event_id")


@query(f"SELECT event_id FROM {_NULL_KEYS} v WHERE buyer IS NOT NULL AND NOT {_BUYS}")
def rule_null_keys_skipped(env):
    return R.rule_failures(_visits(env), NULL_RULE).select("event_id")


@query(_verdict_sql(f"{_NULL_KEYS} v", f"NOT {_BUYS}"))
def rule_null_keys_verdict(env):
    return R.rule_verdict(_visits(env), {**NULL_RULE, "skip_empty_keys": False})


_ORPHAN = f"l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {star.ORDERS_B} b WHERE b.o_orderkey = l_orderkey)"


@query(f"SELECT count(*) AS orphan_rows FROM lineitem WHERE {_ORPHAN}")
def orphan_count(env):
    return R.orphan_total(env.table("lineitem"), "l_orderkey", star.orders_b(env), "o_orderkey")


@query(f"""SELECT l_orderkey AS missing_parent_value, count(*) AS child_rows FROM lineitem WHERE {_ORPHAN}
           GROUP BY l_orderkey ORDER BY child_rows DESC, missing_parent_value LIMIT 100""")
def orphan_values(env):
    return R.orphan_values(env.table("lineitem"), "l_orderkey", star.orders_b(env), "o_orderkey", 100)


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE {_ORPHAN}")
def orphan_rows(env):
    rows = R.orphan_rows(env.table("lineitem"), "l_orderkey", star.orders_b(env), "o_orderkey")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query(f"""SELECT check_id, status, result_rows, area, severity FROM (
    SELECT 'paid_orders_have_returns' AS check_id, CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END AS status, n AS result_rows,
           'Data consistency' AS area, 'high' AS severity FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND NOT {_HAS})
    UNION ALL SELECT 'orders_overview', 'info', count(*), 'Overview', 'info' FROM orders
    UNION ALL SELECT 'few_big_orders', CASE WHEN count(*) <= 5 THEN 'passed' ELSE 'failed' END, count(*), 'Other', 'medium'
        FROM orders WHERE o_totalprice > 499000
    UNION ALL SELECT 'broken', 'outdated', NULL, 'Other', 'low')""")
def check_batch(env):
    return CH.run_checks(env.only("orders", "lineitem"), _batch()).select("check_id", "status", "result_rows", "area", "severity")


@query(f"""SELECT 4 AS checks, CAST((n = 0) AS INT) + CAST((big <= 5) AS INT) AS passed,
    concat_ws(', ', CASE WHEN big > 5 THEN 'few_big_orders' END, CASE WHEN n > 0 THEN 'paid_orders_have_returns' END) AS failed,
    'broken' AS errored, 'broken' AS alerting FROM (SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND NOT {_HAS}) AS n,
    (SELECT count(*) FROM orders WHERE o_totalprice > 499000) AS big)""")
def check_batch_summary(env):
    summary = CH.batch_summary(CH.run_checks(env.only("orders", "lineitem"), _batch()))
    return summary.select(F.col("checks").cast("int").alias("checks"), F.col("passed").cast("int").alias("passed"),
                          *[F.array_join(c, ", ").alias(c) for c in ("failed", "errored", "alerting")])


def _batch():
    return [
        R.as_check({**RETURNED, "id": "paid_orders_have_returns"}, "Paid orders have returns"),
        {"id": "orders_overview", "area": "Overview", "sql": "SELECT * FROM orders", "expect": "info"},
        {"id": "few_big_orders", "sql": "SELECT * FROM orders WHERE o_totalprice > 499000", "expect": "at most 5"},
        {"id": "broken", "sql": "SELECT no_such_column FROM orders", "severity": "low", "alerts": ["query failed"]},
    ]


# ---------------------------------------------------------------- playbooks
@query(f"""SELECT o_orderkey, o_custkey, o_totalprice, side FROM (
    SELECT *, 'before' AS side FROM (SELECT * FROM orders WHERE o_totalprice < (SELECT min(o_totalprice) FROM orders WHERE o_custkey = 42)
        ORDER BY o_totalprice DESC, o_orderkey, o_custkey LIMIT 5)
    UNION ALL SELECT *, 'after' FROM (SELECT * FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) FROM orders WHERE o_custkey = 42)
        ORDER BY o_totalprice, o_orderkey, o_custkey LIMIT 5))""")
def playbook_neighbours(env):
    steps = PB.run_playbook(env, PB.TEMPLATES["record_by_value"],
                            {"table": "orders", "column": "o_custkey", "value": "42", "order_column": "o_totalprice"})
    return steps["Rows just before and after"].select("o_orderkey", "o_custkey", "o_totalprice", "side")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77 LIMIT 20")
def playbook_record(env):
    steps = PB.run_playbook(env, PB.TEMPLATES["record_by_value"],
                            {"table": "orders", "column": "o_orderkey", "value": "77", "order_column": "o_orderdate"})
    return steps["The record"].select("o_orderkey", "o_custkey", "o_totalprice")


@query(f"SELECT count(*) AS orphan_rows FROM lineitem WHERE {_ORPHAN}")
def playbook_orphans(env):
    steps = PB.run_playbook(env.with_tables(orders=star.orders_b(env)), PB.TEMPLATES["orphans"], {
        "child_table": "lineitem", "child_column": "l_orderkey", "parent_table": "orders", "parent_column": "o_orderkey"})
    return steps["Count orphans"]


@query("""SELECT count(*) AS duplicated_values, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_involved FROM (
          SELECT count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1)""")
def playbook_duplicates(env):
    steps = PB.run_playbook(env, PB.TEMPLATES["duplicates"], {"table": "part", "column": "p_name"})
    return steps["How many values are duplicated"]
