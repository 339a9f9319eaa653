"""Check histories and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.operators import checks as CH
from plumbline.operators import timeline as TL
from plumbline.plans import star
from plumbline.plans.registry import query
from plumbline.sources.stores import check_history

_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY connection, check_id ORDER BY run_id DESC) AS n FROM {star.CHECK_RUNS} r)"
_LATEST = f"""(SELECT a.connection, a.check_id, a.run_id, a.status, a.result_rows, a.seconds, a.ran_at, b.run_id AS previous_run_id,
    b.status AS previous_status, b.result_rows AS previous_result_rows FROM {_RANKED} a LEFT JOIN {_RANKED} b
    ON a.connection = b.connection AND a.check_id = b.check_id AND b.n = 2 WHERE a.n = 1)"""


@query(f"""SELECT connection, check_id, run_id, status, result_rows, seconds, strftime(ran_at, '%Y-%m-%d %H:%M:%S') AS ran_at,
    previous_run_id, previous_status, previous_result_rows FROM {_LATEST} l""")
def latest_and_previous(env):
    two = CH.latest_two(star.check_runs(env))
    return two.withColumn("ran_at", F.date_format("ran_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""SELECT run_id, change, CASE WHEN change IS NULL THEN '' WHEN change > 0 THEN '+' || change || ' since last run'
    WHEN change < 0 THEN change || ' since last run' ELSE 'no change' END AS change_text FROM (
    SELECT run_id, result_rows - lag(result_rows) OVER (PARTITION BY connection, check_id ORDER BY run_id) AS change FROM {star.CHECK_RUNS} r)""")
def changes_between_runs(env):
    return CH.changes(star.check_runs(env)).select("run_id", "change", "change_text")


@query(f"""SELECT connection, day, CAST(sum(result_rows) AS BIGINT) AS issues FROM (SELECT *, strftime(ran_at, '%Y-%m-%d') AS day,
    row_number() OVER (PARTITION BY connection, strftime(ran_at, '%Y-%m-%d'), check_id ORDER BY run_id DESC) AS n FROM {star.CHECK_RUNS} r)
    WHERE n = 1 AND status = 'failed' GROUP BY ALL""")
def daily_issue_trend(env):
    return CH.issue_trend(star.check_runs(env))


@query(f"SELECT run_id, check_id, status, result_rows FROM {star.CHECK_RUNS} r WHERE connection = 'db1' AND check_id = 'purchase' ORDER BY run_id DESC LIMIT 500")
def newest_runs(env):
    return check_history(star.check_runs(env), "db1", "purchase", 500).select("run_id", "check_id", "status", "result_rows")


@query(f"SELECT run_id, check_id, status, result_rows FROM {star.CHECK_RUNS} r WHERE connection = 'db1'")
def run_history(env):
    return check_history(star.check_runs(env), "db1").select("run_id", "check_id", "status", "result_rows")


@query(f"SELECT status, count(*) AS checks FROM {star.CHECK_RUNS} r GROUP BY status")
def run_status_counts(env):
    return CH.status_counts(star.check_runs(env))


EXPECTATIONS = ["empty", "at most 5", "at least 30", "exactly 7 rows", "info", "weird 1"]


@query("""SELECT event_id, CASE WHEN user_id % 13 = 0 THEN 'outdated' WHEN event_type = 'error' THEN 'error' ELSE CASE event_id % 6
    WHEN 0 THEN CASE WHEN n = 0 THEN 'passed' ELSE 'failed' END WHEN 1 THEN CASE WHEN n <= 5 THEN 'passed' ELSE 'failed' END
    WHEN 2 THEN CASE WHEN n >= 30 THEN 'passed' ELSE 'failed' END WHEN 3 THEN CASE WHEN n = 7 THEN 'passed' ELSE 'failed' END
    ELSE 'info' END END AS status FROM (SELECT *, CAST(floor(value) AS BIGINT) AS n FROM events)""")
def evaluated_runs(env):
    expect = F.element_at(F.array(*[F.lit(e) for e in EXPECTATIONS]), (F.col("event_id") % 6 + 1).cast("int"))
    status = X.evaluate(expect, F.floor("value").cast("bigint"), F.col("event_type") == "error", F.col("user_id") % 13 == 0)
    return env.table("events").select("event_id", status.alias("status"))


@query(f"""SELECT run_id, concat_ws('; ', CASE WHEN result_rows > 30 THEN result_rows || ' rows > 30' END,
    CASE WHEN result_rows > prev THEN 'rows increased ' || prev || ' → ' || result_rows END,
    CASE WHEN status IN ('error', 'outdated') THEN 'query failed' END,
    CASE WHEN seconds > 25.5 THEN 'took ' || CAST(CAST(round(CAST(seconds AS DECIMAL(12,2)), 1) AS DECIMAL(12,1)) AS VARCHAR) || 's > 25.5s' END) AS fired
    FROM (SELECT *, lag(result_rows) OVER (PARTITION BY connection, check_id ORDER BY run_id) AS prev FROM {star.CHECK_RUNS} r)""")
def alerts_fired(env):
    runs = CH.changes(star.check_runs(env))
    rules = F.array(*[F.lit(r) for r in ("rows > 30", "rows increased", "query failed", "slower than 25.5s", "nonsense")])
    fired = X.alerts(rules, F.col("status"), F.col("result_rows"), F.col("seconds").cast("decimal(12,2)"), F.col("previous_rows"))
    return runs.select("run_id", F.array_join(fired, "; ").alias("fired"))


@query(f"""SELECT c.id AS id, strftime(l.ran_at, '%Y-%m-%d %H:%M:%S') AS last_run,
    coalesce(floor(epoch(TIMESTAMP '2024-01-31 06:00:00')) - floor(epoch(l.ran_at)) >= c.due_after, TRUE) AS due
    FROM {star.CHECKS_SQL} c LEFT JOIN {_LATEST} l ON l.check_id = c.id AND l.connection = 'db1'""")
def due_checks(env):
    checks = CH.checks_frame(env, star.CHECKS)
    out = CH.due(checks, star.check_runs(env), "db1", F.lit("2024-01-31 06:00:00").cast("timestamp_ntz"))
    return out.select("id", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"), "due")


_BOARD = f"""(SELECT c.id, c.title AS "check", c.area, c.severity, coalesce(l.status, 'not run') AS status, l.result_rows AS rows,
    CASE WHEN coalesce(l.status, 'not run') NOT IN ('error', 'outdated') THEN l.result_rows - l.previous_result_rows END AS change,
    l.seconds AS duration_s, strftime(l.ran_at, '%Y-%m-%d %H:%M:%S') AS last_run,
    coalesce(strftime(l.ran_at, '%Y-%m-%d') = '2024-01-30', FALSE) AS ran_today, c.owner, c.tags
    FROM {star.CHECKS_SQL} c LEFT JOIN {_LATEST} l ON l.check_id = c.id AND l.connection = 'db1')"""


def _board(env):
    return CH.dashboard(CH.checks_frame(env, star.CHECKS), star.check_runs(env), "db1", "2024-01-30")


@query(f"SELECT * FROM {_BOARD} b")
def dashboard(env):
    return CH.ordered_by_urgency(_board(env))


@query(f"""SELECT count(*) FILTER (WHERE ran_today) AS run_today, count(*) FILTER (WHERE ran_today AND status = 'passed') AS passed,
    count(*) FILTER (WHERE ran_today AND status = 'failed') AS failed, count(*) FILTER (WHERE ran_today AND status IN ('error', 'outdated')) AS warnings,
    CAST(coalesce(sum(rows) FILTER (WHERE ran_today AND status = 'failed'), 0) AS BIGINT) AS total_issues FROM {_BOARD} b""")
def dashboard_totals(env):
    return CH.dashboard_totals(_board(env))


@query(f"SELECT id, change FROM {_BOARD} b WHERE status = 'failed' AND change > 0")
def dashboard_got_worse(env):
    return CH.got_worse(_board(env)).select("id", "change")


@query(f"SELECT id, status FROM {_BOARD} b WHERE status IN ('failed', 'error', 'outdated')")
def dashboard_problems(env):
    return CH.with_problems(_board(env)).select("id", "status")


@query(f"SELECT id, rows FROM {_BOARD} b WHERE status = 'failed' ORDER BY rows DESC NULLS LAST, id LIMIT 15")
def dashboard_top_issues(env):
    return CH.top_issues(_board(env)).select("id", "rows")


@query(f"SELECT id, duration_s FROM {_BOARD} b WHERE duration_s IS NOT NULL ORDER BY duration_s DESC, id LIMIT 3")
def dashboard_slowest(env):
    return CH.slowest(_board(env), 3).select("id", "duration_s")


_DEFINED = """(SELECT p_partkey, p_name AS title, CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 20 THEN 'high' ELSE 'low' END AS severity,
    [lower(p_type), lower(p_brand)] AS tags, CASE p_partkey % 3 WHEN 0 THEN 'db1' WHEN 1 THEN 'db2' END AS db, p_brand AS area FROM part)"""


@query(f"""SELECT p_partkey FROM {_DEFINED} d WHERE (db IS NULL OR db = 'db1') AND severity IN ('critical', 'high')
    AND list_has_any(tags, ['economy', 'brand#7']) AND contains(lower(title), 'red')""")
def filtered_checks(env):
    size = F.col("p_size")
    defined = env.table("part").select(
        "p_partkey", F.col("p_name").alias("title"),
        F.when(size > 40, "critical").when(size > 20, "high").otherwise("low").alias("severity"),
        F.array(F.lower("p_type"), F.lower("p_brand")).alias("tags"),
        F.when(F.col("p_partkey") % 3 == 0, "db1").when(F.col("p_partkey") % 3 == 1, "db2").alias("database"),
        F.col("p_brand").alias("area"), *[F.lit(None).cast("string").alias(c) for c in ("why", "sql", "owner")],
    )
    return CH.filter_checks(defined, "db1", ["critical", "high"], ["economy", "brand#7"], term="RED").select("p_partkey")


# ---------------------------------------------------------------- timelines
_T = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
_EVENTS = f"""SELECT {_T.format(c='ts')} AS time, 'events' AS "table", 'event_id=' || event_id AS "row", 'ts' AS "column", 'events.ts' AS event, '' AS status FROM events"""
_ORDERS = f"""SELECT {_T.format(c='ordered_at')}, 'purchases', 'id=' || id, 'ordered_at', 'purchases.ordered_at', 'state=' || state
    FROM (SELECT o_orderkey AS id, o_orderdate AS ordered_at, o_orderstatus AS state FROM orders)
    UNION ALL SELECT {_T.format(c='ordered_at + INTERVAL 1 DAY')}, 'purchases', 'id=' || id, 'paid_on', 'purchases.paid_on', 'state=' || state
    FROM (SELECT o_orderkey AS id, o_orderdate AS ordered_at, o_orderstatus AS state FROM orders) WHERE id % 5 = 0"""


def _sources(env):
    o, k = env.table("orders"), F.col("o_orderkey")
    next_day = F.date_format(F.col("o_orderdate") + F.expr("interval 1 day"), "yyyy-MM-dd HH:mm:ss")
    purchases = o.select(
        k.alias("id"), F.col("o_orderdate").alias("ordered_at"), F.col("o_orderstatus").alias("state"),
        F.when(k % 5 == 0, next_day).when(k % 5 == 1, "0000-00-00 00:00:00").when(k % 5 == 2, "not a date").alias("paid_on"),
        F.col("o_custkey").alias("is_date"),
    )
    return [("events", env.table("events"), ["event_id"]), ("purchases", purchases, ["id", "uid"])]


def _as_text(events):
    return events.withColumn("time", F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(f"{_EVENTS} UNION ALL {_ORDERS}")
def timeline(env):
    return _as_text(TL.timeline(_sources(env)))


@query(f"""SELECT * FROM ({_EVENTS} UNION ALL {_ORDERS}) t WHERE "table" = 'purchases' AND (contains(lower(status), 'state=f') OR contains(event, 'state=f'))
    AND time >= '1997-03-01' AND time < '1997-04-01'""")
def timeline_filtered(env):
    return _as_text(TL.filter_timeline(TL.timeline(_sources(env)), ["purchases"], "State=F", "1997-03-01", "1997-03-31"))


@query(f"""WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9900)
    SELECT CAST(user_id AS VARCHAR) AS record, {_T.format(c='ts')} AS time, 'events' AS "table", 'event_id=' || event_id AS "row", 'ts' AS "column",
        'events.ts' AS event, '' AS status FROM events JOIN c ON user_id = c_custkey
    UNION ALL SELECT CAST(o_custkey AS VARCHAR), {_T.format(c='o_orderdate')}, 'orders', 'o_orderkey=' || o_orderkey, 'o_orderdate', 'orders.o_orderdate', ''
        FROM orders JOIN c ON o_custkey = c_custkey""")
def linked_timeline(env):
    rich = env.table("customer").filter(F.col("c_acctbal") > 9900)
    events = TL.linked_timeline(env, "customer", rich, "c_custkey", [k for k in env.links if k.ref_table == "customer"])
    return _as_text(events)
