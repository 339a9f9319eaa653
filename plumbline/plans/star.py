"""The sample star schema as an environment, a second environment derived from it, and SQL for both.

The second environment ("B") holds the defects that the comparisons look for: dropped and
repeated orders, changed statuses, missing priorities and a renamed column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.environment import Env, Link

TABLES = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    ],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
}
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey",
    "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id",
    "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
}
LINKS = (
    Link("nation", "n_regionkey", "region", "r_regionkey"),
    Link("customer", "c_nationkey", "nation", "n_nationkey"),
    Link("supplier", "s_nationkey", "nation", "n_nationkey"),
    Link("orders", "o_custkey", "customer", "c_custkey"),
    Link("lineitem", "l_orderkey", "orders", "o_orderkey"),
    Link("lineitem", "l_partkey", "part", "p_partkey"),
    Link("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    Link("events", "user_id", "customer", "c_custkey"),
    Link("labels", "doc_id", "documents", "doc_id"),
)


def environment(spark: SparkSession, sf_dir: str) -> Env:
    return Env.from_parquet(spark, sf_dir, TABLES, name="A", keys=KEYS, links=LINKS)


def orders_b(env: Env) -> DataFrame:
    o = env.table("orders")
    kept = o.filter(F.col("o_orderkey") % 97 != 0)
    changed = kept.select(
        "o_orderkey", "o_custkey",
        F.when(F.col("o_orderkey") % 50 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_totalprice", "o_orderdate",
        F.when(F.col("o_orderkey") % 60 != 1, F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    again = kept.filter(F.col("o_orderkey") % 211 == 0).withColumn("o_totalprice", F.col("o_totalprice") + 1.25)
    return changed.unionByName(again)


ORDERS_B = """(
    SELECT o_orderkey, o_custkey,
           CASE WHEN o_orderkey % 50 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
           o_totalprice, o_orderdate,
           CASE WHEN o_orderkey % 60 <> 1 THEN o_orderpriority END AS o_orderpriority
    FROM orders WHERE o_orderkey % 97 <> 0
    UNION ALL
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice + 1.25, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey % 211 = 0)"""


def text_orders_b(env: Env) -> DataFrame:
    """Orders B as an export would hold them: everything text, padded, other letter case."""
    return orders_b(env).select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("order_no"),
        F.lower("o_orderstatus").alias("state"),
        F.concat(F.lower("o_orderpriority"), F.lit("  ")).alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ordered"),
        F.col("o_totalprice").cast("decimal(18,4)").cast("string").alias("total"),
    )


TEXT_ORDERS_B = f"""(
    SELECT ' ' || CAST(o_orderkey AS VARCHAR) AS order_no, lower(o_orderstatus) AS state,
           lower(o_orderpriority) || '  ' AS priority,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS ordered,
           CAST(CAST(o_totalprice AS DECIMAL(18,4)) AS VARCHAR) AS total
    FROM {ORDERS_B} b)"""


def customer_b(env: Env) -> DataFrame:
    return env.table("customer").select(
        F.col("c_custkey").cast("int").alias("c_custkey"), "c_name", "c_nationkey",
        F.col("c_acctbal").alias("c_balance"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
    )


def environment_b(env: Env) -> Env:
    """B lacks two tables, has a new one, and its orders and customers differ."""
    lines = env.table("lineitem").filter(F.col("l_linestatus") == "F")
    notes = env.table("benchmark").select("item_id", "text")
    return env.with_tables(
        name="B", drop=["embeddings", "conversations"], orders=orders_b(env), customer=customer_b(env),
        lineitem=lines, notes=notes,
    )


def contacts(env: Env) -> DataFrame:
    """Customers with contact data and secrets, as an application table would have them."""
    k = F.col("c_custkey")
    return env.table("customer").select(
        "c_custkey", "c_name",
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com")).alias("email"),
        F.when(k % 7 != 0, F.concat(F.lit("+91"), (F.lit(9000000000) + k).cast("string"))).alias("mobile_number"),
        (F.lit(8000000000) + k).alias("phone2"),
        F.sha2(F.col("c_name"), 256).alias("password"),
        F.concat(F.lit("tok_"), k.cast("string")).alias("api_token"),
        F.when(k % 5 == 0, "inactive").otherwise("active").alias("status"),
        (k % 11 == 0).alias("is_deleted"),
        F.concat(F.lit("see "), F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@example.com ok")).alias("note"),
    )


CONTACTS = """(
    SELECT c_custkey, c_name, lower(replace(c_name, '#', '.')) || '@example.com' AS email,
           CASE WHEN c_custkey % 7 <> 0 THEN '+91' || CAST(9000000000 + c_custkey AS VARCHAR) END AS mobile_number,
           8000000000 + c_custkey AS phone2, sha256(c_name) AS password,
           'tok_' || CAST(c_custkey AS VARCHAR) AS api_token,
           CASE WHEN c_custkey % 5 = 0 THEN 'inactive' ELSE 'active' END AS status,
           c_custkey % 11 = 0 AS is_deleted,
           'see ' || lower(replace(c_name, '#', '.')) || '@example.com ok' AS note
    FROM customer)"""


def order_documents(env: Env) -> DataFrame:
    """One JSON text per order, as an API would answer; some are malformed."""
    k = F.col("o_orderkey")
    good = F.concat(
        F.lit('{"data":{"id":'), k.cast("string"), F.lit(',"userId":"'), F.col("o_custkey").cast("string"),
        F.lit('","status":"'), F.lower("o_orderstatus"), F.lit('","items":["'), F.col("o_orderpriority"),
        F.lit('","gift"],"total":'), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.when(k % 4 == 0, ',"note":null').when(k % 4 == 1, ',"note":""').when(k % 4 == 2, ',"note":"call"').otherwise(""),
        F.lit(',"paid":'), F.when(k % 3 == 0, "true").otherwise("false"), F.lit('}}'),
    )
    text = (
        F.when(k % 100 == 3, '{"a": 1,}').when(k % 100 == 5, "{'a': 1}").when(k % 100 == 7, "  ").otherwise(good)
    )
    code = F.when(k % 20 == 0, 500).otherwise(200)
    return env.table("orders").select("o_orderkey", text.alias("body"), code.alias("status_code"))


ORDER_DOCUMENTS = """(
    SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 3 THEN '{"a": 1,}' WHEN o_orderkey % 100 = 5 THEN '{''a'': 1}'
        WHEN o_orderkey % 100 = 7 THEN '  ' ELSE
        '{"data":{"id":' || CAST(o_orderkey AS VARCHAR) || ',"userId":"' || CAST(o_custkey AS VARCHAR)
        || '","status":"' || lower(o_orderstatus) || '","items":["' || o_orderpriority || '","gift"],"total":'
        || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
        || CASE o_orderkey % 4 WHEN 0 THEN ',"note":null' WHEN 1 THEN ',"note":""' WHEN 2 THEN ',"note":"call"' ELSE '' END
        || ',"paid":' || CASE WHEN o_orderkey % 3 = 0 THEN 'true' ELSE 'false' END || '}}' END AS body,
        CASE WHEN o_orderkey % 20 = 0 THEN 500 ELSE 200 END AS status_code
    FROM orders)"""


def check_runs(env: Env) -> DataFrame:
    """A run history: every event is a run of the check named by its type."""
    e = env.table("events")
    rows = F.floor("value").cast("bigint")
    status = (
        F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "info")
        .when(rows == 0, "passed").when(rows <= 20, "passed").otherwise("failed")
    )
    return e.select(
        F.col("event_id").alias("run_id"), F.col("event_type").alias("check_id"),
        F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")).alias("connection"),
        status.alias("status"), rows.alias("result_rows"),
        F.col("value").alias("seconds"), F.col("ts").alias("ran_at"),
    )


CHECK_RUNS = """(
    SELECT event_id AS run_id, event_type AS check_id, 'db' || CAST(user_id % 3 AS VARCHAR) AS connection,
           CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'info'
                WHEN floor(value) <= 20 THEN 'passed' ELSE 'failed' END AS status,
           CAST(floor(value) AS BIGINT) AS result_rows, value AS seconds, ts AS ran_at
    FROM events)"""

CHECKS = [
    {"id": "click", "title": "Clicks", "area": "Overview", "expect": "at most 20", "severity": "low", "tags": ["web"],
     "schedule": "hourly", "alerts": ["rows > 30", "rows increased"]},
    {"id": "error", "title": "Errors", "area": "Invalid status", "severity": "critical", "tags": ["web", "ops"],
     "schedule": "daily", "alerts": ["query failed"]},
    {"id": "purchase", "title": "Purchases", "area": "Missing data", "expect": "at most 20", "severity": "high",
     "schedule": "weekly", "owner": "shop", "alerts": ["rows > 100", "slower than 5s"]},
    {"id": "signup", "title": "Sign-ups", "area": "Duplicates", "expect": "at most 20", "severity": "medium",
     "schedule": "monthly", "owner": "shop"},
    {"id": "view", "title": "Views", "expect": "info"},
    {"id": "never", "title": "Never run", "schedule": "daily", "severity": "high"},
]
CHECKS_SQL = """(SELECT * FROM (VALUES
    ('click', 'Clicks', 'Overview', 'low', '', 'web', 'hourly', 3600),
    ('error', 'Errors', 'Invalid status', 'critical', '', 'web, ops', 'daily', 86400),
    ('purchase', 'Purchases', 'Missing data', 'high', 'shop', '', 'weekly', 604800),
    ('signup', 'Sign-ups', 'Duplicates', 'medium', 'shop', '', 'monthly', 2592000),
    ('view', 'Views', 'Other', 'info', '', '', 'manual', NULL),
    ('never', 'Never run', 'Other', 'high', '', '', 'daily', 86400))
    AS c(id, title, area, severity, owner, tags, schedule, due_after))"""


def query_log(env: Env) -> DataFrame:
    """A query log: every event is one execution of a query someone typed."""
    e = env.table("events")
    n = F.col("event_id") % 40
    user = F.col("user_id").cast("string")
    sql = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("SELECT * FROM orders WHERE o_custkey = "), n.cast("string")))
        .when(F.col("event_type") == "view",
              F.concat(F.lit("select o_orderkey from orders where year(o_orderdate) = 1997 or mobile = '98765432"), user, F.lit("' limit 10")))
        .when(F.col("event_type") == "signup",
              F.concat(F.lit("SELECT c.* FROM customer c WHERE c.email LIKE '%user"), n.cast("string"), F.lit("@example.com'")))
        .when(F.col("event_type") == "purchase",
              F.lit("SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) "))
        .otherwise(F.concat(F.lit("SELECT p_name FROM part WHERE phone_no IN ('9876500"), n.cast("string"),
                            F.lit("', 12345) ORDER BY RAND() LIMIT 5")))
    )
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("no such column near token = 'abc"), n.cast("string"), F.lit("'")))
    return e.select(
        F.col("event_id").alias("log_id"), sql.alias("sql"), error.alias("error"),
        F.concat(F.lit("user"), user).alias("username"), F.col("ts").alias("ran_at"),
        F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")).alias("connection"),
    )


QUERY_LOG = """(
    SELECT event_id AS log_id, CASE event_type
        WHEN 'click' THEN 'SELECT * FROM orders WHERE o_custkey = ' || CAST(event_id % 40 AS VARCHAR)
        WHEN 'view' THEN 'select o_orderkey from orders where year(o_orderdate) = 1997 or mobile = ''98765432'
             || CAST(user_id AS VARCHAR) || ''' limit 10'
        WHEN 'signup' THEN 'SELECT c.* FROM customer c WHERE c.email LIKE ''%user' || CAST(event_id % 40 AS VARCHAR)
             || '@example.com'''
        WHEN 'purchase' THEN 'SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) '
        ELSE 'SELECT p_name FROM part WHERE phone_no IN (''9876500' || CAST(event_id % 40 AS VARCHAR)
             || ''', 12345) ORDER BY RAND() LIMIT 5' END AS sql,
        CASE WHEN event_type = 'error' THEN 'no such column near token = ''abc' || CAST(event_id % 40 AS VARCHAR) || '''' END AS error,
        'user' || CAST(user_id AS VARCHAR) AS username, ts AS ran_at, 'db' || CAST(user_id % 3 AS VARCHAR) AS connection
    FROM events)"""
