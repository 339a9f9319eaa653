"""Comparisons of tables, results, environments, catalogs and snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import privacy as P
from plumbline.functions import values as V
from plumbline.operators import compare as CM
from plumbline.operators import links as LK
from plumbline.operators import health as H
from plumbline.operators import inclusion as IN
from plumbline.operators import snapshots as SN
from plumbline.plans import star
from plumbline.plans.registry import query
from plumbline.sources import catalog as C
from plumbline.sources import snapshot_store as SS
from plumbline.sources import stores as ST

# ---------------------------------------------------------------- two tables
PLAIN = {
    "source": {"table": "orders", "key": "o_orderkey"}, "target": {"table": "orders", "key": "o_orderkey"},
    "fields": [{"source": c, "target": c} for c in ("o_orderstatus", "o_totalprice", "o_orderpriority", "o_custkey")],
}


def _plain_lines(where: str = "TRUE", case_insensitive: bool = True) -> str:
    """Details of orders A against orders B, spelled out."""
    def num(c: str) -> str:
        return rf"regexp_replace(CAST(CAST({c} AS DECIMAL(38,9)) AS VARCHAR), '\.?0+$', '')"

    def text(c: str) -> str:
        return f"lower({c})" if case_insensitive else c

    return f"""WITH s AS (SELECT * FROM orders WHERE {where}),
      t AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderstatus NULLS FIRST, o_totalprice NULLS FIRST,
                 o_orderpriority NULLS FIRST, o_custkey NULLS FIRST) AS rn, count(*) OVER (PARTITION BY o_orderkey) AS copies FROM {star.ORDERS_B} b),
      j AS (SELECT s.o_orderkey AS k, t.copies, s.o_orderstatus AS s1, t.o_orderstatus AS t1, {num('s.o_totalprice')} AS s2,
                 {num('t.o_totalprice')} AS t2, s.o_orderpriority AS s3, t.o_orderpriority AS t3, s.o_custkey AS s4, t.o_custkey AS t4
            FROM s LEFT JOIN t ON s.o_orderkey = t.o_orderkey AND t.rn = 1),
      d AS (SELECT *, {text('s1')} IS DISTINCT FROM {text('t1')} AS d1, s2 IS DISTINCT FROM t2 AS d2,
                 {text('s3')} IS DISTINCT FROM {text('t3')} AS d3, s4 IS DISTINCT FROM t4 AS d4 FROM j)"""


_PLAIN_DETAILS = f"""{_plain_lines()}
    SELECT CAST(k AS VARCHAR) AS key, 'Missing in target' AS status, '' AS field, '' AS source_value, '' AS target_value FROM d WHERE copies IS NULL
    UNION ALL SELECT CAST(k AS VARCHAR), 'Duplicate in target', 'o_orderkey', '', CAST(copies AS VARCHAR) || ' rows' FROM d WHERE copies > 1
    UNION ALL SELECT CAST(k AS VARCHAR), 'Mismatch', 'o_orderstatus ↔ o_orderstatus', s1, coalesce(t1, 'NULL') FROM d WHERE copies IS NOT NULL AND d1
    UNION ALL SELECT CAST(k AS VARCHAR), 'Mismatch', 'o_totalprice ↔ o_totalprice', s2, t2 FROM d WHERE copies IS NOT NULL AND d2
    UNION ALL SELECT CAST(k AS VARCHAR), 'Mismatch', 'o_orderpriority ↔ o_orderpriority', s3, coalesce(t3, 'NULL') FROM d WHERE copies IS NOT NULL AND d3
    UNION ALL SELECT CAST(k AS VARCHAR), 'Mismatch', 'o_custkey ↔ o_custkey', CAST(s4 AS VARCHAR), CAST(t4 AS VARCHAR) FROM d WHERE copies IS NOT NULL AND d4"""
_SUMMARY = """ SELECT count(*) AS compared, count(*) FILTER (WHERE copies IS NOT NULL AND NOT (d1 OR d2 OR d3 OR d4)) AS matching,
    count(*) FILTER (WHERE copies IS NOT NULL AND (d1 OR d2 OR d3 OR d4)) AS mismatched,
    count(*) FILTER (WHERE copies IS NULL) AS missing_in_target, count(*) FILTER (WHERE copies > 1) AS duplicate_in_target FROM d"""


@query(_PLAIN_DETAILS)
def table_compare_details(env):
    return CM.compare_tables(env, star.environment_b(env), PLAIN)


@query(_plain_lines() + _SUMMARY)
def table_compare_summary(env):
    return CM.compare_summary(env, star.environment_b(env), PLAIN)


@query(_plain_lines("o_orderstatus = 'F' AND o_totalprice >= 100000", False) + _SUMMARY)
def table_compare_strict(env):
    spec = {**PLAIN, "source": {"table": "orders", "key": "o_orderkey", "filters": [
        {"col": "o_orderstatus", "op": "equals", "val": "F"}, {"col": "o_totalprice", "op": "at least", "val": "100000"}]}}
    return CM.compare_summary(env, star.environment_b(env), spec, V.STRICT)


@query(f"""SELECT count(*) AS compared, count(*) AS matching, CAST(0 AS BIGINT) AS mismatched, CAST(0 AS BIGINT) AS missing_in_target,
           CAST(0 AS BIGINT) AS duplicate_in_target FROM orders""")
def table_compare_with_itself(env):
    return CM.compare_summary(env, env, PLAIN)


TEXT_SPEC = {
    "source": {"table": "orders", "key": "o_orderkey"}, "target": {"table": "export", "key": "order_no"},
    "fields": [{"source": "o_orderstatus", "target": "state"}, {"source": "o_orderpriority", "target": "priority"},
               {"source": "o_orderdate", "target": "ordered"}, {"source": "o_totalprice", "target": "total"}],
}
_TEXT = f"""WITH t AS (SELECT CAST(trim(order_no) AS BIGINT) AS k, state, priority, ordered, total,
        row_number() OVER (PARTITION BY CAST(trim(order_no) AS BIGINT) ORDER BY state NULLS FIRST, priority NULLS FIRST,
            ordered NULLS FIRST, total NULLS FIRST) AS rn,
        count(*) OVER (PARTITION BY CAST(trim(order_no) AS BIGINT)) AS copies FROM {star.TEXT_ORDERS_B} b),
    j AS (SELECT o.*, t.copies, t.state, t.priority, t.ordered, t.total FROM orders o LEFT JOIN t ON t.k = o.o_orderkey AND t.rn = 1),
    d AS (SELECT *, lower(o_orderstatus) IS DISTINCT FROM trim(state) AS d1, lower(o_orderpriority) IS DISTINCT FROM trim(priority) AS d2,
        o_orderdate IS DISTINCT FROM CAST(CAST(ordered AS TIMESTAMP) AS TIMESTAMP) AS d3,
        CAST(o_totalprice AS DECIMAL(18,4)) IS DISTINCT FROM CAST(total AS DECIMAL(18,4)) AS d4 FROM j)"""


def _export(env):
    return env.with_tables(name="export", export=star.text_orders_b(env))


@query(_TEXT + _SUMMARY)
def table_compare_text_export(env):
    """Typed orders against an export of text: keys and fields meet in their normal form."""
    return CM.compare_summary(env, _export(env), TEXT_SPEC)


@query(_TEXT + """ SELECT CAST(o_orderkey AS VARCHAR) AS key, 'o_orderstatus ↔ state' AS field, o_orderstatus AS source_value,
        coalesce(state, 'NULL') AS target_value FROM d WHERE copies IS NOT NULL AND d1
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_orderpriority ↔ priority', o_orderpriority, coalesce(priority, 'NULL')
        FROM d WHERE copies IS NOT NULL AND d2
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'o_totalprice ↔ total', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), total
        FROM d WHERE copies IS NOT NULL AND d4""")
def table_compare_text_details(env):
    details = CM.compare_tables(env, _export(env), TEXT_SPEC).filter(F.col("status") == "Mismatch")
    return details.select("key", "field", "source_value", "target_value")


@query(f"""SELECT o_orderkey AS target_key FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM {star.ORDERS_B} b)""")
def table_compare_missing_in_source(env):
    spec = {**PLAIN, "source": {"table": "orders", "key": "o_orderkey", "filters": [{"col": "o_custkey", "op": "equals", "val": "1"}]}}
    return CM.missing_in_source(star.environment_b(env), env, spec)


_CONTACT_CHANGE = f"""(SELECT c_custkey, email, mobile_number, CASE WHEN c_custkey % 9 = 0 THEN api_token || 'x' ELSE api_token END AS api_token,
    CASE WHEN c_custkey % 4 = 0 THEN 'new.' || email ELSE email END AS new_email,
    CASE WHEN c_custkey % 6 = 0 THEN '+91' || CAST(9100000000 + c_custkey AS VARCHAR) ELSE mobile_number END AS new_mobile FROM {star.CONTACTS} c)"""


def _contacts_changed(env):
    k = F.col("c_custkey")
    return star.contacts(env).select(
        "c_custkey", "c_name",
        F.when(k % 4 == 0, F.concat(F.lit("new."), F.col("email"))).otherwise(F.col("email")).alias("email"),
        F.when(k % 6 == 0, F.concat(F.lit("+91"), (F.lit(9100000000) + k).cast("string"))).otherwise(F.col("mobile_number")).alias("mobile_number"),
        F.when(k % 9 == 0, F.concat(F.col("api_token"), F.lit("x"))).otherwise(F.col("api_token")).alias("api_token"),
    )


def _email_sql(c: str) -> str:
    return rf"regexp_replace({c}, '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}})', '\1•••\2', 'g')"


def _phone_sql(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) >= 7 THEN {d}[1:2] || repeat('•', length({d}) - 4) || right({d}, 2) ELSE {c} END"


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS key, 'email ↔ email' AS field, {_email_sql('email')} AS source_value,
        {_email_sql('new_email')} AS target_value FROM {_CONTACT_CHANGE} c WHERE email IS DISTINCT FROM new_email
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'mobile_number ↔ mobile_number', coalesce({_phone_sql('mobile_number')}, 'NULL'),
        coalesce({_phone_sql('new_mobile')}, 'NULL') FROM {_CONTACT_CHANGE} c WHERE mobile_number IS DISTINCT FROM new_mobile
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'api_token ↔ api_token', '•••• hidden', '•••• hidden' FROM {star.CONTACTS} c WHERE c_custkey % 9 = 0""")
def table_compare_masked(env):
    spec = {"source": {"table": "contacts", "key": "c_custkey"}, "target": {"table": "contacts", "key": "c_custkey"},
            "fields": [{"source": c, "target": c} for c in ("email", "mobile_number", "api_token")]}
    details = CM.compare_tables(env.with_tables(contacts=star.contacts(env)), env.with_tables(contacts=_contacts_changed(env)), spec)
    return CM.mask_compared(details).drop("status")


_PAIRED = {"customer": ("customer", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]), "customer_b": ("b", ["c_name", "c_nationkey", "c_balance", "segment", "c_mktsegment"])}
_PAIRED_VALUES = " UNION ALL ".join(
    f"SELECT DISTINCT '{t}' AS tbl, '{c}' AS col, {i} AS pos, CAST({c} AS VARCHAR) AS v FROM {source} WHERE {c} IS NOT NULL"
    for t, (source, columns) in _PAIRED.items() for i, c in enumerate(columns, start=2))


@query(f"""WITH b AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal AS c_balance, c_mktsegment AS segment, 'no ' || c_custkey AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 0),
    v AS ({_PAIRED_VALUES}), d AS (SELECT tbl, col, pos, count(*) AS n FROM v GROUP BY tbl, col, pos),
    p AS (SELECT x.s AS source, x.t AS target, a.pos, met / (a.n + c.n - met) AS likeness FROM (SELECT a.col AS s, c.col AS t, count(*) AS met
        FROM v a JOIN v c ON a.v = c.v AND a.tbl = 'customer' AND c.tbl = 'customer_b' GROUP BY a.col, c.col) x
        JOIN d a ON a.tbl = 'customer' AND a.col = x.s JOIN d c ON c.tbl = 'customer_b' AND c.col = x.t),
    same AS (SELECT source AS col FROM p WHERE source = target),
    free AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY likeness DESC, target) AS rn FROM p WHERE likeness >= 0.5
        AND source NOT IN (SELECT col FROM same) AND target NOT IN (SELECT col FROM same))
    SELECT source, target, CAST(pos AS INT) AS pos FROM p WHERE source = target
    UNION ALL SELECT source, target, CAST(pos AS INT) FROM free WHERE rn = 1 QUALIFY row_number() OVER (PARTITION BY target ORDER BY likeness DESC, pos) = 1""")
def suggested_fields(env):
    """An export without a tenth of the customers: the balance has a new name, and another column took that of the segment."""
    c = env.table("customer").filter(F.col("c_custkey") % 10 != 0)
    export = c.select(
        "c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").alias("c_balance"), F.col("c_mktsegment").alias("segment"),
        F.concat(F.lit("no "), F.col("c_custkey").cast("string")).alias("c_mktsegment"))
    both = env.with_tables(customer_b=export).only("customer", "customer_b")
    wanted = lambda name, dtype: IN.linkable(name, dtype) or isinstance(dtype, T.DoubleType)
    alike = IN.matching_fields(IN.overlaps(both, wanted), "customer", "customer_b")
    return CM.suggest_fields(C.catalog_columns(both), "customer", "customer_b", ["c_custkey"], alike=alike)


# ---------------------------------------------------------------- two results
_SPLIT = f"""a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders),
    b AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM {star.ORDERS_B} x UNION ALL
          SELECT -1 - o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders WHERE o_orderkey % 500 = 0),
    ka AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderstatus NULLS FIRST, o_orderpriority NULLS FIRST) AS rn FROM a),
    kb AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderstatus NULLS FIRST, o_orderpriority NULLS FIRST) AS rn FROM b),
    m AS (SELECT ka.o_orderkey AS k, ka.o_orderstatus AS a1, kb.o_orderstatus AS b1, ka.o_orderpriority AS a2, kb.o_orderpriority AS b2
          FROM ka JOIN kb ON ka.o_orderkey = kb.o_orderkey WHERE ka.rn = 1 AND kb.rn = 1)"""


def _results(env):
    cols = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"]
    a = env.table("orders").select(*cols)
    extra = a.filter(F.col("o_orderkey") % 500 == 0).withColumn("o_orderkey", F.lit(-1) - F.col("o_orderkey"))
    b = star.orders_b(env).select(*cols).unionByName(extra)
    return CM.compare_results(a, b.withColumnRenamed("o_custkey", "buyer"), "o_orderkey")


@query(f"""WITH {_SPLIT} SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b, (SELECT count(*) FROM m) AS shared_keys,
    (SELECT count(*) - count(DISTINCT o_orderkey) FROM a) AS duplicate_keys_a, (SELECT count(*) - count(DISTINCT o_orderkey) FROM b) AS duplicate_keys_b,
    'o_custkey' AS columns_only_a, 'buyer' AS columns_only_b""")
def result_compare_summary(env):
    return _results(env).summary


@query(f"WITH {_SPLIT} SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)")
def result_compare_only_a(env):
    return _results(env).only_a


@query(f"WITH {_SPLIT} SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey AS buyer FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def result_compare_only_b(env):
    return _results(env).only_b


@query(f"""WITH {_SPLIT} SELECT CAST(k AS VARCHAR) AS key, 'o_orderstatus' AS field, a1 AS in_a, b1 AS in_b FROM m WHERE a1 IS DISTINCT FROM b1
    UNION ALL SELECT CAST(k AS VARCHAR), 'o_orderpriority', a2, coalesce(b2, 'None') FROM m WHERE a2 IS DISTINCT FROM b2""")
def result_compare_different(env):
    return _results(env).different


_CONTACT_RESULT = _CONTACT_CHANGE


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS key, 'email' AS field, {_email_sql('email')} AS in_a, {_email_sql('new_email')} AS in_b
        FROM {_CONTACT_RESULT} c WHERE email IS DISTINCT FROM new_email
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'mobile_number', coalesce({_phone_sql('mobile_number')}, 'None'), {_phone_sql('new_mobile')}
        FROM {_CONTACT_RESULT} c WHERE mobile_number IS DISTINCT FROM new_mobile""")
def result_compare_masked(env):
    return CM.compare_results(star.contacts(env), _contacts_changed(env), "c_custkey").different


_NULLABLE_A = "(SELECT CASE WHEN event_id % 4 <> 0 THEN user_id END AS k FROM events)"
_NULLABLE_B = "(SELECT CASE WHEN event_id % 5 <> 0 THEN user_id + 40 END AS k FROM events)"


@query(f"""WITH a AS (SELECT DISTINCT coalesce(CAST(k AS VARCHAR), 'none') AS k FROM {_NULLABLE_A} x),
    b AS (SELECT DISTINCT coalesce(CAST(k AS VARCHAR), 'none') AS k FROM {_NULLABLE_B} x)
    SELECT CASE WHEN b.k IS NULL THEN 'only A' WHEN a.k IS NULL THEN 'only B' ELSE 'both' END AS found, count(*) AS keys
    FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def key_sets(env):
    e = env.table("events")
    a = e.select(F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("k"))
    b = e.select(F.when(F.col("event_id") % 5 != 0, F.col("user_id") + 40).alias("k"))
    return CM.key_sets(a, b, "k")


# ---------------------------------------------------------------- environments
_B_COUNTS = " UNION ALL ".join(
    [f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in star.TABLES if t not in ("orders", "lineitem", "embeddings", "conversations")]
    + [f"SELECT 'orders' AS tbl, count(*) AS n FROM {star.ORDERS_B} b", "SELECT 'lineitem' AS tbl, count(*) AS n FROM lineitem WHERE l_linestatus = 'F'",
       "SELECT 'notes' AS tbl, count(*) AS n FROM benchmark"])
_A_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS n FROM {t}" for t in star.TABLES)


@query(f"""SELECT coalesce(a.tbl, b.tbl) AS "table", a.n AS rows_a, b.n AS rows_b, b.n - a.n AS difference,
    round((b.n - a.n) * 100.0 / a.n, 1) AS change_pct,
    CASE WHEN a.n IS NULL THEN 'missing in A' WHEN b.n IS NULL THEN 'missing in B' WHEN a.n = b.n THEN 'same' ELSE 'different' END AS status
    FROM ({_A_COUNTS}) a FULL JOIN ({_B_COUNTS}) b ON a.tbl = b.tbl""")
def row_counts(env):
    return CM.count_diff(env, star.environment_b(env))


@query(f"""SELECT a.tbl AS tbl, a.n AS left_rows, b.n AS right_rows, b.n - a.n AS difference FROM ({_A_COUNTS}) a JOIN ({_B_COUNTS}) b ON a.tbl = b.tbl
    WHERE greatest(a.n, b.n) >= 1000 AND abs(a.n - b.n) / greatest(a.n, b.n) >= 0.4""")
def row_count_drift(env):
    return CM.row_count_drift(C.table_counts(env), C.table_counts(star.environment_b(env)), min_ratio=0.4)


_SCHEMA_TABLES = ("customer", "orders", "region", "embeddings")
_MEASURED = {
    # column: (type in A, type in B, source in A, source in B)
    "customer": [("c_custkey", "bigint", "int"), ("c_name", "longtext", "longtext"), ("c_nationkey", "int", "int"),
                 ("c_mktsegment", "longtext", "longtext")],
    "orders": [(c, t, t) for c, t in zip(star.TABLES["orders"], ["bigint", "bigint", "longtext", "double", "datetime", "longtext"])],
    "region": [("r_regionkey", "int", "int"), ("r_name", "longtext", "longtext")],
}
_CUSTOMER_B = "(SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer)"


def _schema_sql() -> str:
    b_of = {"customer": f"{_CUSTOMER_B} b", "orders": f"{star.ORDERS_B} b", "region": "region"}
    parts = ["SELECT 'Missing table' AS difference, 'embeddings' AS \"table\", '' AS \"column\", 'exists' AS \"left\", '—' AS \"right\"",
             "SELECT 'Extra table', 'notes', '', '—', 'exists'", "SELECT 'Missing column', 'customer', 'c_acctbal', 'double', '—'",
             "SELECT 'Extra column', 'customer', 'c_balance', '—', 'double'",
             "SELECT 'Foreign key missing', 'customer', 'c_nationkey', '→ nation.n_nationkey', '—'",
             "SELECT 'Foreign key extra', 'orders', 'o_custkey', '—', '→ customer.c_name'",
             "SELECT 'Foreign key missing', 'orders', 'o_custkey', '→ customer.c_custkey', '—'"]
    for t, cols in _MEASURED.items():
        for c, ta, tb in cols:
            if ta != tb:
                parts.append(f"SELECT 'Type differs', '{t}', '{c}', '{ta}', '{tb}'")

            def nullable(src):
                return f"(SELECT CASE WHEN count(*) > count({c}) THEN 'YES' ELSE 'NO' END FROM {src})"

            def key(src):
                text = f"coalesce(CAST({c} AS VARCHAR), 'None')"
                tag = "PRI" if star.KEYS[t] == c else "UNI"
                return f"(SELECT CASE WHEN count(*) = count(DISTINCT {text}) THEN '{tag}' ELSE '—' END FROM {src})"

            for kind, f in (("Nullable differs", nullable), ("Index differs", key)):
                parts.append(f"SELECT * FROM (SELECT '{kind}', '{t}', '{c}', {f(t)} AS l, {f(b_of[t])} AS r) WHERE l <> r")
    return " UNION ALL ".join(parts)


def _catalogs(env):
    from dataclasses import replace

    b = star.environment_b(env)
    a = env.only(*_SCHEMA_TABLES)
    b = b.only("customer", "orders", "region", "notes")
    links_b = [k for k in b.links if k.table not in ("customer", "orders")]
    links_b.append(star.Link("orders", "o_custkey", "customer", "c_name"))
    b = replace(b, links=tuple(links_b))
    return H.measured_columns(a), H.measured_columns(b), C.catalog_links(a), C.catalog_links(b)


@query(_schema_sql())
def schema_diff(env):
    """Structures as the data shows them: measured NULLs and unique columns, declared types and links."""
    return CM.schema_diff(*_catalogs(env))


@query(f"""SELECT difference, "table", "column" FROM ({_schema_sql()}) x WHERE difference IN ('Missing column', 'Extra column', 'Nullable differs') AND (contains(lower("table" || '.' || "column"), 'customer.c_'))""")
def schema_diff_filtered(env):
    diff = CM.filter_differences(CM.schema_diff(*_catalogs(env)), ["Missing column", "Extra column", "Nullable differs"], "CUSTOMER.c_")
    return diff.select("difference", "table", "column")


@query(f"""SELECT k.d AS difference, count(x.difference) AS rows FROM (VALUES {', '.join(f"('{d}')" for d in CM.DIFFERENCE_KINDS)}) k(d)
    LEFT JOIN ({_schema_sql()}) x ON x.difference = k.d GROUP BY k.d""")
def schema_difference_counts(env):
    return CM.difference_counts(CM.schema_diff(*_catalogs(env)))


# ---------------------------------------------------------------- snapshots
SECRET = b"sample-key-of-the-test-data"
_PAD = SECRET.ljust(64, b"\0")
_IPAD = bytes(x ^ 0x36 for x in _PAD).hex().upper()
_OPAD = bytes(x ^ 0x5C for x in _PAD).hex().upper()


def _hmac_sql(message: str, n: int = 32) -> str:
    return f"substr(sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({message})))), 1, {n})"


@query(f"""SELECT o_orderkey, {_hmac_sql('CAST(o_orderkey AS VARCHAR)')} AS key_print, {_hmac_sql("'\"' || o_orderstatus || '\"'")} AS status_print,
    {_hmac_sql("coalesce('\"' || o_orderpriority || '\"', 'null')", 16)} AS priority_print FROM {star.ORDERS_B} b""")
def fingerprints(env):
    df = star.orders_b(env)
    t = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        "o_orderkey",
        P.fingerprint(F.col("o_orderkey"), t["o_orderkey"], SECRET).alias("key_print"),
        P.fingerprint(F.col("o_orderstatus"), t["o_orderstatus"], SECRET).alias("status_print"),
        P.fingerprint(F.col("o_orderpriority"), t["o_orderpriority"], SECRET, 16).alias("priority_print"),
    )


_SNAP_LINES = f"""WITH x AS (SELECT *, c_custkey % 13 = 0 AS gone FROM {_CONTACT_CHANGE} c)
    SELECT CAST(c_custkey AS VARCHAR) AS key_label, field, change FROM (
      SELECT c_custkey, 'email' AS field, CASE WHEN email IS DISTINCT FROM new_email THEN 'changed' ELSE 'same' END AS change FROM x WHERE NOT gone
      UNION ALL SELECT c_custkey, 'mobile_number', CASE WHEN mobile_number IS DISTINCT FROM new_mobile THEN 'changed' ELSE 'same' END FROM x WHERE NOT gone
      UNION ALL SELECT c_custkey, 'api_token', 'hidden' FROM x WHERE NOT gone
      UNION ALL SELECT c_custkey, f, 'same' FROM x, (VALUES ('c_custkey'), ('c_name')) v(f) WHERE NOT gone
      UNION ALL SELECT c_custkey, f, 'missing on the right' FROM x, (VALUES ('c_custkey'), ('c_name'), ('email'), ('mobile_number'), ('api_token')) v(f) WHERE gone)"""


@query(_SNAP_LINES)
def snapshot_changes(env):
    before = star.contacts(env).select("c_custkey", "c_name", "email", "mobile_number", "api_token")
    after = _contacts_changed(env).filter(F.col("c_custkey") % 13 != 0)
    diff = SN.snapshot_diff(SN.snapshot(before, "c_custkey", SECRET), SN.snapshot(after, "c_custkey", SECRET))
    return diff.select("key_label", "field", "change")


@query(f"SELECT * FROM ({_SNAP_LINES}) WHERE change NOT IN ('same', 'hidden')")
def snapshot_changes_saved(env):
    """Both snapshots saved, then compared by their trees of digests."""
    path = f"{ST.shared_folder(env.spark)}/snapshots-{uuid.uuid4().hex}"
    columns = ["c_custkey", "c_name", "email", "mobile_number", "api_token"]
    SS.save_snapshot(SN.snapshot(star.contacts(env).select(*columns), "c_custkey", SECRET), path, "before")
    SS.save_snapshot(SN.snapshot(_contacts_changed(env).select(*columns).filter(F.col("c_custkey") % 13 != 0), "c_custkey", SECRET), path, "after")
    return SS.saved_snapshot_diff(env.spark, path, "before", "after").select("key_label", "field", "change")


@query(f"""WITH a AS (SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS VARCHAR) AS c, o_orderpriority FROM orders WHERE o_orderkey IN (50, 61, 97, 100, 121)),
    b AS (SELECT o_orderkey, o_orderstatus, CAST(o_custkey AS VARCHAR) AS c, o_orderpriority FROM {star.ORDERS_B} x WHERE o_orderkey IN (50, 61, 97, 100, 121)),
    j AS (SELECT a.o_orderkey AS k, b.o_orderkey IS NULL AS gone, a.o_orderstatus AS s1, b.o_orderstatus AS t1, a.c AS s2, b.c AS t2,
          a.o_orderpriority AS s3, b.o_orderpriority AS t3 FROM a LEFT JOIN b ON a.o_orderkey = b.o_orderkey),
    l AS (SELECT k, gone, 'o_orderkey' AS field, CAST(k AS VARCHAR) AS x, CAST(k AS VARCHAR) AS y FROM j UNION ALL SELECT k, gone, 'o_orderstatus', s1, t1 FROM j
          UNION ALL SELECT k, gone, 'o_custkey', s2, t2 FROM j UNION ALL SELECT k, gone, 'o_orderpriority', s3, t3 FROM j)
    SELECT CAST(k AS VARCHAR) AS key_label, field, coalesce(x, 'NULL') AS before, CASE WHEN gone THEN '—' ELSE coalesce(y, 'NULL') END AS after,
    CASE WHEN gone THEN 'missing on the right' WHEN x IS DISTINCT FROM y THEN 'changed' ELSE 'same' END AS change FROM l""")
def record_diff(env):
    cols = ["o_orderkey", "o_orderstatus", "o_custkey", "o_orderpriority"]
    return SN.record_diff(env.table("orders").select(*cols), star.orders_b(env).select(*cols), "o_orderkey",
                          [50, 61, 97, 100, 121], SECRET).drop("key_digest")


_LINKED = """SELECT CAST(c_custkey AS VARCHAR) AS key, 'orders' AS tbl, 'o_custkey' AS col, (SELECT count(*) FROM {o} o WHERE o.o_custkey = c_custkey) AS n FROM customer"""


@query(f"""SELECT a.key, a.tbl, a.col, a.n AS before, b.n AS after, b.n - a.n AS difference FROM ({_LINKED.format(o='orders')}) a
    JOIN ({_LINKED.format(o=star.ORDERS_B)}) b ON a.key = b.key WHERE a.n <> b.n AND a.key <> '0'""")
def linked_count_changes(env):
    def counts(e):
        only = e.only("customer", "orders")
        records = env.table("customer")
        from dataclasses import replace

        only = replace(only, links=tuple(k for k in only.links if k.table == "orders"))
        return LK.linked_counts(only, "customer", records, "c_custkey")

    return SN.linked_count_changes(counts(env), counts(env.with_tables(orders=star.orders_b(env))))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, email, mobile_number, password FROM (
    SELECT c_custkey, regexp_replace(email, '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\\.[A-Za-z]{2,})', '\\1•••\\2') AS email,
    CASE WHEN mobile_number IS NULL THEN 'None' ELSE '91••••••••' || right(mobile_number, 2) END AS mobile_number, '•••• hidden' AS password
    FROM """ + star.CONTACTS + """ c ORDER BY c_custkey LIMIT 25)""")
def masked_evidence(env):
    rows = star.contacts(env).select("c_custkey", "email", "mobile_number", "password").orderBy("c_custkey")
    return SN.masked_evidence(rows)[0]
