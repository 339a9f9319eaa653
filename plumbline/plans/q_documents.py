"""JSON documents, privacy and the query log."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import documents as D
from plumbline.functions import privacy as P
from plumbline.operators import documents as DO
from plumbline.operators import profile as PF
from plumbline.operators import querylog as QL
from plumbline.plans import star
from plumbline.plans.q_compare import _email_sql, _phone_sql
from plumbline.plans.registry import query
from plumbline.sources import catalog as C

# ---------------------------------------------------------------- documents against rules
RULES = [
    # rule, SQL for pass and warn over the columns of _DOCS
    (D.Rule("data.status", "equals", "F"), "status = 'f'", "FALSE"),
    (D.Rule("data.userId", "not equals", "7"), "uid <> 7", "FALSE"),
    (D.Rule("data.userId", "not null"), "TRUE", "FALSE"),
    (D.Rule("data.email", "exists"), "FALSE", "FALSE"),
    (D.Rule("data.note", "exists"), "has_note", "FALSE"),
    (D.Rule("data.note", "not exists"), "NOT has_note", "FALSE"),
    (D.Rule("data.note", "is null"), "note_null", "FALSE"),
    (D.Rule("data.note", "not empty"), "note = 'call'", "FALSE"),
    (D.Rule("data.items", "count at least", "2"), "TRUE", "FALSE"),
    (D.Rule("data.items", "count equals", "3"), "FALSE", "FALSE"),
    (D.Rule("data.items", "contains", "1-urgent"), "priority = '1-URGENT'", "FALSE"),
    (D.Rule("data.items[0]", "matches regex", "^[12]-"), "priority[1:2] IN ('1-', '2-')", "FALSE"),
    (D.Rule("data.items[0]", "matches regex", "(["), "FALSE", "TRUE"),
    (D.Rule("data.total", "greater than", "250000"), "total > 250000", "FALSE"),
    (D.Rule("data.status", "less than", "1"), "FALSE", "TRUE"),
    (D.Rule("data.paid", "equals", "1"), "paid", "FALSE"),
    (D.Rule("data.items", "type is", "list"), "TRUE", "FALSE"),
    (D.Rule("data.total", "count at least", "1"), "FALSE", "TRUE"),
    (D.Rule("data.items[5]", "not null"), "FALSE", "FALSE"),
    (D.Rule("response.status_code", "equals", "200"), "status_code = 200", "FALSE"),
    (D.Rule("data.userId", "bogus", "1"), "FALSE", "TRUE"),
]
_DOCS = f"""(SELECT o.o_orderkey, d.status_code, lower(o.o_orderstatus) AS status, o.o_custkey AS uid, o.o_orderpriority AS priority,
    o.o_totalprice AS total, o.o_orderkey % 3 = 0 AS paid, o.o_orderkey % 4 < 3 AS has_note, o.o_orderkey % 4 = 0 AS note_null,
    CASE o.o_orderkey % 4 WHEN 1 THEN '' WHEN 2 THEN 'call' ELSE '-' END AS note, d.body,
    o.o_orderkey % 100 NOT IN (3, 5, 7) AS valid
    FROM orders o JOIN {star.ORDER_DOCUMENTS} d ON d.o_orderkey = o.o_orderkey)"""


def _rule_sql() -> str:
    parts = []
    for i, (r, ok, warn) in enumerate(RULES, start=1):
        q = r.path.replace("'", "''")
        parts.append(
            f"SELECT o_orderkey, {i} AS rule, '{q}' AS path, '{r.operator}' AS operator, CASE WHEN {warn} THEN 'warn' "
            f"WHEN {ok} THEN 'pass' ELSE 'fail' END AS status FROM {_DOCS} d WHERE valid"
        )
    return " UNION ALL ".join(parts)


def _parsed(env):
    docs = star.order_documents(env).withColumn("doc", D.parse(F.col("body"))).drop("body")
    return docs.filter(F.col("doc").isNotNull())


@query(_rule_sql())
def json_rules(env):
    results = DO.check_rules(_parsed(env), "doc", [r for r, _, _ in RULES], status_code="status_code")
    return results.select("o_orderkey", "rule", "path", "operator", "status")


@query(f"""{_rule_sql()} UNION ALL SELECT o_orderkey, 0, '', 'is JSON', CASE WHEN valid THEN 'pass' ELSE 'fail' END FROM {_DOCS} d""")
def json_rules_all(env):
    """Texts that are no JSON included."""
    results = DO.check_texts(star.order_documents(env), "body", [r for r, _, _ in RULES], status_code="status_code")
    return results.select("o_orderkey", "rule", "path", "operator", "status")


@query(f"""SELECT rule, path, operator, count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'fail') AS fail,
    count(*) FILTER (WHERE status = 'warn') AS warn FROM ({_rule_sql()}) GROUP BY ALL""")
def json_rule_counts(env):
    return DO.rule_counts(DO.check_rules(_parsed(env), "doc", [r for r, _, _ in RULES], status_code="status_code"))


@query(f"""SELECT o_orderkey, path, type, shown FROM (
    SELECT o_orderkey, 'data.id' AS path, 'number' AS type, CAST(o_orderkey AS VARCHAR) AS shown FROM {_DOCS} d WHERE valid
    UNION ALL SELECT o_orderkey, 'data.userId', 'string', CAST(uid AS VARCHAR) FROM {_DOCS} d WHERE valid
    UNION ALL SELECT o_orderkey, 'data.status', 'string', status FROM {_DOCS} d WHERE valid
    UNION ALL SELECT o_orderkey, 'data.items', 'list', '["' || priority || '","gift"]' FROM {_DOCS} d WHERE valid
    UNION ALL SELECT o_orderkey, 'data.items[0]', 'string', priority FROM {_DOCS} d WHERE valid
    UNION ALL SELECT o_orderkey, 'data.items[1]', 'string', 'gift' FROM {_DOCS} d WHERE valid
    UNION ALL SELECT o_orderkey, 'data.total', 'number', regexp_replace(CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR), '\\.?0+$', '') FROM {_DOCS} d WHERE valid
    UNION ALL SELECT o_orderkey, 'data.note', CASE WHEN note_null THEN 'null' ELSE 'string' END, CASE WHEN note_null THEN 'NULL' ELSE note END
        FROM {_DOCS} d WHERE valid AND has_note
    UNION ALL SELECT o_orderkey, 'data.paid', 'boolean', CASE WHEN paid THEN 'true' ELSE 'false' END FROM {_DOCS} d WHERE valid)""")
def json_flatten(env):
    flat = DO.flatten_documents(_parsed(env).drop("status_code"), "doc")
    # numbers of two decimals print without trailing zeros
    shown = F.when((F.col("path") == "data.total") & F.col("shown").contains("."), F.regexp_replace("shown", r"\.?0+$", "")).otherwise(F.col("shown"))
    return flat.select("o_orderkey", "path", "type", shown.alias("shown"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_paths(env):
    doc = D.parse(F.col("props"))
    return env.table("events").select("event_id", F.try_variant_get(doc, D.spark_path("k"), "bigint").alias("k"))


MAPPING = [
    {"api_field": "data.id", "db_column": "o_orderkey"},
    {"api_field": "data.status", "db_column": "o_orderstatus"},
    {"api_field": "data.total", "db_column": "o_totalprice"},
    {"api_field": "data.items[0]", "db_column": "o_orderpriority"},
    {"api_field": "data.plan", "db_column": "o_custkey"},
    {"api_field": "data.userId", "db_column": "no_such_column"},
    {"api_field": "data.extra", "db_column": "no_such_column"},
]
# orders B as the table: status X on % 50, no priority on % 60 = 1, no row on % 97, two rows on % 211
_VERDICTS = f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderstatus NULLS FIRST, o_totalprice NULLS FIRST,
        o_orderpriority NULLS FIRST) AS rn, count(*) OVER (PARTITION BY o_orderkey) AS n FROM {star.ORDERS_B} b),
    j AS (SELECT d.*, t.n, t.o_orderstatus AS s, t.o_totalprice AS p, t.o_orderpriority AS pr FROM {_DOCS} d
        LEFT JOIN t ON t.o_orderkey = d.o_orderkey AND t.rn = 1 WHERE valid),
    v AS (SELECT o_orderkey, coalesce(n, 0) AS db_rows, 'data.id' AS field, CASE WHEN n IS NULL THEN 'Missing in DB' ELSE 'Match' END AS result FROM j
      UNION ALL SELECT o_orderkey, coalesce(n, 0), 'data.status', CASE WHEN n IS NULL THEN 'Missing in DB' WHEN lower(s) = status THEN 'Match' ELSE 'Mismatch' END FROM j
      UNION ALL SELECT o_orderkey, coalesce(n, 0), 'data.total', CASE WHEN n IS NULL THEN 'Missing in DB'
          WHEN CAST(p AS DECIMAL(18,2)) = CAST(total AS DECIMAL(18,2)) THEN 'Match' ELSE 'Mismatch' END FROM j
      UNION ALL SELECT o_orderkey, coalesce(n, 0), 'data.items[0]', CASE WHEN n IS NULL THEN 'Missing in DB' WHEN pr = priority THEN 'Match' ELSE 'Mismatch' END FROM j
      UNION ALL SELECT o_orderkey, coalesce(n, 0), 'data.plan', CASE WHEN n IS NULL THEN 'Missing in API and DB' ELSE 'Missing in API' END FROM j
      UNION ALL SELECT o_orderkey, coalesce(n, 0), 'data.userId', 'Missing in DB' FROM j
      UNION ALL SELECT o_orderkey, coalesce(n, 0), 'data.extra', 'Missing in API and DB' FROM j)"""


def _verdicts(env, mapping=MAPPING):
    return DO.field_verdicts(_parsed(env), "doc", star.orders_b(env), ("data.id", "o_orderkey"), mapping, keep=["o_orderkey"])


@query(_VERDICTS + """ SELECT o_orderkey, db_rows, field, result, CASE result WHEN 'Match' THEN '' WHEN 'Mismatch' THEN 'API ≠ DB'
    WHEN 'Missing in DB' THEN 'DB' WHEN 'Missing in API' THEN 'API' ELSE 'API, DB' END AS "where" FROM v""")
def field_verdicts(env):
    return _verdicts(env).select("o_orderkey", "db_rows", "field", "result", "where")


@query(_VERDICTS + """ SELECT count(*) FILTER (WHERE result = 'Match') AS match, count(*) FILTER (WHERE result = 'Mismatch') AS mismatch,
    count(*) FILTER (WHERE result LIKE 'Missing in API%') AS missing_in_api,
    count(*) FILTER (WHERE result IN ('Missing in DB', 'Missing in API and DB')) AS missing_in_db FROM v""")
def field_verdict_counts(env):
    return DO.verdict_counts(_verdicts(env))


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderstatus NULLS FIRST) AS rn FROM {star.ORDERS_B} b),
    j AS (SELECT d.o_orderkey, status, lower(t.o_orderstatus) AS s, t.o_orderkey IS NULL AS gone FROM {_DOCS} d
        LEFT JOIN t ON t.o_orderkey = d.o_orderkey AND t.rn = 1 WHERE valid)
    SELECT o_orderkey, CASE WHEN gone THEN 'Missing in DB' WHEN status = 'f' AND s = 'f' THEN 'Match' ELSE 'Mismatch' END AS result,
    CASE WHEN gone THEN 'DB' WHEN status = 'f' AND s = 'f' THEN '' WHEN status <> 'f' AND s <> 'f' AND status <> s THEN 'API and DB both differ from expected'
         WHEN status <> 'f' AND s <> 'f' THEN 'API and DB agree, but differ from expected'
         WHEN status <> 'f' THEN 'API differs from expected (DB is correct)' ELSE 'DB differs from expected (API is correct)' END AS "where" FROM j""")
def field_verdicts_expected(env):
    mapping = [{"api_field": "data.status", "db_column": "o_orderstatus", "expected": "f"}]
    return _verdicts(env, mapping).select("o_orderkey", "result", "where")


@query(f"""SELECT CAST(json_extract_string(body, '$.c_custkey') AS BIGINT) AS k, field, api, db, result FROM (
    SELECT '{{"c_custkey":' || c_custkey || '}}' AS body, 'email' AS field, {_email_sql('email')} AS api, {_email_sql("'x.' || email")} AS db, 'Mismatch' AS result
        FROM {star.CONTACTS} c
    UNION ALL SELECT '{{"c_custkey":' || c_custkey || '}}', 'mobile_number', coalesce({_phone_sql('mobile_number')}, 'NULL'),
        coalesce({_phone_sql('mobile_number')}, 'NULL'), 'Match' FROM {star.CONTACTS} c
    UNION ALL SELECT '{{"c_custkey":' || c_custkey || '}}', 'api_token', '•••• hidden', '•••• hidden', 'Match' FROM {star.CONTACTS} c)""")
def field_verdicts_masked(env):
    c = star.contacts(env)
    docs = c.select(F.col("c_custkey").alias("k"), F.to_variant_object(
        F.struct("c_custkey", "email", F.col("mobile_number"), "api_token")).alias("doc"))
    # a struct keeps NULL members, so the documents hold JSON nulls
    table = c.withColumn("email", F.concat(F.lit("x."), F.col("email")))
    mapping = [{"api_field": f, "db_column": f} for f in ("email", "mobile_number", "api_token")]
    verdicts = DO.field_verdicts(docs, "doc", table, ("c_custkey", "c_custkey"), mapping, keep=["k"])
    return DO.mask_verdicts(verdicts).select("k", "field", "api", "db", "result")


@query(f"""SELECT * FROM (VALUES ('data.userId', 'user_id'), ('data.status', 'STATUS'), ('data.items', 'items')) v(api_field, db_column)
    WHERE (SELECT count(*) FROM {_DOCS} d WHERE valid) > 0""")
def auto_map(env):
    """Field names found in the documents paired with the columns of an application table."""
    flat = D.flatten(_parsed(env).drop("status_code", "o_orderkey"), "doc", max_depth=4)
    k = env.table("orders").select(F.col("o_orderkey").alias("order_ref"), F.col("o_custkey").alias("user_id"),
                                   F.col("o_orderstatus").alias("STATUS"), F.lit("").alias("items"), F.lit("").alias("Items"))
    columns = C.catalog_columns(env.with_tables(app=k).only("app"))
    return DO.auto_map(flat.filter(~F.col("path").contains("[")), columns)


# ---------------------------------------------------------------- privacy
@query(f"""SELECT c_custkey, c_name, {_email_sql('email')} AS email, {_phone_sql('mobile_number')} AS mobile_number,
    {_phone_sql('CAST(phone2 AS VARCHAR)')} AS phone2, '•••• hidden' AS password, '•••• hidden' AS api_token, status, is_deleted,
    {_email_sql('note')} AS note FROM {star.CONTACTS} c""")
def mask_columns(env):
    return P.mask(star.contacts(env))


@query(f"""SELECT c_custkey, c_name, email, mobile_number, phone2, '•••• hidden' AS password, '•••• hidden' AS api_token, status, is_deleted, note
    FROM {star.CONTACTS} c""")
def mask_secrets_only(env):
    return P.mask(star.contacts(env), show_personal=True)


_SECRETISH = (r"""(?i)("?(?:password|passwd|token|access_token|refresh_token|api_key|secret|otp|authorization|aadhaar|pan)"?\s*[:=]\s*)"""
              r"""("[^"]*"|''[^'']*''|[^\s,}]+)""")


def _scrub_sql(c: str) -> str:
    secret = f"regexp_replace({c}, '{_SECRETISH}', '\\1\"•••• hidden\"', 'g')"
    mail = _email_sql(secret)
    phone = r"'(^|\D)(\+?\d{2})\d{6,9}(\d{2})($|\D)', '\1\2••••••\3\4', 'g'"
    # twice: neighbouring numbers share the character between them
    return f"regexp_replace(regexp_replace({mail}, {phone}), {phone})"


@query(f"SELECT doc_id, md5({_scrub_sql('text')}) AS scrubbed, {_scrub_sql('text')} <> text AS changed FROM documents")
def scrub_documents(env):
    scrubbed = P.scrub(F.col("text"))
    return env.table("documents").select("doc_id", scrubbed.alias("s"), "text").select(
        "doc_id", F.md5("s").alias("scrubbed"), (F.col("s") != F.col("text")).alias("changed"))


_RAW = """(SELECT c_custkey, 'Call +91' || CAST(9000000000 + c_custkey AS VARCHAR) || ' or 98765' || CAST(10000 + c_custkey AS VARCHAR)
    || ', mail ' || lower(replace(c_name, '#', '.')) || '@example.com {"token": "abc' || c_custkey || '", "password":"p"} otp=' || c_custkey
    || ' id ' || CAST(123456 + c_custkey AS VARCHAR) AS raw FROM customer)"""


@query(f"SELECT c_custkey, {_scrub_sql('raw')} AS text FROM {_RAW} r")
def scrub_text(env):
    k = F.col("c_custkey")
    raw = F.concat(
        F.lit("Call +91"), (k + 9000000000).cast("string"), F.lit(" or 98765"), (k + 10000).cast("string"), F.lit(", mail "),
        F.lower(F.regexp_replace("c_name", "#", ".")), F.lit('@example.com {"token": "abc'), k.cast("string"),
        F.lit('", "password":"p"} otp='), k.cast("string"), F.lit(" id "), (k + 123456).cast("string"))
    return env.table("customer").select("c_custkey", P.scrub(raw).alias("text"))


# ---------------------------------------------------------------- query log
_LOG_SQL = """CASE event_type WHEN 'click' THEN 'SELECT * FROM orders WHERE o_custkey = ' || CAST(event_id % 40 AS VARCHAR)
    WHEN 'view' THEN 'select o_orderkey from orders where year(o_orderdate) = 1997 or mobile = ''•••'' limit 10'
    WHEN 'signup' THEN 'SELECT c.* FROM customer c WHERE c.email LIKE ''%u•••@example.com'''
    WHEN 'purchase' THEN 'SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) '
    ELSE 'SELECT p_name FROM part WHERE phone_no IN (''•••'', ''•••'') ORDER BY RAND() LIMIT 5' END"""


@query(f"""SELECT event_id AS log_id, CASE WHEN event_type = 'signup' THEN replace({_LOG_SQL}, '%u•••', '%•••') ELSE {_LOG_SQL} END AS sql,
    CASE WHEN event_type = 'error' THEN 'no such column near token = ''•••''' END AS error FROM events""")
def query_log_scrubbed(env):
    return QL.scrubbed_log(star.query_log(env)).select("log_id", "sql", "error")


@query("""SELECT level, flag, count(*) AS queries FROM events JOIN (VALUES ('click', 'select_star', 'low'), ('click', 'no_limit', 'low'),
    ('view', 'function_on_column', 'medium'), ('view', 'or_in_filter', 'low'),
    ('signup', 'select_star', 'low'), ('signup', 'no_limit', 'low'), ('signup', 'leading_wildcard', 'medium'),
    ('purchase', 'not_in_select', 'low'), ('error', 'order_by_rand', 'medium')) v(t, flag, level) ON event_type = t GROUP BY ALL""")
def query_log_lint(env):
    return QL.lint_summary(star.query_log(env))


@query("""SELECT "table", count(*) AS queries FROM events JOIN (VALUES ('click', 'orders'), ('view', 'orders'), ('signup', 'customer'),
    ('purchase', 'lineitem'), ('purchase', 'orders'), ('error', 'part')) v(t, "table") ON event_type = t GROUP BY ALL""")
def query_log_tables(env):
    names = C.local_frame(env.spark, [(t,) for t in env.tables], "name string")
    return QL.tables_used(star.query_log(env), names)


@query(f"""SELECT sql, count(*) AS runs, strftime(max(ran_at), '%Y-%m-%d %H:%M:%S') AS last_run FROM {star.QUERY_LOG} l GROUP BY sql""")
def query_log_usage(env):
    used = QL.usage(star.query_log(env))
    return used.select("sql", "runs", F.date_format("last_run", "yyyy-MM-dd HH:mm:ss").alias("last_run"))


@query(f"SELECT log_id FROM {star.QUERY_LOG} l WHERE connection = 'db1' AND error IS NOT NULL AND contains(lower(sql), 'part') AND username = 'user7'")
def query_log_filtered(env):
    return QL.filter_log(star.query_log(env), "db1", False, "PART", "user7").select("log_id")
