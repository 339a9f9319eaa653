"""Scans, filters, projections, profiles and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.functions import values as V
from plumbline.operators import edge_cases as EC
from plumbline.operators import filters as FL
from plumbline.operators import profile as PF
from plumbline.operators import profile_store as PS
from plumbline.plans import star
from plumbline.plans.registry import query
from plumbline.sources import catalog as C
from plumbline.sources.stores import json_documents

# ---------------------------------------------------------------- filters
FILTER_CASES = [
    # name, table, key column, column, operator, value, SQL condition
    ("equals", "orders", "o_orderkey", "o_orderstatus", "equals", "F", "o_orderstatus = 'F'"),
    ("equals_number", "lineitem", "l_orderkey", "l_quantity", "equals", "30", "l_quantity = 30"),
    ("equals_not_castable", "orders", "o_orderkey", "o_custkey", "equals", "abc", "FALSE"),
    ("not_equal", "orders_b", "o_orderkey", "o_orderpriority", "not equal", "5-LOW",
     "o_orderpriority <> '5-LOW' OR o_orderpriority IS NULL"),
    ("not_equal_not_castable", "orders", "o_orderkey", "o_custkey", "not equal", "abc", "TRUE"),
    ("contains", "documents", "doc_id", "text", "contains", "th%an_er", "text LIKE '%th%an_er%'"),
    ("starts_with", "part", "p_partkey", "p_name", "starts with", "red", "p_name LIKE 'red%'"),
    ("ends_with", "part", "p_partkey", "p_name", "ends with", "ring", "p_name LIKE '%ring'"),
    ("greater_than", "orders", "o_orderkey", "o_totalprice", "greater than", "250000.5", "o_totalprice > 250000.5"),
    ("less_than", "orders", "o_orderkey", "o_orderdate", "less than", "1996-06-01", "o_orderdate < TIMESTAMP '1996-06-01'"),
    ("at_least", "part", "p_partkey", "p_size", "at least", "25", "p_size >= 25"),
    ("at_most", "customer", "c_custkey", "c_acctbal", "at most", "0", "c_acctbal <= 0"),
    ("between", "orders", "o_orderkey", "o_orderdate", "between", "1996-01-01, 1996-12-31",
     "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'"),
    ("between_one_value", "part", "p_partkey", "p_size", "between", "5", "TRUE"),
    ("one_of", "orders", "o_orderkey", "o_custkey", "one of", "101, 102,, 103 ", "o_custkey IN (101, 102, 103)"),
    ("is_empty", "orders_b", "o_orderkey", "o_orderpriority", "is empty", "", "o_orderpriority IS NULL OR o_orderpriority = ''"),
    ("is_empty_number", "orders", "o_orderkey", "o_custkey", "is empty", "", "o_custkey IS NULL"),
    ("is_not_empty", "orders_b", "o_orderkey", "o_orderpriority", "is not empty", "",
     "o_orderpriority IS NOT NULL AND o_orderpriority <> ''"),
]


def _filter_query(table, key, column, op, value):
    def run(env):
        df = star.orders_b(env) if table == "orders_b" else env.table(table)
        out = FL.apply_filters(df, [{"col": column, "op": op, "val": value}])
        return out.select(F.col(key).alias("key"))

    return run


for _name, _table, _key, _column, _op, _value, _cond in FILTER_CASES:
    _from = f"{star.ORDERS_B} b" if _table == "orders_b" else _table
    query(f"SELECT {_key} AS key FROM {_from} WHERE {_cond}", name=f"filter_{_name}")(
        _filter_query(_table, _key, _column, _op, _value)
    )


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_orderpriority LIKE '%HIGH%'")
def filter_list(env):
    return FL.apply_filters(env.table("orders"), [
        {"col": "o_orderstatus", "op": "equals", "val": " F "},
        {"col": "o_totalprice", "op": "greater than", "val": "100000"},
        {"col": "o_orderpriority", "op": "contains", "val": "HIGH"},
        {"col": "no_such_column", "op": "equals", "val": "1"},
        {"col": "o_custkey", "op": "no such operator", "val": "1"},
        {"col": "o_custkey", "op": "equals", "val": "  "},
    ]).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE lower(p_type) = 'economy'")
def filter_case_insensitive(env):
    return FL.apply_filters(env.table("part"), [{"col": "p_type", "op": "equals", "val": "Economy"}], True).select("p_partkey")


@query(f"SELECT c_custkey, c_name, email, mobile_number, phone2, status, is_deleted, note FROM {star.CONTACTS} c")
def scan_safe_columns(env):
    return env.with_tables(contacts=star.contacts(env)).safe_table("contacts")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'
          ORDER BY o_totalprice DESC, o_orderkey, o_custkey LIMIT 500""")
def browse_sorted(env):
    return FL.browse(env, "orders", ["o_orderkey", "o_custkey", "o_totalprice"],
                     [{"col": "o_orderstatus", "op": "equals", "val": "O"}], "o_totalprice", True, 500)


@query("SELECT count(*) AS rows FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05")
def count_matching_rows(env):
    return FL.count_matching(env.table("lineitem"), [
        {"col": "l_returnflag", "op": "equals", "val": "R"}, {"col": "l_discount", "op": "at least", "val": "0.05"}])


@query("SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 200000) > 1000 AS truncated")
def limit_truncated(env):
    rows = FL.apply_filters(env.table("orders"), [{"col": "o_totalprice", "op": "greater than", "val": "200000"}])
    return FL.limited(rows, 1000)[1]


@query("""SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
          FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 1000 GROUP BY o_custkey""")
def named_values(env):
    with env.as_views(["orders"]) as session:
        return FL.named_query(
            session,
            "SELECT o_custkey, count(*) AS orders, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders "
            "WHERE o_orderstatus = :status AND o_totalprice >= :low GROUP BY o_custkey",
            {"status": "F", "low": 1000},
        )


@query("SELECT l_returnflag AS value, count(*) AS rows FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
def identifier_parameters(env):
    return FL.template_query(
        env,
        "SELECT IDENTIFIER(:column) AS value, count(*) AS rows FROM IDENTIFIER(:table) "
        "WHERE IDENTIFIER(:measure) > :low GROUP BY IDENTIFIER(:column)",
        {"table": "lineitem", "column": "l_returnflag", "measure": "l_quantity"}, {"low": 25},
        {"column": "table", "measure": "table"},
    )


@query("""SELECT a.doc_id AS doc_id, a.source AS source, b.doc_id AS doc_id_1 FROM documents a JOIN labels b ON a.doc_id = b.doc_id""")
def unique_column_names(env):
    d, lab = env.table("documents").select("doc_id", "source").alias("d"), env.table("labels").select("doc_id").alias("l")
    return FL.unique_names(d.join(lab, F.col("d.doc_id") == F.col("l.doc_id")))


# ---------------------------------------------------------------- profiles
@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS rows FROM orders WHERE o_totalprice > 50000 GROUP BY ALL""")
def group_counts(env):
    return PF.group_counts(env.table("orders"), ["o_orderstatus", "o_orderpriority"],
                           [{"col": "o_totalprice", "op": "greater than", "val": "50000"}])


@query("SELECT user_id, count(*) AS rows FROM events GROUP BY user_id ORDER BY rows DESC, user_id LIMIT 50")
def group_top(env):
    return PF.group_counts(env.table("events"), ["user_id"], limit=50)


@query(f"""SELECT o_orderpriority AS value, count(*) AS row_count FROM {star.ORDERS_B} b GROUP BY 1
           ORDER BY row_count DESC, value NULLS FIRST LIMIT 100""")
def status_breakdown(env):
    return PF.status_breakdown(star.orders_b(env), "o_orderpriority", 100)


@query(f"""SELECT count(*) AS total_rows,
           count(*) FILTER (WHERE o_orderpriority IS NULL OR trim(o_orderpriority) = '') AS missing_rows FROM {star.ORDERS_B} b""")
def missing_values(env):
    return PF.missing_values(star.orders_b(env), "o_orderpriority")


@query("""SELECT count(*) AS duplicated_values, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_involved FROM (
          SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
          GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
def duplicates_summary(env):
    return PF.duplicates(env.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT count(*) AS duplicated_values, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_involved FROM (
          SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)""")
def duplicate_texts(env):
    return PF.duplicates(env.table("documents"), ["text"], long_values=True)


@query("""SELECT p_name, count(*) AS copies FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1
          ORDER BY copies DESC, p_name LIMIT 50""")
def most_repeated_values(env):
    return PF.most_repeated(env.table("part"), ["p_name"], 50)


@query("SELECT event_type, user_id, count(*) AS rows FROM events GROUP BY ALL")
def chart_counts(env):
    return PF.chart_counts(env.table("events"), "event_type", "user_id")


def _digits(c: str) -> str:
    return rf"regexp_replace(CAST(CAST({c} AS DECIMAL(38,9)) AS VARCHAR), '\.?0+$', '')"


def _profile_sql(source: str, fields: list[tuple[str, str]], limits: dict | None = None, where: str = "") -> str:
    """fields: (column, kind) with kinds text, number, double, date, distinct, none."""
    parts = []
    for c, kind in fields:
        text = kind.startswith("text")
        ranged = kind in ("number", "double", "date")
        shown = {
            "number": lambda e: f"CAST({e} AS VARCHAR)", "double": _digits,
            "date": lambda e: f"strftime({e}, '%Y-%m-%d %H:%M:%S.%f')",
        }.get(kind, lambda e: "CAST(NULL AS VARCHAR)")
        name = {"number": "integer", "double": "decimal", "distinct": "boolean", "personal": "integer"}.get(kind, kind)
        number = kind in ("number", "double")
        parts.append(f"""SELECT count(*) AS rows, '{c}' AS "column", '{name}' AS kind,
            count(*) - count({c}) AS nulls,
            {f"CAST(sum(CAST({c} = '' AS INT)) AS BIGINT)" if text else "CAST(NULL AS BIGINT)"} AS empty,
            {f"CAST(sum(CAST({c} <> trim({c}) AS INT)) AS BIGINT)" if text else "CAST(NULL AS BIGINT)"} AS spaces,
            {f"CAST(max(length({c})) AS BIGINT)" if text else "CAST(NULL AS BIGINT)"} AS longest,
            {f"CAST(sum(CAST({c} = 0 AS INT)) AS BIGINT)" if number else "CAST(NULL AS BIGINT)"} AS zero,
            {f"CAST(sum(CAST({c} < 0 AS INT)) AS BIGINT)" if number else "CAST(NULL AS BIGINT)"} AS negative,
            {shown(f"min({c})") if ranged else "CAST(NULL AS VARCHAR)"} AS min,
            {shown(f"max({c})") if ranged else "CAST(NULL AS VARCHAR)"} AS max,
            CAST({(limits or {}).get(c, 'NULL')} AS BIGINT) AS "limit",
            {f"count(DISTINCT {c})" if kind == "distinct" else "CAST(NULL AS BIGINT)"} AS "distinct"
            FROM {source} t {where}""")
    return " UNION ALL ".join(parts)


@query(_profile_sql(star.ORDERS_B, [("o_orderkey", "number"), ("o_custkey", "number"), ("o_orderstatus", "text"),
                                    ("o_totalprice", "double"), ("o_orderdate", "date"), ("o_orderpriority", "text")],
                    {"o_orderpriority": 15}))
def coverage_profile(env):
    return PF.profile(star.orders_b(env), limits={"o_orderpriority": 15})


@query(_profile_sql("lineitem", [(c, "number" if c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber") else
                                  "text" if c in ("l_returnflag", "l_linestatus") else "date" if c == "l_shipdate" else "double")
                                 for c in star.TABLES["lineitem"]]))
def coverage_profile_lineitem(env):
    return PF.profile(env.table("lineitem"))


@query(_profile_sql("documents", [("doc_id", "number"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "number")]))
def coverage_profile_documents(env):
    return PF.profile(env.table("documents"))


@query(_profile_sql(star.CONTACTS, [("c_custkey", "number"), ("c_name", "text"), ("email", "text"), ("mobile_number", "text"),
                                    ("phone2", "personal"), ("status", "text"), ("is_deleted", "distinct"), ("note", "text")]))
def coverage_profile_contacts(env):
    return PF.profile(star.contacts(env))


@query(_profile_sql("(SELECT * FROM events ORDER BY event_id DESC LIMIT 5000)",
                    [("event_id", "number"), ("ts", "date"), ("user_id", "number"), ("event_type", "text"),
                     ("value", "double"), ("props", "text")]))
def coverage_profile_newest(env):
    return PF.profile(env.table("events"), sample_newest=5000, pk="event_id")


def _key_sql(table: str, columns: list[str]) -> str:
    out = []
    for i, c in enumerate(columns):
        rank = i if c == "id" or c.endswith("_id") else len(columns) + i
        text = f"coalesce(CAST({c} AS VARCHAR), 'None')"
        out.append(f"""SELECT '{c}' AS "column", {rank} AS rank FROM {table} HAVING count(*) = count(DISTINCT {text})""")
    return " UNION ALL ".join(out)


@query(_key_sql("orders", star.TABLES["orders"]))
def key_candidates(env):
    return PF.key_candidates(env.table("orders"))


@query(_key_sql("events", star.TABLES["events"]))
def key_candidates_events(env):
    return PF.key_candidates(env.table("events"))


@query("""SELECT event_type AS value, count(*) AS rows, max(event_id) AS example FROM events GROUP BY event_type
          ORDER BY rows DESC, value LIMIT 50""")
def examples_per_value(env):
    return PF.examples_per_value(env.table("events"), "event_type", "event_id", 50)


_PII = "SELECT count(*) AS rows, '{c}' AS \"column\", '{named}' AS named, {cells} FROM {src} t"
_EMAIL_SQL = r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_PHONE_SQL = r"(^|\D)\+?\d{10,13}($|\D)"
_SECRET_SQL = (r"""(?i)"?(?:password|passwd|token|access_token|refresh_token|api_key|secret|otp|authorization|aadhaar|pan)"?"""
               r"""\s*[:=]\s*("[^"]*"|''[^'']*''|[^\s,}]+)""")


def _pii_sql(source: str, fields: list[tuple[str, bool, str]]) -> str:
    parts = []
    for c, text, named in fields:
        conds = {
            "email_rows": f"regexp_matches({c}, '{_EMAIL_SQL}')", "at_rows": f"contains({c}, '@')",
            "phone_rows": f"regexp_matches({c}, '{_PHONE_SQL}')", "secret_rows": f"regexp_matches({c}, '{_SECRET_SQL}')",
        }
        cells = ", ".join(
            (f"count(*) FILTER (WHERE {cond})" if text else "CAST(0 AS BIGINT)") + f" AS {n}" for n, cond in conds.items()
        )
        parts.append(_PII.format(c=c, named=named, cells=cells, src=source))
    return " UNION ALL ".join(parts)


@query(_pii_sql("documents", [("doc_id", False, ""), ("text", True, ""), ("lang", True, ""), ("source", True, ""), ("n_chars", False, "")]))
def pii_scan_documents(env):
    return PF.pii_scan(env.table("documents"))


_TEXTS = {"region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"], "part": ["p_name", "p_brand", "p_type"],
          "orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
          "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"], "conversations": ["role", "text"]}


def _pii_catalog_sql() -> str:
    parts = []
    for t, columns in star.TABLES.items():
        for c in columns:
            if c in _TEXTS.get(t, ()):
                tests = {"email": f"regexp_matches({c}, '{_EMAIL_SQL}')", "at": f"contains({c}, '@')", "phone": f"regexp_matches({c}, '{_PHONE_SQL}')",
                         "secret": f"regexp_matches({c}, '{_SECRET_SQL}')"}
            else:
                tests = {"": "FALSE"}
            parts += [f"SELECT '{t}' AS tbl, '{c}' AS \"column\", '' AS named, '{d}' AS detector, count(*) AS rows, count(*) FILTER ({cond}) AS hits FROM {t}" for d, cond in tests.items()]
    return " UNION ALL ".join(parts)


@query(_pii_catalog_sql())
def pii_catalog(env):
    """Every detector on every text cell of all tables."""
    return PF.pii_merged(PF.pii_catalog(env), "tbl").drop("distinct_texts")


@query(_pii_sql(star.CONTACTS, [
    ("c_custkey", False, ""), ("c_name", True, ""), ("email", True, ""), ("mobile_number", True, "personal"),
    ("phone2", False, "personal"), ("password", True, "secret"), ("api_token", True, "secret"), ("status", True, ""),
    ("is_deleted", False, ""), ("note", True, "")]))
def pii_scan_contacts(env):
    return PF.pii_scan(star.contacts(env))


# ---------------------------------------------------------------- edge cases
def _case_sql(source: str, cases: list[tuple[str, str, str, str, str | None]]) -> str:
    cells = ", ".join(
        f"count(*) FILTER (WHERE {cond}) AS n{i}" if cond else f"CAST(NULL AS BIGINT) AS n{i}"
        for i, (*_, cond) in enumerate(cases)
    )
    rows = " UNION ALL ".join(
        f"""SELECT rows, '{c.replace("'", "''")}' AS "column", '{cat}' AS category, '{case.replace("'", "''")}' AS "case",
            '{ex.replace("'", "''")}' AS example, n{i} AS rows_showing FROM counted"""
        for i, (c, cat, case, ex, _) in enumerate(cases)
    )
    return f"WITH counted AS (SELECT count(*) AS rows, {cells} FROM {source} t) {rows}"


def _text_cases(c: str) -> list[tuple[str, str, str, str, str | None]]:
    return [
        (c, "Empty / NULL", "NULL", "NULL", f"{c} IS NULL"),
        (c, "Empty / NULL", "Empty string", "''", f"{c} = ''"),
        (c, "Empty / NULL", "Only spaces", "'   '", f"{c} <> '' AND trim({c}) = ''"),
        (c, "Format", "Unicode / emoji", "नमस्ते 😀", rf"regexp_matches({c}, '[^\x00-\x7F]')"),
        (c, "Format", "Leading / trailing spaces", "' value '", f"{c} <> trim({c})"),
    ]


def _int_cases(c: str, high: int) -> list[tuple[str, str, str, str, str | None]]:
    low = -high - 1
    return [
        (c, "Empty / NULL", "NULL", "NULL", f"{c} IS NULL"),
        (c, "Range", "Zero", "0", f"{c} = 0"),
        (c, "Range", "Negative", "-1", f"{c} < 0"),
        (c, "Range", "Largest value", str(high), f"{c} = {high}"),
        (c, "Range", "One above largest", str(high + 1), None),
        (c, "Range", "Smallest value", str(low), f"{c} = {low}"),
        (c, "Format", "Non-number input", "'12abc'", None),
    ]


def _date_cases(c: str) -> list[tuple[str, str, str, str, str | None]]:
    return [
        (c, "Empty / NULL", "NULL", "NULL", f"{c} IS NULL"),
        (c, "Dates", "Leap day", "2028-02-29", f"strftime({c}, '%m-%d') = '02-29'"),
        (c, "Dates", "Invalid day", "2027-02-29", None),
        (c, "Dates", "Zero date", "0000-00-00", f"year({c}) < 1"),
        (c, "Dates", "Month / year end", "2026-12-31 23:59:59", f"CAST({c} AS DATE) = last_day({c})"),
        (c, "Dates", "Timezone boundary", "2026-03-31 18:30:00 (UTC) = 00:00 IST",
         f"CAST({c} AS DATE) <> CAST({c} + INTERVAL 330 MINUTE AS DATE)"),
        (c, "Dates", "Future", "2099-01-01", f"year({c}) >= 2099"),
    ]


def _double_cases(c: str, ideas=()) -> list[tuple[str, str, str, str, str | None]]:
    return [
        (c, "Empty / NULL", "NULL", "NULL", f"{c} IS NULL"),
        (c, "Range", "Zero and negative", "0 / -0.01", f"{c} <= 0"),
        *ideas,
    ]


LONG = 2**63 - 1
INT = 2**31 - 1


def _price_ideas(c: str):
    return [
        (c, "Range", "Zero", "", f"{c} = 0"), (c, "Range", "Negative", "", f"{c} < 0"),
        (c, "Range", "Many decimals", "", f"round({c}, 2) <> {c}"),
    ]


@query(_case_sql("events", [
    *_int_cases("event_id", LONG), ("event_id", "Uniqueness", "Duplicate value", "(same as an existing row)", None),
    *_date_cases("ts"), *_int_cases("user_id", LONG),
    ("user_id", "Links", "Points to a missing customer", "a value that does not exist", None),
    *_text_cases("event_type"), *_double_cases("value"), *_text_cases("props"),
]))
def edge_cases_events(env):
    return EC.edge_cases(env.table("events"), keys=["event_id"], links={"user_id": "customer"})


@query(_case_sql("part", [
    *_int_cases("p_partkey", LONG), *_text_cases("p_name"),
    ("p_name", "Format", "Unicode", "", r"regexp_matches(p_name, '[^\x00-\x7F]')"),
    ("p_name", "Format", "Apostrophe", "", "contains(p_name, '''')"),
    ("p_name", "Format", "HTML", "", "regexp_matches(p_name, '<[A-Za-z/][^>]*>')"),
    *_text_cases("p_brand"),
    *_text_cases("p_type"), ("p_type", "Length", "Exactly 7 characters", "(7)", "length(p_type) = 7"),
    ("p_type", "Length", "8 characters", "(8 chars)", "length(p_type) > 7"),
    *_int_cases("p_size", INT), *_double_cases("p_retailprice", _price_ideas("p_retailprice")),
]))
def edge_cases_part(env):
    return EC.edge_cases(env.table("part"), limits={"p_type": 7})


_SHIPPED = "(SELECT l_shipdate, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(_case_sql(_SHIPPED, [
    ("o_orderdate, l_shipdate", "Across columns", "l_shipdate before o_orderdate", "end before start", "l_shipdate < o_orderdate"),
    ("o_orderdate, l_shipdate", "Across columns", "Same instant", "start = end", "l_shipdate = o_orderdate"),
]))
def cross_column_cases(env):
    lines = env.table("lineitem").select("l_orderkey", "l_shipdate")
    orders = env.table("orders").select("o_orderkey", "o_orderdate")
    shipped = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_shipdate", "o_orderdate")
    return EC.cross_column(shipped, [("o_orderdate", "l_shipdate")])


@query(_case_sql(star.CONTACTS, [
    ("is_deleted", "Across columns", "Soft-deleted row", "is_deleted set", "is_deleted"),
    ("status, is_deleted", "Across columns", "Active status on a deleted row", "status=active and is_deleted set",
     "is_deleted AND lower(status) IN ('active', '1', 'true')"),
]))
def cross_column_deleted(env):
    return EC.cross_column(star.contacts(env))


# ---------------------------------------------------------------- catalog and small functions
@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, count(*) AS rows FROM {t}" for t in star.TABLES))
def table_counts(env):
    return C.table_counts(env)


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS tbl, count(*) AS rows, '{c}' AS col, {i} AS pos, count(*) - count({c}) AS nulls FROM {t}"
    for t, cols in star.TABLES.items() for i, c in enumerate(cols, start=1)))
def catalog_columns_measured(env):
    return C.column_nulls(env).drop("type")


def _merged_sql(table: str, columns: dict[str, str]) -> str:
    """columns: name to number, text or other."""
    null = "CAST(NULL AS {})"
    parts = []
    for c, kind in columns.items():
        number, text = kind == "number", kind == "text"
        cells = {
            "empty": f"count(*) FILTER ({c} = '')" if text else null.format("BIGINT"),
            "smallest": f"CAST(min({c}) AS DOUBLE)" if number else null.format("DOUBLE"), "largest": f"CAST(max({c}) AS DOUBLE)" if number else null.format("DOUBLE"),
            "shortest": f"min(length({c}))" if text else null.format("BIGINT"), "longest": f"max(length({c}))" if text else null.format("BIGINT"),
        }
        parts.append(f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, " + ", ".join(f"{v} AS {k}" for k, v in cells.items()) + f" FROM {table}")
    return " UNION ALL ".join(parts)


@query(_merged_sql("lineitem", {c: "text" if c in ("l_returnflag", "l_linestatus") else "other" if c == "l_shipdate" else "number" for c in star.TABLES["lineitem"]}))
def profile_merged(env):
    """The profile of all lines, merged from a part for each month they were shipped in."""
    parts = PS.profile_parts(env.table("lineitem"), F.date_format("l_shipdate", "yyyy-MM"))
    return PS.merged_profile(parts).drop("distinct_values", "q25", "q50", "q75")


@query()
def recently_changed_tables(env):
    return C.files_changed(env).orderBy(F.desc("updated")).limit(50)


@query("""SELECT o_orderkey, CASE WHEN trim(body) = '' THEN 'no JSON text'
          WHEN contains(body, '''') AND NOT contains(body, '"')
               THEN 'JSON needs double quotes, not single quotes'
          WHEN regexp_matches(body, ',\\s*[}\\]]') THEN 'remove the comma before a closing } or ]'
          WHEN NOT json_valid(body) THEN 'not valid JSON' END AS json_error FROM """ + star.ORDER_DOCUMENTS + " d")
def json_errors(env):
    return json_documents(star.order_documents(env), "body").select("o_orderkey", "json_error")


_IDENTIFIERS = """(SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN 'abc' || c_custkey || '@example.com'
    WHEN 2 THEN '+91 98765 ' || CAST(43210 + c_custkey AS VARCHAR) WHEN 3 THEN CAST(9876500000 + c_custkey AS VARCHAR)
    WHEN 4 THEN 'TXN-88-' || c_name ELSE '' END AS identifier FROM customer)"""


def _identifiers(env):
    k = F.col("c_custkey")
    s = k.cast("string")
    return env.table("customer").select(
        "c_custkey",
        F.when(k % 6 == 0, s).when(k % 6 == 1, F.concat(F.lit("abc"), s, F.lit("@example.com")))
        .when(k % 6 == 2, F.concat(F.lit("+91 98765 "), (k + 43210).cast("string")))
        .when(k % 6 == 3, (F.lit(9876500000) + k).cast("string"))
        .when(k % 6 == 4, F.concat(F.lit("TXN-88-"), F.col("c_name"))).otherwise("").alias("identifier"),
    )


@query(rf"""SELECT c_custkey, CASE WHEN regexp_full_match(v, '[^@\s]+@[^@\s]+\.[^@\s]+') THEN 'email'
    WHEN regexp_full_match(d, '\d{{10,13}}') AND (v LIKE '+%' OR length(d) IN (10, 12)) THEN 'phone'
    WHEN regexp_full_match(v, '-?\d+') THEN 'number' ELSE 'text' END AS kind
    FROM (SELECT c_custkey, trim(identifier) AS v, regexp_replace(trim(identifier), '[\s+()-]', '', 'g') AS d FROM {_IDENTIFIERS} i)""")
def identifier_classes(env):
    return _identifiers(env).select("c_custkey", X.classify(F.col("identifier")).alias("kind"))


@query("""SELECT p_partkey, base, kind, CAST(length AS INT) AS length, CAST(prec AS INT) AS precision, CAST(scale AS INT) AS scale, uns AS unsigned FROM (
    SELECT p_partkey, p_size, CASE p_partkey % 7 WHEN 0 THEN 'varchar' WHEN 1 THEN 'int' WHEN 2 THEN 'decimal' WHEN 3 THEN 'tinyint'
        WHEN 4 THEN 'enum' WHEN 5 THEN 'datetime' ELSE 'mediumblob' END AS base,
      CASE p_partkey % 7 WHEN 0 THEN 'text' WHEN 1 THEN 'integer' WHEN 2 THEN 'decimal'
        WHEN 3 THEN CASE WHEN p_size = 1 THEN 'boolean' ELSE 'integer' END
        WHEN 4 THEN 'choice' WHEN 5 THEN 'date' ELSE 'binary' END AS kind,
      CASE WHEN p_partkey % 7 IN (0, 3) THEN p_size END AS length,
      CASE WHEN p_partkey % 7 = 2 THEN p_size END AS prec, CASE WHEN p_partkey % 7 = 2 THEN 2 END AS scale,
      p_partkey % 7 = 1 AS uns FROM part)""")
def type_strings(env):
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    declared = (
        F.when(k % 7 == 0, F.concat(F.lit("VARCHAR("), size, F.lit(")"))).when(k % 7 == 1, F.lit("int unsigned"))
        .when(k % 7 == 2, F.concat(F.lit("decimal("), size, F.lit(",2)"))).when(k % 7 == 3, F.concat(F.lit("tinyint("), size, F.lit(")")))
        .when(k % 7 == 4, F.lit("enum('on','off')")).when(k % 7 == 5, F.lit("datetime")).otherwise("mediumblob")
    )
    return env.table("part").select("p_partkey", X.parse_type(declared).alias("t")).select(
        "p_partkey", "t.base", "t.kind", "t.length", "t.precision", "t.scale", "t.unsigned")


@query(r"""SELECT p_partkey, CASE WHEN name = 'ring' THEN 100.0 WHEN name LIKE 'ring%' THEN 60.0
    WHEN regexp_matches(name, '(^|[^a-z0-9])ring') THEN 40.0 WHEN contains(name, 'ring') THEN 20.0
    WHEN typ = 'ring' THEN 50.0 WHEN typ LIKE 'ring%' THEN 30.0 WHEN contains(typ, 'ring') THEN 10.0 ELSE 0.0 END AS score
    FROM (SELECT p_partkey, lower(p_name) AS name, lower(p_type) AS typ FROM part)""")
def relevance_scores(env):
    return env.table("part").select("p_partkey", X.relevance("ring", F.col("p_name"), F.col("p_type")).alias("score"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d 00:00:00')
    WHEN 5 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS time FROM events""")
def text_to_time(env):
    e, k = env.table("events"), F.col("event_id")
    seconds = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("  "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .when(k % 6 == 1, F.date_format("ts", "yyyy-MM-dd")).when(k % 6 == 2, "0000-00-00 00:00:00")
        .when(k % 6 == 3, F.col("event_type")).when(k % 6 == 4, "").otherwise(seconds)
    )
    when = V.to_time(F.col("raw"), T.StringType())
    return e.select("event_id", raw.alias("raw")).select("event_id", F.date_format(when, "yyyy-MM-dd HH:mm:ss").alias("time"))


@query("""SELECT event_id, CASE WHEN s BETWEEN 946684800 AND 4102444800 THEN strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') END AS time
    FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id ELSE 1700000000 + event_id * 60 END AS s FROM events)""")
def epoch_to_time(env):
    s = F.when(F.col("event_id") % 3 == 0, F.col("event_id")).otherwise(F.lit(1700000000) + F.col("event_id") * 60)
    return env.table("events").select("event_id", s.alias("s")).select(
        "event_id", F.date_format(V.to_time(F.col("s"), T.LongType()), "yyyy-MM-dd HH:mm:ss").alias("time"))


@query("SELECT 'customer / c_custkey = ' || CAST(c_custkey AS VARCHAR) || ' / ' || c_name AS label FROM customer")
def record_labels(env):
    return env.table("customer").select(X.record_label("customer", "c_custkey", F.col("c_custkey"), F.col("c_name")).alias("label"))
