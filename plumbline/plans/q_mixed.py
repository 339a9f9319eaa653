"""Queries on keys of different types, long numbers, nested columns and measured edge cases."""

from pyspark.sql import functions as F

from plumbline.functions import documents as D
from plumbline.functions import privacy as P
from plumbline.operators import compare as CM
from plumbline.operators import documents as DO
from plumbline.operators import edge_cases as EC
from plumbline.operators import links as LK
from plumbline.operators import rules as R
from plumbline.operators import snapshots as SN
from plumbline.operators import timeline as TL
from plumbline.plans import star
from plumbline.plans.registry import query
from plumbline.sources import catalog as C
from plumbline.sources.environment import Link

# line keys as text; those of line 7 are no numbers
_KEY = "CASE WHEN l_linenumber = 7 THEN 'x' || CAST(l_orderkey AS VARCHAR) ELSE CAST(l_orderkey AS VARCHAR) END"


def _text_lines(env):
    key = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("x"), F.col("l_orderkey").cast("string"))).otherwise(F.col("l_orderkey").cast("string"))
    return env.with_tables(lines=env.table("lineitem").withColumn("l_key", key))


_MATCH = "EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <> 7 AND l_orderkey = o_orderkey)"


@query(f"SELECT o_orderkey FROM orders WHERE NOT {_MATCH}")
def rule_mixed_keys(env):
    spec = {"source": {"table": "orders", "key": "o_orderkey"}, "expect": "exists",
            "target": {"table": "lines", "key": "l_key", "filters": [{"col": "l_returnflag", "op": "equals", "val": "R"}]}}
    return R.rule_failures(_text_lines(env), spec).select("o_orderkey")


@query(f"""SELECT count(*) AS checked, count(*) FILTER (bad) AS failed, count(*) FILTER (NOT bad) AS passed,
    round(count(*) FILTER (NOT bad) * 100.0 / count(*), 2) AS pass_rate
    FROM (SELECT l_linenumber = 7 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AS bad FROM lineitem)""")
def rule_verdict_mixed(env):
    spec = {"source": {"table": "lines", "key": "l_key"}, "expect": "exists",
            "target": {"table": "orders", "key": "o_orderkey", "filters": [{"col": "o_orderstatus", "op": "equals", "val": "F"}]}}
    return R.rule_verdict(_text_lines(env), spec)


@query(f"""SELECT k AS missing_parent_value, count(*) AS child_rows FROM (SELECT {_KEY} AS k, l_linenumber, l_orderkey FROM lineitem)
    WHERE l_linenumber = 7 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY k""")
def orphans_mixed(env):
    own = _text_lines(env)
    return R.orphan_counts(own.table("lines"), "l_key", env.table("orders").where("o_orderstatus = 'F'"), "o_orderkey")


@query("""SELECT 'lines.l_key' AS link, 'orders.o_orderkey' AS points_to, 'configured link' AS how, count(*) AS child_rows, 0::BIGINT AS null_rows,
    count(*) FILTER (ok) AS matched_rows, count(*) FILTER (NOT ok) AS orphan_rows, count(DISTINCT k) FILTER (NOT ok) AS orphan_values,
    (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <> 7)) AS unused_parents, TRUE AS parent_unique
    FROM (SELECT """ + _KEY + """ AS k, l_linenumber <> 7 AND l_orderkey IN (SELECT o_orderkey FROM orders) AS ok FROM lineitem)""")
def verified_links_mixed(env):
    return LK.verify_link(_text_lines(env), Link("lines", "l_key", "orders", "o_orderkey"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS record, l_shipdate AS time, 'lines' AS "table", 'l_key=' || l_orderkey AS "row", 'l_shipdate' AS "column",
    'lines.l_shipdate' AS event FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber <> 7
    UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_orderdate, 'orders', 'o_orderkey=' || o_orderkey, 'o_orderdate', 'orders.o_orderdate' FROM orders""")
def linked_timeline_mixed(env):
    return _mixed_timeline(env, env.table("orders"))


def _mixed_timeline(env, orders):
    own = _text_lines(env)
    own = own.with_tables(lines=own.table("lines").select("l_key", "l_shipdate"))
    out = TL.linked_timeline(own, "orders", orders.select("o_orderkey", "o_orderdate"), "o_orderkey", [Link("lines", "l_key", "orders", "o_orderkey")])
    return out.select("record", "time", "table", "row", "column", "event")


@query("SELECT count(*) AS compared, 0::BIGINT AS matching, 0::BIGINT AS mismatched, count(*) AS missing_in_target, 0::BIGINT AS duplicate_in_target, count(*) AS missing_in_source FROM orders")
def table_compare_long_keys(env):
    """Keys of 33 digits that differ in the last one only."""
    return _long_keys(env, env.table("orders"))


def _long_keys(env, rows):
    long = lambda end: F.concat(F.lit("1" + "0" * 20), F.lpad(F.col("o_orderkey").cast("string"), 11, "0"), F.lit(end))
    a, b = (env.with_tables(long=rows.select(long(end).alias("k"), "o_totalprice")) for end in ("1", "2"))
    spec = {"source": {"table": "long", "key": "k"}, "target": {"table": "long", "key": "k"}, "fields": [{"source": "o_totalprice", "target": "o_totalprice"}]}
    return CM.full_summary(a, b, spec)


@query("SELECT count(*) AS records FROM orders")
def snapshot_decimal_scale(env):
    """Two scales of one decimal: every record is found on both sides, none has changed."""
    return _two_scales(env.table("orders"))


def _two_scales(rows):
    sides = [SN.snapshot(rows.select(F.col("o_orderkey").cast(f"decimal(20,{s})").alias("k"), F.col("o_totalprice").cast(f"decimal(18,{s})").alias("p")), "k", b"key") for s in (2, 4)]
    return SN.snapshot_diff(*sides).where("field = 'p' AND change = 'same'").agg(F.count("*").alias("records"))


_MASKED = r"regexp_replace(c_name || '@x.org', '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', '\1•••\2')"


@query(f"SELECT c_custkey, 'x' AS plain, '•••• hidden' AS password, {_MASKED} AS mail, {_MASKED} AS listed FROM customer")
def mask_nested(env):
    mail = F.concat("c_name", F.lit("@x.org"))
    person = F.struct(F.lit("x").alias("plain"), F.lit("s3").alias("password"), mail.alias("mail"))
    shown = P.mask(env.table("customer").select("c_custkey", person.alias("person"), F.array(mail).alias("mails")))
    return shown.select("c_custkey", "person.plain", "person.password", "person.mail", F.get("mails", 0).alias("listed"))


@query("""SELECT count(*) AS rows, 'event_id' AS "column", 'Uniqueness' AS category, 'Duplicate value' AS "case", '(same as an existing row)' AS example,
    (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM events WHERE event_id IS NOT NULL GROUP BY event_id HAVING count(*) > 1)) AS rows_showing FROM events
    UNION ALL SELECT count(*), 'event_id', 'Uniqueness', 'Generated id', '(left out)', NULL FROM events
    UNION ALL SELECT count(*), 'user_id', 'Links', 'Points to a missing customer', 'a value that does not exist',
        count(*) FILTER (user_id NOT IN (SELECT c_custkey FROM customer)) FROM events
    UNION ALL SELECT count(*), 'event_type', 'Choices', 'Value click', 'click', count(*) FILTER (event_type = 'click') FROM events
    UNION ALL SELECT count(*), 'event_type', 'Choices', 'Not in list', '(another value)', count(*) FILTER (event_type <> 'click') FROM events""")
def edge_cases_measured(env):
    return EC.measured_cases(env.table("events"), ["event_id"], {"user_id": ("customer", env.table("customer"), "c_custkey")}, {"event_type": ["click"]})


_DEEP = "abcdefghijkl"


@query(f"SELECT o_orderkey, '{'.'.join(_DEEP)}' AS path, 'number' AS type, CAST(o_custkey AS VARCHAR) AS shown FROM orders")
def json_flatten_deep(env):
    """Twelve levels of objects: as many levels are opened as there are."""
    return _flattened_deep(env.table("orders"))


def _flattened_deep(orders):
    inner = F.col("o_custkey").cast("string")
    for name in reversed(_DEEP):
        inner = F.concat(F.lit('{"' + name + '":'), inner, F.lit("}"))
    docs = orders.select("o_orderkey", F.parse_json(inner).alias("doc"))
    return DO.flatten_documents(docs, "doc").select("o_orderkey", "path", "type", "shown")


@query("""SELECT o_orderkey, rule, path, CASE rule WHEN 1 THEN if(o_orderkey % 2 = 1, 'pass', 'fail') WHEN 2 THEN if(o_custkey % 3 = 2, 'pass', 'fail')
    WHEN 3 THEN 'warn' ELSE if(o_orderstatus = 'F', 'pass', 'fail') END AS status
    FROM orders, (VALUES (1, 'a"b'), (2, 'a"b''c'), (3, 'text'), (4, 'text')) v(rule, path)""")
def json_rules_odd(env):
    """The odd paths and patterns over a document of each order."""
    text = F.format_string('{"a\\"b": %d, "a\\"b\'c": %d, "text": "%s"}', F.col("o_orderkey") % 2, F.col("o_custkey") % 3, "o_orderstatus")
    docs = env.table("orders").select("o_orderkey", F.parse_json(text).alias("doc"))
    rules = [D.Rule('a"b', "equals", "1"), D.Rule("a\"b'c", "equals", "2"), D.Rule("text", "matches regex", "(?P<f>F)"), D.Rule("text", "matches regex", "(?<f>F)")]
    return DO.check_rules(docs, "doc", rules).select("o_orderkey", "rule", "path", "status")


@query(f"""SELECT count(*) AS rows, 'user_id' AS "column", 'Links' AS category, "case", max(n) AS rows_showing FROM events, (VALUES
    ('Points to a missing contacts', (SELECT count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM {star.CONTACTS} c))),
    ('Points to a deleted / inactive contacts', (SELECT count(*) FROM events WHERE user_id IN (SELECT c_custkey FROM {star.CONTACTS} c WHERE is_deleted)))) v("case", n) GROUP BY "case" """)
def edge_cases_deleted_parent(env):
    found = EC.measured_cases(env.table("events"), links={"user_id": ("contacts", star.contacts(env), "c_custkey")})
    return found.drop("example")


#: CRC-32 of a text, in SQL: a table of 256 remainders, then a step a byte
_CRC = """crc(i, v, b) AS (SELECT 0, CAST(r.b AS BIGINT), r.b FROM range(256) r(b)
        UNION ALL SELECT i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, b FROM crc WHERE i < 8),
    remainders AS (SELECT list(v ORDER BY b) AS t FROM crc WHERE i = 8),
    steps AS (SELECT line, 1 AS i, CAST(4294967295 AS BIGINT) AS v FROM lines
        UNION ALL SELECT line, i + 1, xor(t[CAST(xor(v % 256, ord(substr(line, i, 1))) AS BIGINT) + 1], v // 256) FROM steps, remainders WHERE i <= length(line))"""


@query(f"""WITH RECURSIVE lines AS (SELECT table_name || '.' || column_name || ' ' || CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
        WHEN 'VARCHAR' THEN 'longtext' WHEN 'DOUBLE' THEN 'double' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'datetime' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp'
        WHEN 'FLOAT[]' THEN 'array<float>' ELSE data_type END AS line FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in star.TABLES)})), {_CRC}
    SELECT count(*) AS columns, CAST(sum(xor(v, 4294967295)) AS BIGINT) AS checksum, (SELECT CAST(sum(n) AS BIGINT) FROM ({" UNION ALL ".join(f"SELECT count(*) AS n FROM {t}" for t in star.TABLES)})) AS rows
    FROM steps WHERE i = length(line) + 1""")
def schema_fingerprint(env):
    """Columns and checksum of the whole catalog, beside the rows it stands for."""
    return C.schema_fingerprint(C.catalog_columns(env)).withColumn("rows", C.table_counts(env).agg(F.sum("rows")).scalar())
