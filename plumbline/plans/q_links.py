"""Links, searches, health findings and test data."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.functions import values as V
from plumbline.operators import health as H
from plumbline.operators import inclusion as IN
from plumbline.operators import links as LK
from plumbline.operators import search as S
from plumbline.operators import testdata as TD
from plumbline.operators import timeline as TL
from plumbline.operators import edge_cases as EC
from plumbline.plans import star
from plumbline.plans.registry import query
from plumbline.sources import catalog as C
from plumbline.sources.environment import Link

# ---------------------------------------------------------------- links
def _verify_sql(links, source=None) -> str:
    parts = []
    for k in links:
        child = (source or {}).get(k.table, k.table)
        parent = (source or {}).get(k.ref_table, k.ref_table)
        parts.append(f"""SELECT '{k.table}.{k.column}' AS link, '{k.ref_table}.{k.ref_column}' AS points_to, '{k.how}' AS how,
            (SELECT count(*) FROM {child} c) AS child_rows, (SELECT count(*) FROM {child} c WHERE {k.column} IS NULL) AS null_rows,
            (SELECT count(*) FROM {child} c WHERE {k.column} IN (SELECT {k.ref_column} FROM {parent} p)) AS matched_rows,
            (SELECT count(*) FROM {child} c WHERE {k.column} IS NOT NULL AND {k.column} NOT IN (SELECT {k.ref_column} FROM {parent} p)) AS orphan_rows,
            (SELECT count(DISTINCT {k.column}) FROM {child} c WHERE {k.column} NOT IN (SELECT {k.ref_column} FROM {parent} p)) AS orphan_values,
            (SELECT count(DISTINCT {k.ref_column}) FROM {parent} p WHERE {k.ref_column} NOT IN
                (SELECT {k.column} FROM {child} c WHERE {k.column} IS NOT NULL)) AS unused_parents,
            (SELECT count(*) = count(DISTINCT {k.ref_column}) FROM {parent} p) AS parent_unique""")
    return " UNION ALL ".join(parts)


@query(_verify_sql(star.LINKS))
def verified_links(env):
    return LK.verify_links(env)


@query(_verify_sql([k for k in star.LINKS if "orders" in (k.table, k.ref_table)], {"orders": star.ORDERS_B}))
def verified_links_b(env):
    return LK.verify_links(env.with_tables(orders=star.orders_b(env)), [k for k in env.links if "orders" in (k.table, k.ref_table)])


_SHOP = {
    "customers": ("customer", {"id": "c_custkey", "name": "c_name", "nation_code": "c_nationkey"}),
    "nations": ("nation", {"id": "n_nationkey", "name": "n_name", "region_id": "n_regionkey"}),
    "region": ("region", {"id": "r_regionkey", "name": "r_name"}),
    "purchases": ("orders", {"id": "o_orderkey", "customer_id": "o_custkey", "part_id": "o_custkey", "status": "o_orderstatus"}),
    "purchase_lines": ("lineitem", {"order_no": "l_orderkey", "part_id": "l_partkey", "supplier_ref": "l_suppkey"}),
    "parts": ("part", {"id": "p_partkey", "name": "p_name"}),
    "suppliers": ("supplier", {"id": "s_suppkey", "name": "s_name", "nation_code": "s_nationkey"}),
}
_PART_SHARE = 3  # parts of a shop that sells only some: a third of the part numbers


def _shop(env):
    """The star schema under the names an application would use: one declared link, one configured by column name, some that
    follow the usual pattern (one of them wrongly: the numbers in ``purchases.part_id`` are those of customers), one under no known name."""
    tables = {
        name: env.table(table).select(*[F.col(v).alias(k) for k, v in columns.items()]) for name, (table, columns) in _SHOP.items()}
    tables["parts"] = tables["parts"].filter(F.col("id") % _PART_SHARE == 0)
    return replace(
        env.with_tables(**tables).only(*_SHOP), links=(Link("purchase_lines", "order_no", "purchases", "id", "foreign key"),),
        keys={t: "id" for t in ("customers", "nations", "region", "purchases", "parts", "suppliers")},
    )


def _found_links(shop):
    configured = C.local_frame(shop.spark, [("nation_code", "nations", "id")], "col string, ref_tbl string, ref_col string")
    contained = IN.contained_links(IN.inclusions(IN.overlaps(shop)))
    return LK.discover_links(C.catalog_columns(shop), C.catalog_links(shop), configured, contained)


def _values_sql(tables: dict) -> str:
    """v (tbl, col, pos, v, n), d (per column), o (per pair of columns the values they share) of the tables' columns."""
    cells = " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, '{k}' AS col, {i} AS pos, CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {source} GROUP BY {c}"
        for t, (source, columns) in tables.items() for i, k, c in columns)
    return f"""v AS (SELECT * FROM ({cells}) WHERE v IS NOT NULL),
    d AS (SELECT tbl, col, pos, count(*) AS vals, max(n) = 1 AS uniq FROM v GROUP BY tbl, col, pos),
    o AS (SELECT x.tbl, x.col, x.pos, x.ref_tbl, x.ref_col, x.shared, d.vals AS col_values, e.vals AS ref_values, e.uniq AS ref_unique FROM (
        SELECT a.tbl, a.col, a.pos, b.tbl AS ref_tbl, b.col AS ref_col, count(*) AS shared FROM v a JOIN v b ON a.v = b.v AND (a.tbl <> b.tbl OR a.col <> b.col)
        GROUP BY a.tbl, a.col, a.pos, b.tbl, b.col) x JOIN d USING (tbl, col) JOIN d e ON e.tbl = ref_tbl AND e.col = ref_col)"""


_STAR_VALUES = _values_sql({
    t: (t, [(i, c, c) for i, c in enumerate(cs, start=1) if c not in ("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "o_orderdate",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "ts", "value", "embedding")]) for t, cs in star.TABLES.items()})
_SHOP_VALUES = _values_sql({
    t: (f"(SELECT * FROM part WHERE p_partkey % {_PART_SHARE} = 0)" if t == "parts" else table, [(i, k, c) for i, (k, c) in enumerate(columns.items(), start=1)])
    for t, (table, columns) in _SHOP.items()})
#: links of the shop: candidates by name, strongest first, which the values must bear out; then the key that a column fills best
_SHOP_LINKS = f"""{_SHOP_VALUES},
    c AS (SELECT tbl, col, ref_tbl, ref_col, col_values / ref_values AS coverage FROM o WHERE shared = col_values AND ref_unique AND tbl <> ref_tbl),
    links AS (SELECT tbl, col, ref_tbl, ref_col, how FROM (SELECT *, row_number() OVER (PARTITION BY tbl, col ORDER BY rank, ref_tbl, ref_col) AS rn FROM (
        SELECT 'purchase_lines' AS tbl, 'order_no' AS col, 'purchases' AS ref_tbl, 'id' AS ref_col, 'foreign key' AS how, 10.0 AS rank
        UNION ALL SELECT c.tbl, c.col, c.ref_tbl, c.ref_col, n.how, n.rank FROM c JOIN (VALUES ('nation_code', 'nations', 'configured link', 21.0),
            ('region_id', 'region', 'name pattern', 30.0), ('customer_id', 'customers', 'name pattern', 31.0), ('part_id', 'parts', 'name pattern', 31.0))
            n(col, ref_tbl, how, rank) ON c.col = n.col AND c.ref_tbl = n.ref_tbl AND c.ref_col = 'id'
        UNION ALL SELECT tbl, col, ref_tbl, ref_col, 'contained values', 51.0 - coverage FROM c WHERE coverage >= 0.5)) WHERE rn = 1)"""


@query(f"WITH {_STAR_VALUES} SELECT tbl, col, ref_tbl, ref_col, col_values, ref_values, ref_unique, coverage FROM (SELECT *, col_values / ref_values AS coverage FROM o WHERE shared = col_values)")
def inclusion_dependencies(env):
    return IN.inclusions(IN.overlaps(env)).drop("pos", "shared")


@query(f"WITH {_SHOP_LINKS} SELECT * FROM links")
def discovered_links(env):
    return _found_links(_shop(env))


@query(f"""WITH RECURSIVE {_SHOP_LINKS}, e AS (SELECT tbl AS a, ref_tbl AS b FROM links UNION ALL SELECT ref_tbl, tbl FROM links),
    w AS (SELECT 'purchases' AS tbl, 0 AS distance UNION SELECT e.b, w.distance + 1 FROM w JOIN e ON e.a = w.tbl WHERE w.distance < 2)
    SELECT tbl, min(distance) AS distance FROM w GROUP BY tbl""")
def link_neighbourhood(env):
    return LK.neighbourhood(_found_links(_shop(env)), "purchases", depth=2)


@query(f"""WITH RECURSIVE {_SHOP_LINKS}, e AS (SELECT tbl AS a, col AS ac, ref_tbl AS b, ref_col AS bc, how, 0 AS back FROM links
        UNION ALL SELECT ref_tbl, ref_col, tbl, col, how, 1 FROM links),
    w AS (SELECT 'purchase_lines' AS tbl, ['purchase_lines'] AS seen, 0 AS turns, CAST([] AS STRUCT(from_tbl VARCHAR, from_col VARCHAR, to_tbl VARCHAR, to_col VARCHAR, how VARCHAR)[]) AS path
        UNION ALL SELECT e.b, list_append(w.seen, e.b), w.turns + e.back, list_append(w.path, {{'from_tbl': e.a, 'from_col': e.ac, 'to_tbl': e.b, 'to_col': e.bc, 'how': e.how}})
        FROM w JOIN e ON e.a = w.tbl WHERE NOT list_contains(w.seen, e.b) AND len(w.path) < 4),
    p AS (SELECT path FROM w WHERE tbl = 'region' ORDER BY len(path), seen, turns, path LIMIT 1),
    h AS (SELECT unnest(path) AS h, generate_subscripts(path, 1) AS step FROM p)
    SELECT CAST(step AS INT) AS step, h.from_tbl, h.from_col, h.to_tbl, h.to_col, h.how FROM h""")
def link_path(env):
    return LK.join_path(_found_links(_shop(env)), "purchase_lines", "region")


@query("""SELECT o_orderkey AS "orders__o_orderkey", o_custkey AS "orders__o_custkey", o_orderstatus AS "orders__o_orderstatus",
    c_custkey AS "customer__c_custkey", c_nationkey AS "customer__c_nationkey", c_name AS "customer__c_name",
    n_nationkey AS "nation__n_nationkey", n_regionkey AS "nation__n_regionkey", n_name AS "nation__n_name"
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000""")
def join_along_path(env):
    path = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]
    return LK.join_along(env, "orders", path, 3, F.col("o_totalprice") > 300000)


@query("""SELECT o_orderkey AS "orders.o_orderkey", o_custkey AS "orders.o_custkey", o_orderstatus AS "orders.o_orderstatus",
    c_custkey AS "customer.c_custkey", c_name AS "customer.c_name", c_nationkey AS "customer.c_nationkey"
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'""")
def linked_rows(env):
    link = next(k for k in env.links if k.table == "orders")
    return LK.linked_join(env, "orders", link, 3, F.col("o_orderstatus") == "P")


_COUNTS = """SELECT CAST(c_custkey AS VARCHAR) AS key, 'referenced by' AS direction, '{t}' AS tbl, '{c}' AS col, 'c_custkey' AS this_column,
    CAST(c_custkey AS VARCHAR) AS value, 'configured link' AS how, (SELECT count(*) FROM {t} WHERE {c} = c_custkey) AS matches FROM customer WHERE c_custkey <> 0"""


@query(f"""{_COUNTS.format(t='orders', c='o_custkey')} UNION ALL {_COUNTS.format(t='events', c='user_id')} UNION ALL
    SELECT CAST(c_custkey AS VARCHAR), 'points to', 'nation', 'n_nationkey', 'c_nationkey', CAST(c_nationkey AS VARCHAR), 'configured link',
    (SELECT count(*) FROM nation WHERE n_nationkey = c_nationkey) FROM customer WHERE c_nationkey <> 0""")
def linked_counts(env):
    return LK.linked_counts(env, "customer", env.table("customer"), "c_custkey")


# ---------------------------------------------------------------- search
_HIT = "SELECT CAST({c} AS VARCHAR) AS value, '{t}' AS tbl, '{c}' AS col, '{k}' AS key_class, count(*) AS matches FROM {t} WHERE {c} IN (42, 77) GROUP BY {c}"


@query(" UNION ALL ".join(_HIT.format(t=t, c=c, k=k) for t, c, k in [
    ("events", "event_id", "PRI"), ("events", "user_id", "MUL"), ("documents", "doc_id", "PRI"), ("embeddings", "vec_id", "PRI"),
    ("pages", "page_id", "PRI"), ("benchmark", "item_id", "PRI"), ("labels", "doc_id", "PRI"), ("conversations", "conv_id", ""),
    ("orders", "o_orderkey", "PRI"), ("lineitem", "l_orderkey", "MUL")]))
def identifier_search(env):
    return S.ranked_hits(S.search_values(env, ["42", "77"]))


@query(" UNION ALL ".join(
    f"SELECT value, tbl, col, key_class, least(matches, 5) AS matches FROM ({_HIT.format(t=t, c=c, k=k)})" for t, c, k in
    [("orders", "o_custkey", "MUL"), ("events", "user_id", "MUL")]))
def identifier_search_capped(env):
    return S.search_values(env, ["42", "77"], ["orders", "events"], {"orders": ["o_custkey"], "events": ["user_id"]}, cap=5)


@query(f"""SELECT email AS value, 'contacts' AS tbl, 'email' AS col, '' AS key_class, count(*) AS matches FROM {star.CONTACTS} c
    WHERE email = 'customer.000000077@example.com' GROUP BY email""")
def identifier_search_email(env):
    return S.search_values(env.with_tables(contacts=star.contacts(env)), ["customer.000000077@example.com"])


_MANY = "SELECT CAST({c} AS VARCHAR) AS value, '{t}' AS tbl, '{c}' AS col, count(*) AS matches FROM {t} WHERE {c} IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY {c}"


@query(" UNION ALL ".join(_MANY.format(t=t, c=c) for t, c in [("orders", "o_custkey"), ("lineitem", "l_partkey"), ("events", "user_id")]))
def identifiers_from_table(env):
    ids = env.table("labels").filter(F.col("toxic") == 1)
    return S.search_ids(env, ids, "doc_id", {"orders": ["o_custkey"], "lineitem": ["l_partkey"], "events": ["user_id"]})


@query("""SELECT 'documents' AS tbl, count(*) AS rows FROM documents WHERE doc_id = 42 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id = 42""")
def find_by_id(env):
    return S.find_by_id(env, "doc_id", "42")[0]


def _tables_frame(env):
    widths = C.local_frame(env.spark, [(t, " ".join(env.table(t).columns)) for t in env.tables], "tbl string, columns string")
    return C.table_counts(env).join(widths, "tbl").select(F.col("tbl").alias("name"), "columns", "rows")


_TABLE_ROWS = "(" + " UNION ALL ".join(
    f"SELECT '{t}' AS name, '{' '.join(c)}' AS columns, count(*) AS rows FROM {t}" for t, c in star.TABLES.items()) + ")"


@query(rf"""SELECT name, rows, round(s, 2) AS score, matched FROM (SELECT name, rows, hits || '/2' AS matched, hits,
      (CASE WHEN n1 THEN 10 WHEN c1 THEN 2 ELSE 0 END) + (CASE WHEN n2 THEN 10 WHEN c2 THEN 2 ELSE 0 END) + (CASE WHEN hits = 2 THEN 25 ELSE 0 END)
      + (CASE WHEN name = 'line_orderkey' THEN 100 ELSE 0 END) + (CASE WHEN name LIKE 'line\_orderkey%' ESCAPE '\' THEN 30 ELSE 0 END)
      - length(name) * 0.05 + (CASE WHEN name = 'nation' THEN 500 ELSE 0 END) AS s
    FROM (SELECT *, CASE WHEN name = 'nation' THEN greatest(h, 1) ELSE h END AS hits FROM (
      SELECT *, CAST(n1 OR c1 AS INT) + CAST(n2 OR c2 AS INT) AS h FROM (SELECT name, rows,
        regexp_matches(name, 'line|document') AS n1, regexp_matches(columns, '(?:^|\s|_)(?:line|document)') AS c1,
        regexp_matches(name, 'orderkey') AS n2, regexp_matches(columns, '(?:^|\s|_)(?:orderkey)') AS c2 FROM {_TABLE_ROWS} t))))
    WHERE hits > 0""")
def table_search(env):
    return S.find_tables(_tables_frame(env), "line orderkey", {"line": ["document"]}, {"line orderkey": ["nation"]})


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, count(*) - count({c}) AS nulls FROM {t}"
                          for t, cs in star.TABLES.items() for c in cs if "key" in c))
def column_search(env):
    return S.find_columns(C.column_nulls(env, lambda name, _: "key" in name.lower()), "KEY").select("tbl", "col", "nulls")


def _assets(env):
    """Everything with a name: tables, columns, parts as saved queries, and the query log. Names of tables and columns come from the schemas."""
    named = C.catalog_columns(env)
    tables = named.select("tbl").distinct().select(F.lit("Table").alias("kind"), F.col("tbl").alias("title"), F.lit("").alias("detail"))
    columns = named.select(F.lit("Column").alias("kind"), F.concat("tbl", F.lit("."), "col").alias("title"), F.col("tbl").alias("detail"))
    saved = env.table("part").select(F.lit("Saved query").alias("kind"), F.col("p_name").alias("title"), F.col("p_type").alias("detail"))
    log = star.query_log(env).select(F.lit("History").alias("kind"), F.col("sql").alias("title"), F.lit("").alias("detail"))
    return C.union_all([tables, columns, saved, log])


_ASSETS = f"""(SELECT 'Table' AS kind, name AS title, '' AS detail FROM {_TABLE_ROWS} t
    UNION ALL {' UNION ALL '.join(f"SELECT 'Column', '{t}.{c}', '{t}'" for t, cs in star.TABLES.items() for c in cs)}
    UNION ALL SELECT 'Saved query', p_name, p_type FROM part
    UNION ALL SELECT DISTINCT 'History', sql, '' FROM {star.QUERY_LOG} l)"""


@query(rf"""SELECT kind, title, detail, score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, title, detail) AS place FROM (
    SELECT *, greatest(CASE WHEN t = 'part' THEN 100.0 WHEN t LIKE 'part%' THEN 60.0 WHEN regexp_matches(t, '(^|[^a-z0-9])part') THEN 40.0
      WHEN contains(t, 'part') THEN 20.0 ELSE 0.0 END, CASE WHEN d = 'part' THEN 50.0 WHEN d LIKE 'part%' THEN 30.0
      WHEN regexp_matches(d, '(^|[^a-z0-9])part') THEN 20.0 WHEN contains(d, 'part') THEN 10.0 ELSE 0.0 END) AS score
    FROM (SELECT *, lower(title) AS t, lower(detail) AS d FROM {_ASSETS} a)) WHERE score > 0) WHERE place <= 25""")
def asset_search(env):
    return S.search_assets(_assets(env), "part", ["title", "detail"], 25).select("kind", "title", "detail", "score", "place")


@query(rf"""SELECT kind, title, detail, score FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY score DESC, title, detail) AS place FROM (
    SELECT kind, title, detail, least({', '.join(f"greatest(CASE WHEN t = '{w}' THEN 100.0 WHEN t LIKE '{w}%' THEN 60.0 WHEN regexp_matches(t, '(^|[^a-z0-9]){w}') THEN 40.0 WHEN contains(t, '{w}') THEN 20.0 ELSE 0.0 END, CASE WHEN d = '{w}' THEN 50.0 WHEN d LIKE '{w}%' THEN 30.0 WHEN regexp_matches(d, '(^|[^a-z0-9]){w}') THEN 20.0 WHEN contains(d, '{w}') THEN 10.0 ELSE 0.0 END)" for w in ('red', 'ring'))}) AS score
    FROM (SELECT *, lower(title) AS t, lower(detail) AS d FROM {_ASSETS} a)) WHERE score > 0) WHERE place <= 25""")
def asset_search_words(env):
    return S.search_assets(_assets(env), "red ring", ["title", "detail"], 25).select("kind", "title", "detail", "score")


# ---------------------------------------------------------------- health
def _unique(t: str, c: str) -> str:
    return f"(SELECT count(*) = count(DISTINCT coalesce(CAST({c} AS VARCHAR), 'None')) FROM {t})"


def _measured_sql(tables) -> str:
    types = {"embedding": "array<float>"}
    return " UNION ALL ".join(
        f"SELECT '{t}' AS tbl, '{c}' AS col, {i} AS pos, (SELECT count(*) FROM {t}) AS rows, (SELECT count(*) - count({c}) FROM {t}) AS nulls, "
        f"CASE WHEN {_unique(t, c)} THEN '{'PRI' if star.KEYS.get(t) == c else 'UNI'}' ELSE '' END AS key"
        for t in tables for i, c in enumerate(star.TABLES[t], start=1))


@query(_measured_sql(star.TABLES))
def measured_catalog(env):
    return H.measured_columns(env).select("tbl", "col", "pos", "rows", "nulls", "key")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl WHERE NOT ({' OR '.join(_unique(t, c) for c in cs)})" for t, cs in star.TABLES.items()))
def tables_without_key(env):
    return H.tables_without_key(H.measured_columns(env))


def _sick(env):
    """A few tables with the problems the findings look for."""
    o, e = env.table("orders"), env.table("events")
    sparse = o.select("o_orderkey", *[F.when(F.col("o_orderkey") % (i + 2) == 0, F.col("o_custkey")).alias(f"c{i}") for i in range(6)])
    wide = e.select("event_id", *[(F.col("user_id") + i).alias(f"w{i}") for i in range(85)])
    return replace(
        env.with_tables(orders_bak_20240101=o, sparse=sparse, wide=wide, heap=e.select("event_type"), nothing=o.filter(F.col("o_orderkey") < 0),
                        owners=env.table("customer").select(F.col("c_custkey").cast("int").alias("id")),
                        things=o.select("o_orderkey", F.col("o_custkey").alias("owner_id")))
        .only("orders_bak_20240101", "sparse", "wide", "heap", "nothing", "owners", "things"),
        links=(Link("things", "owner_id", "owners", "id"),), keys={},
    )


@query("""SELECT 'leftover' AS "check", 'orders_bak_20240101' AS "table", '' AS "column", '' AS detail, count(*) AS rows, 'Looks like a backup / temp copy' AS title FROM orders
    UNION ALL SELECT 'mostly_nullable', 'sparse', '', '6 of 7 columns', count(*), 'Most columns allow NULL' FROM orders
    UNION ALL SELECT 'wide', 'wide', '', '86 columns', count(*), 'Very wide table' FROM events
    UNION ALL SELECT 'no_primary_key', 'heap', '', '1 columns', count(*), 'No primary key' FROM events
    UNION ALL SELECT 'empty', 'nothing', '', '', 0, 'Empty table'
    UNION ALL SELECT 'type_mismatch', 'things', 'owner_id', 'bigint → owners.id int', count(*), 'Link column type differs from its target' FROM orders""")
def health_findings(env):
    sick = _sick(env)
    return H.health(sick, C.catalog_links(sick))


@query("""SELECT * FROM (VALUES ('no_primary_key', 1), ('type_mismatch', 1), ('mostly_nullable', 1), ('wide', 1), ('empty', 1), ('leftover', 1),
    ('large', 0)) v("check", findings) WHERE (SELECT count(*) FROM orders) BETWEEN 1 AND 1000000""")
def health_counts(env):
    sick = _sick(env)
    counts = H.finding_counts(H.health(sick, C.catalog_links(sick)))
    return counts.withColumn("findings", F.col("findings").cast("int"))


@query("""SELECT 'leftover' AS "check", 'orders_bak_20240101' AS "table" FROM orders HAVING count(*) > 0""")
def health_filtered(env):
    sick = _sick(env)
    return H.filter_findings(H.health(sick), ["leftover", "wide"], "BAK").select("check", "table")


@query(f"""SELECT 14 AS tables, 63 AS columns, CAST(sum(rows) AS BIGINT) AS rows, 9 AS links FROM {_TABLE_ROWS} t""")
def catalog_totals(env):
    totals = H.catalog_totals(env, C.catalog_links(env))
    return totals.select(*[F.col(c).cast("int").alias(c) for c in ("tables", "columns", "links")], "rows")


@query(f"SELECT name AS tbl, rows, CAST(len(string_split(columns, ' ')) AS INT) AS columns FROM {_TABLE_ROWS} t ORDER BY rows DESC, name LIMIT 10")
def biggest_tables(env):
    return H.biggest_tables(env, 10)


@query("SELECT 'nothing' AS tbl, count(*) AS rows FROM orders WHERE o_orderkey < 0")
def empty_tables(env):
    return H.empty_tables(_sick(env))


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, '{c}' AS col, count({c}) AS filled FROM {t}" for t, c in [("orders", "o_orderdate"), ("lineitem", "l_shipdate"), ("events", "ts")]))
def time_columns(env):
    measured = C.column_nulls(env, TL.is_time_column)
    found = measured.filter(TL.time_column_flag(F.col("col"), F.col("type")))
    return found.select("tbl", "col", (F.col("rows") - F.col("nulls")).alias("filled"))


@query("""SELECT tbl, col, CAST(rule AS INT) AS rule, category, "case", filled FROM (
    SELECT 'orders' AS tbl, 'o_totalprice' AS col, 4 AS rule, 'Range' AS category, unnest(['Zero', 'Negative', 'Many decimals']) AS "case", (SELECT count(*) FROM orders) AS filled
    UNION ALL SELECT 'lineitem', c, 4, 'Range', unnest(['Zero', 'Negative', 'Many decimals']), (SELECT count(*) FROM lineitem) FROM (VALUES ('l_extendedprice'), ('l_discount')) v(c)
    UNION ALL SELECT 'part', 'p_retailprice', 4, 'Range', unnest(['Zero', 'Negative', 'Many decimals']), (SELECT count(*) FROM part)
    UNION ALL SELECT t, c, 7, 'Format', unnest(['Unicode', 'Apostrophe', 'HTML', 'Only spaces']), n FROM (VALUES
        ('region', 'r_name', (SELECT count(*) FROM region)), ('nation', 'n_name', (SELECT count(*) FROM nation)), ('customer', 'c_name', (SELECT count(*) FROM customer)),
        ('supplier', 's_name', (SELECT count(*) FROM supplier)), ('part', 'p_name', (SELECT count(*) FROM part))) v(t, c, n)
    UNION ALL SELECT 'pages', 'url', 2, 'Format', unnest(['No scheme', 'javascript: link', 'Very long URL']), (SELECT count(*) FROM pages))""")
def columns_by_name_rule(env):
    measured = C.column_nulls(env, lambda name, _: EC.has_rule(name)).select("tbl", "col", (F.col("rows") - F.col("nulls")).alias("filled"))
    return EC.columns_by_rule(measured).drop("rows")


@query("SELECT tables, count(*) AS columns FROM (SELECT col, count(DISTINCT tbl) AS tables FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS tbl, '{c}' AS col FROM {t} HAVING count({c}) > 0" for t, cs in star.TABLES.items() for c in cs) + ") GROUP BY col) GROUP BY tables")
def tables_per_column(env):
    from plumbline.operators.profile import tables_per_column as per_column

    used = C.column_nulls(env).filter(F.col("nulls") < F.col("rows"))
    return per_column(used).groupBy("tables").agg(F.count(F.lit(1)).alias("columns"))


# ---------------------------------------------------------------- test data
@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 20")
def newest_rows(env):
    return TD.newest_rows(env.table("orders"), "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"SELECT status AS value, count(*) AS rows, max(c_custkey) AS example FROM {star.CONTACTS} c GROUP BY status ORDER BY rows DESC, value LIMIT 50")
def one_example_each(env):
    found = TD.find_existing(env.with_tables(contacts=star.contacts(env)), "contacts")
    return found["One example for each status"]


@query(f"SELECT c_custkey, status FROM {star.CONTACTS} c WHERE is_deleted ORDER BY c_custkey DESC LIMIT 20")
def inactive_rows(env):
    found = TD.find_existing(env.with_tables(contacts=star.contacts(env)), "contacts")
    return found["Deleted / inactive rows (is_deleted)"].select("c_custkey", "status")


@query(f"SELECT c_custkey, email FROM {star.CONTACTS} c WHERE mobile_number IS NULL OR mobile_number = '' ORDER BY c_custkey DESC LIMIT 20")
def empty_text_rows(env):
    found = TD.find_existing(env.with_tables(contacts=star.contacts(env)), "contacts")
    return found["mobile_number is empty"].select("c_custkey", "email")


@query("SELECT doc_id, CAST(length(text) AS INT) AS text_length FROM documents ORDER BY text_length DESC, doc_id LIMIT 5")
def longest_text(env):
    return TD.longest_text(env.table("documents"), "text", "doc_id").select("doc_id", "text_length")


@query(f"""SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {star.ORDERS_B} b)
    ORDER BY l_orderkey DESC, l_partkey, l_suppkey, l_linenumber, l_quantity LIMIT 20""")
def rows_without_parent(env):
    found = TD.find_existing(env.with_tables(orders=star.orders_b(env)), "lineitem")
    return found["l_orderkey points to a missing orders"].select("l_orderkey", "l_partkey")


_PARENTS = """(SELECT list(c_custkey ORDER BY c_custkey) FROM (SELECT DISTINCT c_custkey FROM customer))
    [CAST((i - 1) % (SELECT count(DISTINCT c_custkey) FROM customer) + 1 AS BIGINT)]"""


@query(f"""SELECT CAST(i AS BIGINT) AS o_orderkey, {_PARENTS} AS o_custkey, 'qa_test_' || i AS o_orderstatus, 100.0 AS o_totalprice,
    'qa_test_' || i AS o_orderpriority FROM range(1, (SELECT count(*) FROM orders) + 1) r(i)""")
def generated_rows(env):
    """As many orders as there are."""
    return TD.generate_rows(env, "orders", "valid", env.table("orders").count()).drop("o_orderdate")


@query(f"""SELECT 9223372036854775807 AS o_orderkey, {_PARENTS} AS o_custkey, 'x' AS o_orderstatus, 100.0 AS o_totalprice, TIMESTAMP '{TD.LONGEST_MOMENT}' AS o_orderdate,
    repeat('x', {TD.DEFAULT_LENGTH}) AS o_orderpriority FROM range(1, 1001) r(i)""")
def generated_rows_longest(env):
    return TD.generate_rows(env, "orders", "longest", 1000, limits={"o_orderstatus": 1})


@query("""SELECT kind, count(*) AS values FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'num' WHEN p_partkey % 4 = 1 THEN 'bool' WHEN p_partkey % 4 = 2 THEN 'time' ELSE 'str' END AS kind
    FROM part) GROUP BY kind""")
def normal_forms(env):
    from pyspark.sql import types as T

    k = F.col("p_partkey")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit(" +"), k.cast("string"), F.lit(".50 "))).when(k % 4 == 1, "Yes")
        .when(k % 4 == 2, "2026-09-17T10:00:00+05:30").otherwise(F.col("p_name"))
    )
    form = V.normalise(raw, T.StringType())
    return env.table("part").select(F.split(form, ":")[0].alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("values"))
