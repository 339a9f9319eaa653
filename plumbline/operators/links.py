"""Links between tables: discovery, verification, paths and joins along them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import values as V
from plumbline.operators.inclusion import COVERAGE
from plumbline.sources.catalog import local_frame, union_all
from plumbline.sources.environment import Env, Link


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# Where a link comes from, strongest first.
LINK_ORIGINS = ["foreign key", "configured link", "name pattern"]
#: origin of links that no name suggests, only the values
BY_VALUES = "contained values"


def discover_links(columns: DataFrame, declared: DataFrame | None = None,
                   column_links: DataFrame | None = None, contained: DataFrame | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One link per column at most: declared, else configured by column name, else by name pattern, else by the values.

    ``columns`` has (tbl, col); ``declared`` (tbl, col, ref_tbl, ref_col, how);
    ``column_links`` (col, ref_tbl, ref_col) for every table with such a column; ``contained`` what ``inclusion.contained_links``
    found: with it, links that only names suggest need every value of the column among those of its target, and a column
    without any link gets the key it fills best, if it holds the share ``coverage`` of its values.
    """
    cols = columns.select("tbl", "col")
    targets = cols.select(F.col("tbl").alias("ref_tbl"), F.col("col").alias("ref_col"))
    out_cols = ["tbl", "col", "ref_tbl", "ref_col", "how", "rank"]
    found, named = [], []
    if declared is not None:
        origin = F.array_position(F.array(*[F.lit(o) for o in LINK_ORIGINS]), F.col("how"))
        found.append(
            declared.join(cols, ["tbl", "col"], "left_semi")
            .filter((F.col("how") == LINK_ORIGINS[0]) | (F.col("tbl") != F.col("ref_tbl")))
            .withColumn("rank", (origin * 10).cast("double")).select(*out_cols)
        )
    if column_links is not None:
        named.append(
            cols.join(column_links, "col")
            .filter(F.col("tbl") != F.col("ref_tbl"))
            .withColumn("how", F.lit(LINK_ORIGINS[1])).withColumn("rank", F.lit(21.0)).select(*out_cols)
        )
    # <base>_id points at a table called base, bases, basees or (y to) ies that has an id column
    base = F.expr("substring(col, 1, length(col) - 3)")
    names = F.array_compact(
        F.array(
            base, F.concat(base, F.lit("s")), F.concat(base, F.lit("es")),
            F.when(base.endswith("y"), F.concat(F.expr("substring(col, 1, length(col) - 4)"), F.lit("ies"))),
        )
    )
    named.append(
        cols.filter(F.col("col").endswith("_id") & (F.length("col") > 3))
        .select("tbl", "col", F.posexplode(names).alias("n", "ref_tbl"))
        .filter(F.col("tbl") != F.col("ref_tbl"))
        .select("tbl", "col", "ref_tbl", F.lit("id").alias("ref_col"), F.lit(LINK_ORIGINS[2]).alias("how"),
                (F.col("n") + 30).cast("double").alias("rank"))
    )
    by_name = union_all(named)
    if contained is not None:
        by_name = by_name.join(contained, ["tbl", "col", "ref_tbl", "ref_col"], "left_semi")
        # after all names; the fuller the key, the earlier
        found.append(contained.filter(F.col("coverage") >= coverage).select(
            "tbl", "col", "ref_tbl", "ref_col", F.lit(BY_VALUES).alias("how"), (F.lit(51.0) - F.col("coverage")).alias("rank")))
    known = union_all([*found, by_name]).join(targets, ["ref_tbl", "ref_col"], "left_semi")
    best = Window.partitionBy("tbl", "col").orderBy("rank", "ref_tbl", "ref_col")
    return (
        known.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") == 1)
        .select("tbl", "col", "ref_tbl", "ref_col", "how")
    )


def verify_link(env: Env, link: Link) -> DataFrame:
    """How well the data honours one link; both sides are counted per key before they meet."""
    own, other = env.table(link.table).schema[link.column].dataType, env.table(link.ref_table).schema[link.ref_column].dataType
    child = (
        env.table(link.table).groupBy(_c(link.column).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_ck", V.raw_key(F.col("_k"), own, other))
    )
    parent = (
        env.table(link.ref_table).filter(_c(link.ref_column).isNotNull())
        .groupBy(_c(link.ref_column).alias("_p")).agg(F.count(F.lit(1)).alias("m"))
        .withColumn("_cp", V.raw_key(F.col("_p"), other, own))
    )
    if own != other and T.StringType() in (own, other):
        # several spellings of one key are one key, also of a number that the other side cannot hold; a text that is no key stays by itself
        numbers = isinstance(own, V.NUMERIC) or isinstance(other, V.NUMERIC)

        def unmet(form: str, key: str) -> Column:
            text = F.col(key).cast("string")
            number = F.when(~F.ascii(text).between(65, 122), text.try_cast("decimal(38,9)")).cast("string")
            return F.when(F.col(form).isNull(), F.coalesce(number, text) if numbers else text)

        child = child.groupBy("_ck", unmet("_ck", "_k").alias("_k0")).agg(
            F.sum("n").alias("n"), F.first(F.col("_k").cast("string")).alias("_k"))
        parent = parent.groupBy("_cp", unmet("_cp", "_p").alias("_p0")).agg(
            F.sum("m").alias("m"), F.first(F.col("_p").cast("string")).alias("_p"))
    joined = child.join(parent, F.col("_ck") == F.col("_cp"), "full_outer")
    has_key, matched = F.col("_k").isNotNull(), F.col("_p").isNotNull()

    def rows(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))

    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_rows"),
        rows(~has_key).alias("null_rows"),
        rows(has_key & matched).alias("matched_rows"),
        rows(has_key & ~matched).alias("orphan_rows"),
        F.count_if(has_key & ~matched).alias("orphan_values"),
        F.count_if(matched & ~has_key).alias("unused_parents"),
        (F.coalesce(F.max("m"), F.lit(0)) <= 1).alias("parent_unique"),
    ).select(
        F.lit(f"{link.table}.{link.column}").alias("link"),
        F.lit(f"{link.ref_table}.{link.ref_column}").alias("points_to"), F.lit(link.how).alias("how"), "*",
    )


def verify_links(env: Env, links: Sequence[Link] | None = None) -> DataFrame:
    """``verify_link`` for many links, each table read once.

    The linked columns of a table are unpivoted to (link, side, value), and all links are grouped by value together, so a value of a
    third of the rows is one row of two counts. Links between columns of different types are verified one by one.
    """
    links = list(env.links if links is None else links)
    dtype = lambda table, column: env.table(table).schema[column].dataType
    alike = [dtype(k.table, k.column) == dtype(k.ref_table, k.ref_column) for k in links]
    roles: dict[str, list[Column]] = {}
    for i, k in enumerate(links):
        for table, column, child in ((k.table, k.column, 1), (k.ref_table, k.ref_column, 0)) if alike[i] else ():
            roles.setdefault(table, []).append(F.struct(
                F.lit(i).alias("i"), _c(column).cast("string").alias("v"), F.lit(child).alias("child"), F.lit(1 - child).alias("parent")))
    out = [verify_link(env, k) for i, k in enumerate(links) if not alike[i]]
    if roles:
        cells = union_all([env.table(t).select(F.inline(F.array(*own))) for t, own in roles.items()])
        values = cells.groupBy("i", "v").agg(F.sum("child").alias("c"), F.sum("parent").alias("p"))
        has_key = F.col("v").isNotNull()

        def rows(cond: Column) -> Column:
            return F.coalesce(F.sum(F.when(cond, F.col("c"))), F.lit(0))

        counts = values.groupBy("i").agg(
            F.sum("c").alias("child_rows"), rows(~has_key).alias("null_rows"), rows(has_key & (F.col("p") > 0)).alias("matched_rows"),
            rows(has_key & (F.col("p") == 0)).alias("orphan_rows"), F.count_if(has_key & (F.col("c") > 0) & (F.col("p") == 0)).alias("orphan_values"),
            F.count_if(has_key & (F.col("p") > 0) & (F.col("c") == 0)).alias("unused_parents"),
            (F.coalesce(F.max(F.when(has_key, F.col("p"))), F.lit(0)) <= 1).alias("parent_unique"))
        named = [(i, f"{k.table}.{k.column}", f"{k.ref_table}.{k.ref_column}", k.how) for i, k in enumerate(links) if alike[i]]
        listed = local_frame(env.spark, named, "i int, link string, points_to string, how string")
        found = ["child_rows", "null_rows", "matched_rows", "orphan_rows", "orphan_values", "unused_parents"]
        out.append(listed.join(counts, "i", "left").select(
            "link", "points_to", "how", *[F.coalesce(c, F.lit(0)).alias(c) for c in found], F.coalesce("parent_unique", F.lit(True)).alias("parent_unique")))
    return union_all(out)


_HOP = "struct<from_tbl:string,from_col:string,to_tbl:string,to_col:string,how:string>"
_WALK = f"struct<tbl:string,seen:array<string>,turns:int,path:array<{_HOP}>>"


def _walks(links: DataFrame, start: str, rounds: int, include_guesses: bool) -> DataFrame:
    """One row: w0, w1, ... are the tables reached by so many links and the first way to each, never through a table twice.

    Links can be walked both ways. They are a row for each column of a catalog at most, so the frontier is an array that each round
    expands by the links' array; nothing is shuffled but the links, once.
    """
    if not include_guesses:
        links = links.filter(~F.col("how").isin("name pattern", BY_VALUES))

    def edge(a: str, ac: str, b: str, bc: str, backwards: int) -> Column:
        return F.struct(F.struct(a, ac, b, bc, "how").cast(_HOP).alias("hop"), F.lit(backwards).alias("backwards"))

    both = F.array(edge("tbl", "col", "ref_tbl", "ref_col", 0), edge("ref_tbl", "ref_col", "tbl", "col", 1))
    row = links.select(F.explode(both).alias("e")).agg(F.array_sort(F.collect_list("e")).alias("edges"))
    begin = F.struct(F.lit(start), F.array(F.lit(start)), F.lit(0), F.array().cast(f"array<{_HOP}>")).cast(_WALK)
    row = row.withColumn("w0", F.array(begin))
    for k in range(1, rounds + 1):
        before = f"w{k - 1}"

        def onward(w: Column) -> Column:
            way = F.filter("edges", lambda e: (e["hop"]["from_tbl"] == w["tbl"]) & ~F.array_contains(w["seen"], e["hop"]["to_tbl"]))
            return F.transform(way, lambda e: F.struct(
                e["hop"]["to_tbl"].alias("tbl"), F.concat(w["seen"], F.array(e["hop"]["to_tbl"])).alias("seen"),
                (w["turns"] + e["backwards"]).alias("turns"), F.concat(w["path"], F.array(e["hop"])).alias("path")).cast(_WALK))

        row = row.withColumn("ways", F.array_sort(F.flatten(F.transform(before, onward))))
        # sorted by table first: one way to each stays
        row = row.withColumn(f"w{k}", F.filter("ways", lambda w, i: (i == 0) | (F.get("ways", i - 1)["tbl"] != w["tbl"])))
    return row


def neighbourhood(links: DataFrame, table: str, depth: int = 1, include_guesses: bool = True,
                  max_tables: int | None = None) -> DataFrame:
    """Tables within ``depth`` links of a table, in either direction, with their distance."""
    row = _walks(links, table, depth, include_guesses)
    reached = [F.arrays_zip(F.col(f"w{d}.tbl").alias("tbl"), F.array_repeat(F.lit(d), F.size(f"w{d}")).alias("distance")) for d in range(depth + 1)]
    out = row.select(F.inline(F.flatten(F.array(*reached)))).groupBy("tbl").agg(F.min("distance").alias("distance"))
    return out.orderBy("distance", "tbl").limit(max_tables) if max_tables else out


def join_path(links: DataFrame, start: str, goal: str, include_guesses: bool = True, max_depth: int = 4) -> DataFrame:
    """The shortest chain of links between two tables: step, from, to, condition columns; empty when there is none."""
    row = _walks(links, start, max_depth, include_guesses).filter(F.lit(start != goal))
    arrived = F.coalesce(*[F.get(F.filter(f"w{d}", lambda w: w["tbl"] == goal), F.lit(0))["path"] for d in range(1, max_depth + 1)])
    return row.select(F.posexplode(arrived).alias("step", "h")).select((F.col("step") + 1).alias("step"), "h.*")


def join_along(env: Env, start: str, path: Sequence[tuple[str, str, str, str]], columns_per_table: int | None = None,
               where: Column | None = None) -> DataFrame:
    """Inner joins along (from table, from column, to table, to column) steps; columns are named table__column.

    The condition is on columns of ``start`` and is applied before the joins.
    """
    keyed: dict[str, list[str]] = {}
    for a, ac, b, bc in path:
        keyed.setdefault(a, []).append(ac)
        keyed.setdefault(b, []).append(bc)

    def prefixed(table: str) -> DataFrame:
        df = env.safe_table(table)
        if table == start and where is not None:
            df = df.filter(where)
        first = [c for c in [env.keys.get(table), *keyed.get(table, [])] if c in df.columns]
        shown = list(dict.fromkeys(first + df.columns))[:columns_per_table]
        picked = list(dict.fromkeys(shown + keyed.get(table, [])))
        return df.select(*[_c(c).alias(f"{table}__{c}") for c in picked])

    out = prefixed(start)
    for a, ac, b, bc in path:
        right = prefixed(b)
        out = V.raw_join(out, f"{a}__{ac}", right, f"{b}__{bc}")
    return out


def linked_join(env: Env, table: str, link: Link, columns: int | None = None, where: Column | None = None) -> DataFrame:
    """Rows of a table with the rows of one linked table, columns named table.column."""
    own_col, other, other_col = (
        (link.column, link.ref_table, link.ref_column) if link.table == table else (link.ref_column, link.table, link.column)
    )
    left, right = env.safe_table(table), env.safe_table(other)
    if where is not None:
        left = left.filter(where)

    def side(df: DataFrame, name: str, key: str, tag: str) -> DataFrame:
        return df.select(_c(key).alias(tag), *[_c(c).alias(f"{name}.{c}") for c in df.columns[:columns]])

    a, b = side(left, table, own_col, "_l"), side(right, other, other_col, "_r")
    return V.raw_join(a, "_l", b, "_r").drop("_l", "_r")


def _present(col: Column) -> Column:
    """Empty link values (NULL, '', 0, NaN) are not followed."""
    text = col.cast("string")
    return col.isNotNull() & ~F.coalesce(text, F.lit("")).isin("", "0", "0.0", "NaN")


def linked_counts(env: Env, table: str, records: DataFrame, key: str, cap: int | None = None) -> DataFrame:
    """For a set of records: per link the matching rows on the other side, zeros included.

    The other side is reduced to the values asked for and counted per value, so a value in a third of its rows
    is one row when it meets the records.
    """
    out = []
    for link in [k for k in env.links if table in (k.table, k.ref_table)]:
        outgoing = link.table == table
        own, other, other_col = (
            (link.column, link.ref_table, link.ref_column) if outgoing else (link.ref_column, link.table, link.column)
        )
        values = records.filter(_present(_c(own))).select(_c(key).cast("string").alias("key"), _c(own).alias("_v"))
        rows, own_type = env.table(other), records.schema[own].dataType
        wanted = values.select(V.raw_key(F.col("_v"), own_type, rows.schema[other_col].dataType).alias("_w")).distinct()
        # only the values asked for are counted
        counts = (
            rows.select(V.raw_key(_c(other_col), rows.schema[other_col].dataType, own_type).alias("_o")).join(wanted, F.col("_o") == F.col("_w"), "left_semi")
            .groupBy("_o").agg(F.count(F.lit(1)).alias("matches"))
        )
        met = V.raw_key(F.col("_v"), own_type, rows.schema[other_col].dataType)
        matches = F.coalesce("matches", F.lit(0))
        out.append(
            values.join(counts, met == F.col("_o"), "left").select(
                "key", F.lit("points to" if outgoing else "referenced by").alias("direction"),
                F.lit(other).alias("tbl"), F.lit(other_col).alias("col"), F.lit(own).alias("this_column"),
                F.col("_v").cast("string").alias("value"), F.lit(link.how).alias("how"),
                (F.least(matches, F.lit(cap)) if cap else matches).alias("matches"),
            )
        )
    return union_all(out)
