"""Structure findings, checked against the data where the data can tell."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import names as N
from plumbline.functions import text as X
from plumbline.operators.profile import measure, unique_columns
from plumbline.sources.catalog import column_nulls, local_frame, table_counts, type_name, union_all
from plumbline.sources.environment import Env

# Thresholds and titles.
LARGE_ROWS = 1_000_000
WIDE_COLUMNS = 80
NULLABLE_SHARE = 0.8
MIN_NULLABLE_COLUMNS = 5
TITLES = {
    "no_primary_key": "No primary key",
    "type_mismatch": "Link column type differs from its target",
    "mostly_nullable": "Most columns allow NULL",
    "wide": "Very wide table",
    "empty": "Empty table",
    "leftover": "Looks like a backup / temp copy",
    "large": "Large table",
}


MEASURED_SCHEMA = (
    "tbl string, col string, type string, nullable string, key string, default string, pos int, rows bigint, nulls bigint"
)


def measured_columns(env: Env, workers: int = 4) -> DataFrame:
    """A catalog in which NULLs and keys are what the data holds, one row per column.

    ``key`` is PRI for the declared key while it is unique, UNI for any other unique column.
    Like a statistics command this measures now: per table one pass of counts and sketches,
    then exact counts of the few columns that may be unique.  Only catalog rows come back.
    """

    def one(table: str) -> list[tuple]:
        df = env.table(table)
        measured = measure(df)
        likely = [c for c, _, _, maybe in measured if maybe]
        unique = {r["column"] for r in union_all(unique_columns(df, likely)).collect()} if likely else set()
        rows = []
        for pos, (c, n, nulls, _) in enumerate(measured, start=1):
            key = "" if c not in unique else "PRI" if env.keys.get(table) == c else "UNI"
            rows.append((table, c, type_name(df.schema[c].dataType), "YES" if nulls else "NO", key, "", pos, n, nulls))
        return rows

    with ThreadPoolExecutor(max_workers=workers) as pool:
        found = list(pool.map(one, env.tables))
    return local_frame(env.spark, [r for rows in found for r in rows], MEASURED_SCHEMA)


def measured_counts(columns: DataFrame) -> DataFrame:
    """Rows per table of a measured catalog."""
    return columns.groupBy("tbl").agg(F.max("rows").alias("rows"))


def tables_without_key(columns: DataFrame) -> DataFrame:
    """Tables of a measured catalog in which no single column is unique."""
    return columns.groupBy("tbl").agg(F.max("key").alias("key")).filter(F.col("key") == "").select("tbl")


def type_mismatches(columns: DataFrame, links: DataFrame) -> DataFrame:
    """Links whose two columns differ in base type or signedness."""
    a = columns.select("tbl", "col", F.col("type").alias("t1"))
    b = columns.select(F.col("tbl").alias("ref_tbl"), F.col("col").alias("ref_col"), F.col("type").alias("t2"))
    p1, p2 = X.parse_type(F.col("t1")), X.parse_type(F.col("t2"))

    def base(p: Column) -> Column:
        return F.when(p["base"] == "integer", "int").otherwise(p["base"])

    joined = links.join(a, ["tbl", "col"]).join(b, ["ref_tbl", "ref_col"])
    differs = (base(p1) != base(p2)) | (p1["unsigned"] != p2["unsigned"])
    detail = F.concat("t1", F.lit(" → "), "ref_tbl", F.lit("."), "ref_col", F.lit(" "), "t2")
    return joined.filter(p1["kind"].isin("integer", "text") & differs).select(
        F.lit("type_mismatch").alias("check"), F.col("tbl").alias("table"), F.col("col").alias("column"), detail.alias("detail")
    )


def structure_findings(columns: DataFrame, counts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Findings from columns (tbl, col, type, nullable, key) and row counts (tbl, rows).

    A unique column is as good as a declared key.
    """
    per_table = columns.groupBy("tbl").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.upper("nullable") == "YES").alias("nullable"),
        F.count_if(F.col("key").isin("PRI", "UNI")).alias("primary"),
    ).join(counts, "tbl")
    n, columns_text = F.col("n"), F.concat(F.col("n").cast("string"), F.lit(" columns"))

    def finding(check: str, cond: Column, detail: Column) -> Column:
        return F.when(cond, F.struct(F.lit(check).alias("check"), detail.alias("detail")))

    share = F.col("nullable") / n
    found = F.array_compact(F.array(
        finding("no_primary_key", F.col("primary") == 0, columns_text),
        finding("mostly_nullable", (n >= MIN_NULLABLE_COLUMNS) & (share >= NULLABLE_SHARE),
                F.concat(F.col("nullable").cast("string"), F.lit(" of "), columns_text)),
        finding("wide", n > WIDE_COLUMNS, columns_text),
        finding("empty", F.col("rows") == 0, F.lit("")),
        finding("large", F.col("rows") > LARGE_ROWS, F.concat(F.col("rows").cast("string"), F.lit(" rows"))),
        finding("leftover", N.name_flag(N.LEFTOVER_NAME, F.col("tbl")), F.lit("")),
    ))
    out = per_table.select(F.col("tbl").alias("table"), "rows", F.inline(found)).select(
        "check", "table", F.lit("").alias("column"), "detail", "rows"
    )
    if links is not None:
        mismatched = type_mismatches(columns, links).join(counts, F.col("table") == F.col("tbl")).drop("tbl")
        out = out.unionByName(mismatched)
    return out


def with_titles(findings: DataFrame) -> DataFrame:
    title = F.lit(None).cast("string")
    for check, text in TITLES.items():
        title = F.when(F.col("check") == check, F.lit(text)).otherwise(title)
    return findings.withColumn("title", title)


def health(env: Env, links: DataFrame | None = None) -> DataFrame:
    """All findings of an environment, with measured NULLs, keys and row counts."""
    columns = measured_columns(env)
    return with_titles(structure_findings(columns, measured_counts(columns), links))


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings per check, every check listed."""
    checks = local_frame(findings.sparkSession, [(c,) for c in TITLES], "check string")
    counts = findings.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    return checks.join(counts, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("findings"))


def catalog_totals(env: Env, links: DataFrame) -> DataFrame:
    """Tables, columns, rows and links of an environment in one row."""
    nulls = column_nulls(env)
    totals = nulls.groupBy("tbl").agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("rows")).agg(
        F.count(F.lit(1)).alias("tables"), F.sum("n").alias("columns"), F.sum("rows").alias("rows"),
    )
    return totals.withColumn("links", links.agg(F.count(F.lit(1))).scalar())


def biggest_tables(env: Env, n: int = 15) -> DataFrame:
    sizes = table_counts(env)
    widths = local_frame(env.spark, [(t, len(env.table(t).columns)) for t in env.tables], "tbl string, columns int")
    return sizes.join(widths, "tbl").orderBy(F.desc("rows"), "tbl").limit(n)


def empty_tables(env: Env) -> DataFrame:
    return table_counts(env).filter(F.col("rows") == 0)


def filter_findings(findings: DataFrame, checks=(), text: str = "") -> DataFrame:
    """Findings of some checks whose table or column holds a text."""
    out = findings.filter(F.col("check").isin(list(checks))) if checks else findings
    if text:
        t = text.lower()
        out = out.filter(F.lower("table").contains(t) | F.lower("column").contains(t))
    return out
