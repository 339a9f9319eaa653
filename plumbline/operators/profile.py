"""Single-table profiles: counts, duplicates, missing values, coverage and key candidates.

Every function is one aggregation with map-side combining; a hot value costs no more
than any other because only partial counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import names as N
from plumbline.functions import values as V
from plumbline.operators.filters import apply_filters, newest
from plumbline.sources.catalog import local_frame, union_all
from plumbline.sources.environment import Env


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def kind_of(dtype: T.DataType) -> str:
    """The profile kind of a Spark type."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, V.INTEGRAL):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "decimal"
    if isinstance(dtype, V.TIMES):
        return "date"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, T.VariantType):
        return "json"
    if isinstance(dtype, T.BinaryType):
        return "binary"
    return "other"


def _shown(col: Column, dtype: T.DataType) -> Column:
    """Text of a minimum or maximum."""
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        return V.number_text(col)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(col, V.TIME_FORMAT)
    return col.cast("string")


def _total(cond: Column) -> Column:
    """Rows where the condition holds; NULL when it was never comparable."""
    return F.sum(cond.cast("int"))


def group_counts(df: DataFrame, columns: Sequence[str], filters=None, limit: int | None = None) -> DataFrame:
    """Rows per value of one or two columns, largest first."""
    out = apply_filters(df, filters).groupBy(*[_c(c) for c in columns]).agg(F.count(F.lit(1)).alias("rows"))
    if limit is None:
        return out
    return out.orderBy(F.desc("rows"), *[F.asc(f"`{c}`") for c in columns]).limit(limit)


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def status_breakdown(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value, NULL included."""
    counts = df.groupBy(_c(column).alias("value")).agg(F.count(F.lit(1)).alias("row_count"))
    return _first(counts.orderBy(F.desc("row_count"), F.asc("value")), limit)


def _copies(df: DataFrame, columns: Sequence[str], long_values: bool = False) -> DataFrame:
    """Values that occur more than once, with their copies.

    With ``long_values`` the first shuffle carries 8-byte hashes only and the values
    themselves move just for rows that have a twin by hash.
    """
    df = df.filter(reduce(lambda a, b: a & b, [_c(c).isNotNull() for c in columns]))
    if long_values:
        cells = _repeated_cells(df, columns)
        df = cells.select(*[F.col(f"_v{i}").alias(c) for i, c in enumerate(columns)])
    grouped = df.groupBy(*[_c(c) for c in columns]).agg(F.count(F.lit(1)).alias("copies"))
    return grouped.filter(F.col("copies") > 1)


def duplicates(df: DataFrame, columns: Sequence[str], long_values: bool = False) -> DataFrame:
    """How many values occur more than once, and how many rows carry them."""
    return _copies(df, columns, long_values).agg(
        F.count(F.lit(1)).alias("duplicated_values"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_involved")
    )


def most_repeated(df: DataFrame, columns: Sequence[str], limit: int | None = None, long_values: bool = False) -> DataFrame:
    out = _copies(df, columns, long_values)
    return _first(out.orderBy(F.desc("copies"), *[F.asc(f"`{c}`") for c in columns]), limit)


def missing_values(df: DataFrame, column: str) -> DataFrame:
    """Rows that are NULL or blank, against all rows."""
    blank = _c(column).isNull() | (F.trim(_c(column).cast("string")) == "")
    return df.agg(F.count(F.lit(1)).alias("total_rows"), F.coalesce(F.count_if(blank), F.lit(0)).alias("missing_rows"))


def chart_counts(df: DataFrame, x: str, split: str | None = None) -> DataFrame:
    """Rows per x (and split), NULL kept as a group."""
    columns = [x] + ([split] if split else [])
    return df.groupBy(*[_c(c) for c in columns]).agg(F.count(F.lit(1)).alias("rows"))


PROFILE_METRICS = ["nulls", "empty", "spaces", "longest", "zero", "negative"]


def profile(
    df: DataFrame,
    sample_newest: int | None = None,
    pk: str | None = None,
    max_columns: int | None = None,
    policy: N.NamePolicy = N.DEFAULT_POLICY,
    limits: Mapping[str, int] | None = None,
) -> DataFrame:
    """Coverage of every column in one pass over the table.

    Metrics that do not fit a column's kind, and text metrics of a column without any
    value, are NULL.  Personal columns get counts only.
    """
    if sample_newest is not None:
        df = newest(df, pk or df.columns[0], sample_newest)
    fields = [
        f for f in df.schema.fields if not policy.is_secret(f.name) and kind_of(f.dataType) != "binary"
    ][:max_columns]
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    entries: list[Column] = []
    counted: list[str] = []
    for i, f in enumerate(fields):
        c, kind = _c(f.name), kind_of(f.dataType)
        personal = policy.is_personal(f.name) or "mail" in f.name.lower()
        metrics: dict[str, Column] = {"nulls": F.count(F.lit(1)) - F.count(c)}
        if kind == "text":
            metrics["empty"] = _total(c == "")
            metrics["spaces"] = _total(c != F.trim(c))
            metrics["longest"] = F.max(F.length(c)).cast("bigint")
        elif kind in ("integer", "decimal") and not personal:
            metrics["zero"] = _total(c == 0)
            metrics["negative"] = _total(c < 0)
        elif kind == "boolean" or (kind != "date" and N.matches(N.STATUS_NAME, f.name)):
            counted.append(f.name)
        ranged = kind == "date" or (kind in ("integer", "decimal") and not personal)
        if ranged:
            aggs += [F.min(c).alias(f"min{i}"), F.max(c).alias(f"max{i}")]
        for name, metric in metrics.items():
            aggs.append(metric.alias(f"{name}{i}"))
        entries.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.lit(kind).alias("kind"),
                *[
                    (F.col(f"{m}{i}") if m in metrics else F.lit(None)).cast("bigint").alias(m)
                    for m in PROFILE_METRICS
                ],
                *[
                    (_shown(F.col(f"{m}{i}"), f.dataType) if ranged else F.lit(None).cast("string")).alias(m)
                    for m in ("min", "max")
                ],
                F.lit((limits or {}).get(f.name)).cast("bigint").alias("limit"),
            )
        )
    out = df.agg(*aggs).select("rows", F.inline(F.array(*entries)))
    if not counted:
        return out.withColumn("distinct", F.lit(None).cast("bigint"))
    # distinct values of choice-like columns: a second, pruned scan that groups instead of expanding the row
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("v")) for c in counted]))
    distinct = df.select(cells).groupBy("column", "v").agg(F.lit(1).alias("_one"))
    distinct = distinct.groupBy("column").agg(F.count("v").alias("distinct"))
    return out.join(distinct, "column", "left").select(*out.columns, "distinct")


def examples_per_value(df: DataFrame, column: str, pk: str, limit: int | None = None) -> DataFrame:
    """Every value with its rows and the highest key as an example."""
    out = df.groupBy(_c(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"), F.max(_c(pk)).alias("example"))
    return _first(out.orderBy(F.desc("rows"), F.asc("value")), limit)


# A column whose estimated distinct count is below this share of the rows cannot be unique: the
# relative error of a sketch of 2^12 registers is 1.6 %, so the margin is twelve standard errors.
KEY_SKETCH_BITS = 12
KEY_ESTIMATE_SHARE = 0.8


def _cell(f: T.StructField) -> Column:
    """The value that has to be unique; NULL counts as the text None."""
    return F.coalesce(_c(f.name), F.lit("None")) if isinstance(f.dataType, T.StringType) else _c(f.name)


def unique_columns(df: DataFrame, columns: Sequence[str]) -> list[DataFrame]:
    """Per column a frame that holds its name if, and only if, no value occurs twice.

    Text is grouped by its 8-byte hash: different hashes are different values, so a column
    without a repeated hash is unique.  Only rows under a repeated hash are compared as text.
    """
    fields = {f.name: f for f in df.schema.fields}

    def one(c: str) -> DataFrame:
        cell, name = _cell(fields[c]), F.lit(c).alias("column")
        if isinstance(fields[c].dataType, (T.StringType, T.BinaryType)):
            repeated = _repeated_cells(df, [c])
            most = repeated.groupBy("_v0").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
        else:
            most = df.groupBy(cell.alias("_v0")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"))
        return most.filter(F.coalesce(F.col("n"), F.lit(1)) == 1).select(name)

    return [one(c) for c in columns]


def _repeated_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The cells (_v0, _v1, ...) of rows whose hash occurs more than once."""
    fields = {f.name: f for f in df.schema.fields}
    cells = [_cell(fields[c]).alias(f"_v{i}") for i, c in enumerate(columns)]
    hashed = df.select(*cells).withColumn("_h", F.xxhash64(*[f"_v{i}" for i in range(len(cells))]))
    twice = (
        hashed.groupBy(F.col("_h").alias("_r")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("_r")
    )
    return hashed.join(twice, F.col("_h") == F.col("_r"), "left_semi").drop("_h")


def measure(df: DataFrame) -> list[tuple[str, int, int, bool]]:
    """(column, rows, nulls, may be unique) from one pass of counts and sketches: one row reaches the driver."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count(_c(c)).alias(f"n{i}"))
        sketch = F.hll_sketch_agg(F.xxhash64(_c(c)), F.lit(KEY_SKETCH_BITS))
        aggs.append(F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).alias(f"d{i}"))
    row = df.agg(*aggs).first()
    return [
        (c, row["rows"], row["rows"] - row[f"n{i}"], row[f"d{i}"] >= KEY_ESTIMATE_SHARE * row["rows"])
        for i, c in enumerate(df.columns)
    ]


def key_rank(df: DataFrame, column: str) -> int:
    """Id-like names first, then the order of the columns."""
    id_like = column == "id" or column.endswith("_id")
    return (0 if id_like else len(df.columns)) + df.columns.index(column)


def key_candidates(df: DataFrame, policy: N.NamePolicy = N.DEFAULT_POLICY) -> DataFrame:
    """Columns that are unique over the whole table, id-like names first.

    One pass of sketches rules out the clear cases; only what is left is counted exactly,
    one column at a time, with map-side combining.
    """
    df = df.select(*[_c(c) for c in policy.safe(df.columns)])
    likely = [c for c, _, _, maybe in measure(df) if maybe]
    if not likely:
        return local_frame(df.sparkSession, [], "column string, rank int")
    found = union_all(unique_columns(df, likely))
    rank = F.lit(0)
    for c in likely:
        rank = F.when(F.col("column") == c, F.lit(key_rank(df, c))).otherwise(rank)
    return found.select("column", rank.alias("rank"))


def tables_per_column(columns: DataFrame) -> DataFrame:
    return columns.groupBy("col").agg(F.countDistinct("tbl").alias("tables"))


def _detectors(c: Column) -> dict[str, Column]:
    """Conditions on a text cell."""
    from plumbline.functions import privacy as P

    return {
        "email_rows": P.personal_text(c), "at_rows": c.contains("@"), "phone_rows": P.phone_text(c), "secret_rows": P.secret_text(c)}


def pii_parts(df: DataFrame, policy: N.NamePolicy = N.DEFAULT_POLICY) -> DataFrame:
    """One pass over a table: column, named, detector, rows, hits, texts; a row for each text column and detector, and one without
    a detector for each other column.

    ``hits`` are cells the detector fires on, ``texts`` a sketch of the distinct ones: both can be added up over parts of a table
    (``pii_merged``). ``named`` says what the column's name promises. Nothing of the texts themselves is kept.
    """
    aggs, entries = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(df.schema.fields):
        named = "secret" if policy.is_secret(f.name) else "personal" if policy.is_personal(f.name) else ""
        found = _detectors(_c(f.name)) if isinstance(f.dataType, T.StringType) else {}
        for name, fires in found.items():
            aggs += [F.count_if(fires).alias(f"{name}{i}"), F.hll_sketch_agg(F.when(fires, _c(f.name))).alias(f"{name}{i}_texts")]
        cells = [(name, F.col(f"{name}{i}"), F.col(f"{name}{i}_texts")) for name in found] or [("", F.lit(0).cast("bigint"), F.lit(None).cast("binary"))]
        entries += [
            F.struct(F.lit(f.name).alias("column"), F.lit(named).alias("named"), F.lit(name.removesuffix("_rows")).alias("detector"),
                     hits.alias("hits"), texts.alias("texts")) for name, hits, texts in cells]
    return df.agg(*aggs).select("rows", F.inline(F.array(*entries)))


def pii_merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Parts of tables added up: per column and detector rows, hits and about how many distinct texts (an estimate, error some 2 %)."""
    names = [*keys, "column", "named", "detector"]
    return parts.groupBy(*names).agg(
        F.sum("rows").alias("rows"), F.sum("hits").alias("hits"), F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("texts")), F.lit(0)).alias("distinct_texts"))


def pii_catalog(env: Env) -> DataFrame:
    """``pii_parts`` of every table of an environment, with the table: one pass each, a few rows out of it."""
    return union_all([pii_parts(env.table(t), env.policy).select(F.lit(t).alias("tbl"), "*") for t in env.tables])


def pii_scan(df: DataFrame, policy: N.NamePolicy = N.DEFAULT_POLICY) -> DataFrame:
    """Personal data per column over the whole table: e-mails, phone runs, secret pairs, and what the name says."""
    aggs, entries = [F.count(F.lit(1)).alias("rows")], []
    names = ["email_rows", "at_rows", "phone_rows", "secret_rows"]
    for i, f in enumerate(df.schema.fields):
        found = _detectors(_c(f.name)) if isinstance(f.dataType, T.StringType) else {}
        aggs += [F.count_if(cond).alias(f"{name}{i}") for name, cond in found.items()]
        named = "secret" if policy.is_secret(f.name) else "personal" if policy.is_personal(f.name) else ""
        counts = [(F.col(f"{name}{i}") if name in found else F.lit(0)).cast("bigint").alias(name) for name in names]
        entries.append(F.struct(F.lit(f.name).alias("column"), F.lit(named).alias("named"), *counts))
    return df.agg(*aggs).select("rows", F.inline(F.array(*entries)))
