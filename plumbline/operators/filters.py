"""Filter lists, projections, limits and named-value queries."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from decimal import Decimal, InvalidOperation
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import values as V
from plumbline.functions.values import INTEGRAL, NUMERIC
from plumbline.sources.environment import Env

# The filter operators.
OPERATORS = [
    "equals", "not equal", "contains", "starts with", "ends with", "greater than", "less than",
    "at least", "at most", "between", "one of", "is empty", "is not empty",
]


def typed_literal(text: str, dtype: T.DataType) -> Column:
    """The text as a literal of the column's type, NULL when it is no such value.

    A literal of the column's own type keeps the comparison a pushed-down Parquet filter.
    """
    if isinstance(dtype, NUMERIC):
        try:
            number = Decimal(text)
        except InvalidOperation:
            return F.lit(None).cast(dtype)
        if not number.is_finite():
            return F.lit(None).cast(dtype)
        if isinstance(dtype, INTEGRAL):
            whole = number == number.to_integral_value()
            if whole and abs(number) < 2**31 and not isinstance(dtype, T.LongType):
                return F.lit(int(number)).cast("int")
            if whole and abs(number) < 2**63:
                return F.lit(int(number)).cast("bigint")
            return F.lit(float(number))
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            return F.lit(float(number)).cast(dtype)
        return F.lit(number)
    if isinstance(dtype, T.StringType):
        return F.lit(text)
    return F.lit(text).try_cast(dtype)


def _like(col: Column, value: str, before: bool, after: bool) -> Column:
    """LIKE with the value's own % and _ as wildcards, open before and/or after.

    A value with an inner % becomes a pattern of atomic groups: each part is taken at its
    first place, which decides the match, so long texts are read once instead of being
    tried from every position.
    """
    text = col.cast("string")
    # a backslash escapes only %, _ and itself; anywhere else it is dropped, as SQL text does
    value = re.sub(r"\\(?![%_\\])", "", value)
    pieces = re.findall(r"(?:\\.|[^%\\])+", value)
    if len(pieces) < 2:
        return text.like(("%" if before else "") + value + ("%" if after else ""))
    before, after = before or value.startswith("%"), after or bool(re.search(r"(?<!\\)(?:\\\\)*%$", value))
    regex = [
        "".join("." if c == "_" else re.escape(c[-1]) for c in re.findall(r"\\.|.", piece, re.S)) for piece in pieces
    ]
    pattern = "(?s)^" + (f"(?>.*?{regex[0]})" if before else regex[0])
    pattern += "".join(f"(?>.*?{p})" for p in regex[1:-1])
    return text.rlike(pattern + (f".*?{regex[-1]}" if after else f".*{regex[-1]}\\z"))


def predicate(col: Column, dtype: T.DataType, op: str, value: str, case_insensitive: bool = False) -> Column | None:
    """One filter as a condition, None when it has to be ignored."""
    text = isinstance(dtype, T.StringType)
    if op == "is empty":
        return col.isNull() | (col == "") if text else col.isNull()
    if op == "is not empty":
        return col.isNotNull() & (col != "") if text else col.isNotNull()
    value = value.strip()
    if value == "":
        return None
    if case_insensitive and (text or op in ("contains", "starts with", "ends with")):
        col, value = F.lower(col.cast("string")), value.lower()
    if op == "contains":
        return _like(col, value, True, True)
    if op == "starts with":
        return _like(col, value, False, True)
    if op == "ends with":
        return _like(col, value, True, False)
    parts = [typed_literal(p.strip(), dtype) for p in value.split(",") if p.strip()]
    if op == "between":
        return col.between(*parts) if len(parts) == 2 else None
    if op == "one of":
        return col.isin(*parts) if parts else None
    literal = typed_literal(value, dtype)
    if op == "not equal":
        # NULL rows stay, and a value the column cannot hold excludes nothing
        return F.coalesce(col != literal, F.lit(True))
    compare = {
        "equals": col == literal,
        "greater than": col > literal,
        "less than": col < literal,
        "at least": col >= literal,
        "at most": col <= literal,
    }
    return compare.get(op)


def conditions(df: DataFrame, filters: Sequence[Mapping] | None, case_insensitive: bool = False) -> list[Column]:
    types = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for f in filters or []:
        name, op = f.get("col"), f.get("op")
        if name not in types or op not in OPERATORS:
            continue
        value = "" if f.get("val") is None else str(f["val"])
        cond = predicate(F.col(f"`{name}`"), types[name], op, value, case_insensitive)
        if cond is not None:
            out.append(cond)
    return out


def apply_filters(df: DataFrame, filters: Sequence[Mapping] | None, case_insensitive: bool = False) -> DataFrame:
    """Rows that satisfy every filter; unknown columns or operators and blank values are ignored."""
    found = conditions(df, filters, case_insensitive)
    return df.filter(reduce(lambda a, b: a & b, found)) if found else df


def newest(df: DataFrame, pk: str, n: int) -> DataFrame:
    """The n rows with the highest key."""
    return df.orderBy(F.desc(f"`{pk}`"), *in_order(df, pk)).limit(n)


def in_order(df: DataFrame, *but: str) -> list[Column]:
    """All columns but some as ascending sort keys, so that ties come out in one order."""
    return [V.orderable(F.col(f"`{f.name}`"), f.dataType).asc() for f in df.schema.fields if f.name not in but]


def browse(
    env: Env,
    table: str,
    columns: Sequence[str] | None = None,
    filters: Sequence[Mapping] | None = None,
    sort: str | None = None,
    descending: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Filtered, projected, sorted rows without secret columns."""
    df = apply_filters(env.table(table), filters)
    wanted = [c for c in (columns or df.columns) if c in df.columns]
    wanted = env.policy.safe(wanted)
    if sort in df.columns:
        order = F.desc(f"`{sort}`") if descending else F.asc(f"`{sort}`")
        df = df.orderBy(order, *in_order(df.select(*[f"`{c}`" for c in wanted]), sort))
    df = df.select(*[f"`{c}`" for c in wanted])
    return df.limit(limit) if limit is not None else df


def count_matching(df: DataFrame, filters: Sequence[Mapping] | None) -> DataFrame:
    return apply_filters(df, filters).agg(F.count(F.lit(1)).alias("rows"))


def limited(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(first n rows, one-row frame telling whether there were more)."""
    probe = df.limit(n + 1).agg((F.count(F.lit(1)) > n).alias("truncated"))
    return df.limit(n), probe


def named_query(spark: SparkSession, sql: str, values: Mapping) -> DataFrame:
    """SQL with ``:name`` values, bound by Spark and never pasted."""
    return spark.sql(sql, args=dict(values))


def template_query(env: Env, sql: str, identifiers: Mapping[str, str], values: Mapping | None = None,
                   column_of: Mapping[str, str] | None = None) -> DataFrame:
    """SQL with ``IDENTIFIER(:name)`` tables and columns that must exist, and ``:name`` values.

    ``identifiers`` maps a parameter to a table or column; ``column_of`` says which table
    parameter a column parameter belongs to.
    """
    column_of = column_of or {}
    asked = set(re.findall(r"(?<!:):([A-Za-z_]\w*)", sql))
    missing = sorted(asked - set(identifiers) - set(values or {}))
    if missing:
        raise ValueError(f"no value for {', '.join(missing)}")
    args, needed = dict(values or {}), []
    for name, target in identifiers.items():
        if name in column_of:
            table = identifiers[column_of[name]]
            if target not in env.table(table).columns:
                raise ValueError(f"{table} has no column {target!r}")
        else:
            needed.append(target)
        args[name] = target
    with env.as_views(needed) as session:
        return session.sql(sql, args=args)


def unique_names(df: DataFrame) -> DataFrame:
    """Later copies of a column name get ``_1``, ``_2``, ..."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = seen.get(c, -1) + 1
        seen[c] = n
        names.append(c if n == 0 else f"{c}_{n}")
    return df.toDF(*names)
