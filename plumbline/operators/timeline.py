"""Timelines: one event per row and time column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import names as N
from plumbline.functions import values as V
from plumbline.operators.filters import in_order
from plumbline.sources.catalog import union_all
from plumbline.sources.environment import Env, Link


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def is_time_column(name: str, dtype: T.DataType) -> bool:
    """Times by type, or by a time-like name on text and wide integers."""
    if isinstance(dtype, V.TIMES):
        return True
    if not isinstance(dtype, (T.StringType, T.IntegerType, T.LongType)):
        return False
    return N.matches(N.TIME_NAME, name)


def time_column_flag(name: Column, type_text: Column) -> Column:
    """The same rule over a catalog of declared type names."""
    t = F.lower(F.coalesce(type_text, F.lit("")))
    by_type = t.startswith("datetime") | t.startswith("timestamp") | t.startswith("date")
    usable = (t == "") | t.contains("char") | t.contains("text") | t.contains("int")
    narrow = t.startswith("tinyint") | t.startswith("smallint")
    return by_type | (usable & ~narrow & N.name_flag(N.TIME_NAME, name))


def events_of(df: DataFrame, table: str, id_columns: Sequence[str] = ("id", "uid"), keep: Sequence[str] = ()) -> DataFrame:
    """time, table, row, column, event, status of every parsable time in a table; a narrow explode, no shuffle."""
    times = [f for f in df.schema.fields if is_time_column(f.name, f.dataType)]
    status_columns = [c for c in df.columns if N.matches(N.TIMELINE_STATUS_NAME, c)]
    id_column = next((c for c in id_columns if c in df.columns), df.columns[0])
    status = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), _c(c).cast("string")) for c in status_columns])
    cells = [
        F.struct(V.to_time(_c(f.name), f.dataType).alias("time"), F.lit(f.name).alias("column"))
        for f in times
    ]
    if not cells:
        cells = [F.struct(F.lit(None).cast("timestamp_ntz").alias("time"), F.lit("").alias("column"))]
    return (
        df.select(
            *[_c(c) for c in keep],
            F.concat(F.lit(f"{id_column}="), F.coalesce(_c(id_column).cast("string"), F.lit("None"))).alias("row"),
            (status if status_columns else F.lit("")).alias("status"),
            F.inline(F.filter(F.array(*cells), lambda e: e["time"].isNotNull())),
        )
        .select(
            *[_c(c) for c in keep], "time", F.lit(table).alias("table"), "row", "column",
            F.concat(F.lit(f"{table}."), F.col("column")).alias("event"), "status",
        )
    )


def timeline(sources: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Events of several (table, frame, id columns), in time order."""
    return union_all([events_of(df, t, ids) for t, df, ids in sources]).orderBy("time", "table", "column", "row")


def linked_timeline(env: Env, table: str, records: DataFrame, key: str, links: Sequence[Link] | None = None) -> DataFrame:
    """The timelines of a set of records with everything linked to them; ``key`` names the record.

    The set is what the caller selected; Spark broadcasts its keys when they are small and
    splits hot keys of the linked table otherwise.
    """
    parts = [
        events_of(records, table, (key,), keep=(key,)).select(_c(key).cast("string").alias("record"), "time", "table", "row", "column", "event", "status")
    ]
    for link in links if links is not None else [k for k in env.links if table in (k.table, k.ref_table)]:
        own, other, other_col = (
            (link.column, link.ref_table, link.ref_column) if link.table == table else (link.ref_column, link.table, link.column)
        )
        keys = records.filter(_c(own).isNotNull()).select(_c(key).cast("string").alias("record"), _c(own).alias("_v")).distinct()
        rows = env.safe_table(other)
        events = events_of(rows, other, (env.keys.get(other, rows.columns[0]),), keep=(other_col,))
        parts.append(
            V.raw_join(events, other_col, keys, "_v").select("record", "time", "table", "row", "column", "event", "status")
        )
    return union_all(parts)


def filter_timeline(events: DataFrame, tables: Sequence[str] = (), text: str = "", first_day: str | None = None,
                    last_day: str | None = None) -> DataFrame:
    """Events of chosen tables, with a text in event or status, within days (both inclusive)."""
    out = events
    if tables:
        out = out.filter(F.col("table").isin(list(tables)))
    if text:
        t = text.lower()
        out = out.filter(F.lower("event").contains(t) | F.lower("status").contains(t) | F.lower("row").contains(t))
    if first_day:
        out = out.filter(F.col("time") >= F.lit(first_day).cast("timestamp_ntz"))
    if last_day:
        out = out.filter(F.col("time") < F.lit(last_day).cast("timestamp_ntz") + F.expr("interval 1 day"))
    return out


def neighbours(df: DataFrame, column: str, value: Column, order_column: str, n: int = 5) -> DataFrame:
    """The n rows before the first and after the last row with a value, by an ordering column."""
    matching = df.filter(_c(column) == value)
    low = matching.agg(F.min(_c(order_column)).alias("low")).scalar()
    high = matching.agg(F.max(_c(order_column)).alias("high")).scalar()
    rest = in_order(df, order_column)
    # the bounds are scalar subqueries, known before the scans start
    before = df.filter(_c(order_column) < low).orderBy(F.desc(f"`{order_column}`"), *rest).limit(n)
    after = df.filter(_c(order_column) > high).orderBy(F.asc(f"`{order_column}`"), *rest).limit(n)
    return before.withColumn("side", F.lit("before")).unionAll(after.withColumn("side", F.lit("after")))
