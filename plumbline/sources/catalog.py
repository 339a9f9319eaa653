"""Catalog frames: declared columns and links, and what the data says about them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.sources.environment import Env

ARROW_TYPES = {
    "string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(),
    "timestamp_ntz": pa.timestamp("us"), "array<string>": pa.list_(pa.string()),
}


def local_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A frame of definition-sized rows held in the plan, so that its size is known to the optimizer."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrays = [pa.array(list(c), ARROW_TYPES[t]) for c, (_, t) in zip(columns, fields)]
    return spark.createDataFrame(pa.table(arrays, names=[n for n, _ in fields]))


def as_catalog(df: DataFrame) -> DataFrame:
    """Evaluate a catalog frame once.

    Only for frames with at most a row per column or link of the environment: they are as
    small as the schemas the driver holds anyway.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return local_frame(df.sparkSession, [tuple(r) for r in df.collect()], schema)


COLUMNS_SCHEMA = (
    "tbl string, col string, type string, nullable string, key string, default string, extra string, pos int"
)
LINKS_SCHEMA = "tbl string, col string, ref_tbl string, ref_col string, how string"

# Spark types under the names the type rules know.
TYPE_NAMES = {
    T.ByteType: "tinyint", T.ShortType: "smallint", T.IntegerType: "int", T.LongType: "bigint",
    T.FloatType: "float", T.DoubleType: "double", T.BooleanType: "boolean", T.StringType: "longtext",
    T.BinaryType: "blob", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "datetime",
    T.VariantType: "json",
}


def type_name(dtype: T.DataType) -> str:
    return TYPE_NAMES.get(type(dtype), dtype.simpleString())


def catalog_columns(env: Env) -> DataFrame:
    """One row per declared column, from the schemas alone."""
    rows = []
    for table in env.tables:
        for pos, f in enumerate(env.table(table).schema.fields, start=1):
            meta = f.metadata or {}
            key = "PRI" if env.keys.get(table) == f.name else meta.get("key", "")
            declared = meta.get("type") or type_name(f.dataType)
            nullable = meta.get("nullable", "YES" if f.nullable else "NO")
            rows.append((table, f.name, declared, nullable, key, meta.get("default"), meta.get("extra", ""), pos))
    return local_frame(env.spark, rows, COLUMNS_SCHEMA)


def catalog_links(env: Env) -> DataFrame:
    rows = [(k.table, k.column, k.ref_table, k.ref_column, k.how) for k in env.links]
    return local_frame(env.spark, rows, LINKS_SCHEMA)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def table_counts(env: Env) -> DataFrame:
    """Exact rows per table; a Parquet count reads footers only."""
    return union_all(
        [env.table(t).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("tbl"), "rows") for t in env.tables]
    )


def column_nulls(env: Env, wanted: Callable[[str, T.DataType], bool] | None = None) -> DataFrame:
    """Rows and NULLs of every column, or of those ``wanted`` by name and type: one pass per table over these columns only."""

    def one(table: str) -> DataFrame | None:
        df = env.table(table)
        chosen = [(i, c) for i, c in enumerate(df.columns) if wanted is None or wanted(c, df.schema[c].dataType)]
        if not chosen:
            return None
        aggs = [F.count(F.lit(1)).alias("rows")]
        aggs += [F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in chosen]
        entries = [
            F.struct(
                F.lit(c).alias("col"), F.lit(i + 1).alias("pos"), F.lit(type_name(df.schema[c].dataType)).alias("type"),
                (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
            )
            for i, c in chosen
        ]
        return df.agg(*aggs).select(F.lit(table).alias("tbl"), "rows", F.inline(F.array(*entries)))

    found = [x for x in map(one, env.tables) if x is not None]
    return union_all(found) if found else local_frame(env.spark, [], "tbl string, rows bigint, col string, pos int, type string, nulls bigint")


def files_changed(env: Env) -> DataFrame:
    """Newest file modification per table (file-based tables)."""
    return union_all(
        [
            env.table(t)
            .agg(F.max("_metadata.file_modification_time").alias("updated"))
            .select(F.lit(t).alias("tbl"), "updated")
            for t in env.tables
        ]
    )


def schema_fingerprint(columns: DataFrame) -> DataFrame:
    """Column count and checksum sum; changes when any table, column or type changes."""
    line = F.concat(F.col("tbl"), F.lit("."), F.col("col"), F.lit(" "), F.col("type"))
    return columns.agg(
        F.count(F.lit(1)).alias("columns"), F.coalesce(F.sum(F.crc32(line)), F.lit(0)).alias("checksum")
    )
