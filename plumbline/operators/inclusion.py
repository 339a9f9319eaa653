"""Which columns hold the values of which others: links and matching fields found in the data, whatever the names.

Every table is read once and unpivoted to (column, value); all values of all columns are grouped by value once. What a value carries
is a bit for each column that holds it, so rows of one value are one row of a few longs as soon as a task has seen them, and the
number of distinct bit patterns, not of values, is what the pairs of columns are counted from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.values import INTEGRAL
from plumbline.sources.catalog import local_frame, union_all
from plumbline.sources.environment import Env

#: columns a long has bits for
BITS = 62
#: share of a key's values that a column must hold for a link that only the values suggest
COVERAGE = 0.5
_SCHEMA = "tbl string, col string, pos int, ref_tbl string, ref_col string, shared bigint, col_values bigint, ref_values bigint, ref_unique boolean"


def linkable(name: str, dtype: T.DataType) -> bool:
    """Whole numbers and texts can name a row."""
    return isinstance(dtype, (*INTEGRAL, T.StringType))


def _columns(env: Env, wanted: Callable[[str, T.DataType], bool]) -> list[tuple[str, str, int]]:
    return [
        (t, f.name, i) for t in env.tables for i, f in enumerate(env.table(t).schema.fields, start=1) if wanted(f.name, f.dataType)]


def value_bits(env: Env, columns: list[tuple[str, str, int]]) -> DataFrame:
    """bits_0, bits_1, ...: a row for each distinct value of the columns, bit i % 62 of bits_{i // 62} set if column i holds it.

    Values are equal if their texts are; they are grouped by 128 bits of hash. NULL is no value.
    """
    words = range(-(-len(columns) // BITS))
    parts = []
    for table in dict.fromkeys(t for t, _, _ in columns):
        own = [(i, c) for i, (t, c, _) in enumerate(columns) if t == table]
        cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in own])
        parts.append(env.table(table).select(F.inline(cells)).filter(F.col("v").isNotNull()).select(
            F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"), "i"))

    def bits(w: int) -> Column:
        here = F.floor(F.col("i") / BITS) == w
        return F.bit_or(F.when(here, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("i") % BITS)).otherwise(F.lit(0).cast("bigint")))

    return union_all(parts).groupBy("h1", "h2").agg(*[bits(w).alias(f"bits_{w}") for w in words]).drop("h1", "h2")


def overlaps(env: Env, wanted: Callable[[str, T.DataType], bool] = linkable) -> DataFrame:
    """Per pair of columns that share a value: tbl, col, pos, ref_tbl, ref_col, shared, col_values, ref_values (distinct values), ref_unique.

    ``pos`` is the place of ``col`` in its table; ``ref_unique`` says that no value of ``ref_col`` occurs twice.
    """
    columns = _columns(env, wanted)
    if not columns:
        return local_frame(env.spark, [], _SCHEMA)
    words = [f"bits_{w}" for w in range(-(-len(columns) // BITS))]
    patterns = value_bits(env, columns).groupBy(*words).agg(F.count(F.lit(1)).alias("n"))
    has = lambda i: F.call_function("getbit", F.get(F.array(*words), F.floor(i / BITS).cast("int")), (i % BITS).cast("int")) == 1
    held = patterns.select("n", F.filter(F.sequence(F.lit(0), F.lit(len(columns) - 1)), has).alias("held"))
    pairs = (
        held.select("n", "held", F.explode("held").alias("a")).select("n", "a", F.explode("held").alias("b"))
        .groupBy("a", "b").agg(F.sum("n").alias("shared"))
    )
    own = pairs.filter("a = b").select("a", F.col("shared").alias("size"))
    filled = union_all([
        env.table(t).agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, (u, c, _) in enumerate(columns) if u == t]).select(
            F.inline(F.array(*[F.struct(F.lit(i).alias("b"), F.col(f"n{i}").alias("filled")) for i, (u, _, _) in enumerate(columns) if u == t])))
        for t in dict.fromkeys(t for t, _, _ in columns)
    ])
    names = local_frame(env.spark, [(i, t, c, p) for i, (t, c, p) in enumerate(columns)], "i int, tbl string, col string, pos int")
    left = names.join(own, F.col("i") == F.col("a")).select("a", "tbl", "col", "pos", F.col("size").alias("col_values"))
    right = names.join(own, F.col("i") == F.col("a")).join(filled, F.col("i") == F.col("b")).select(
        "b", F.col("tbl").alias("ref_tbl"), F.col("col").alias("ref_col"), F.col("size").alias("ref_values"), (F.col("filled") == F.col("size")).alias("ref_unique"))
    return pairs.filter("a <> b").join(left, "a").join(right, "b").select(*[c.split()[0] for c in _SCHEMA.split(", ")])


def inclusions(shared: DataFrame) -> DataFrame:
    """The pairs of ``overlaps`` in which every value of ``col`` is one of ``ref_col``, with the share of ``ref_col`` that is met."""
    return shared.filter(F.col("shared") == F.col("col_values")).withColumn("coverage", F.col("col_values") / F.col("ref_values"))


def contained_links(found: DataFrame) -> DataFrame:
    """tbl, col, ref_tbl, ref_col, coverage: the pairs of ``inclusions`` that can be links, to a unique column of another table."""
    return found.filter(F.col("ref_unique") & (F.col("tbl") != F.col("ref_tbl"))).select("tbl", "col", "ref_tbl", "ref_col", "coverage")


def matching_fields(shared: DataFrame, source: str, target: str) -> DataFrame:
    """source, pos, target, likeness: for each column of one table the columns of another by the Jaccard likeness of their values."""
    met = shared.filter((F.col("tbl") == source) & (F.col("ref_tbl") == target))
    return met.select(
        F.col("col").alias("source"), "pos", F.col("ref_col").alias("target"),
        (F.col("shared") / (F.col("col_values") + F.col("ref_values") - F.col("shared"))).alias("likeness"))
