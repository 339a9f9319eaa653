"""Profiles that grow with their tables: a part for each group of files, stored, and parts merged into the profile of the whole.

A part holds counts, smallest and largest values, and two sketches of each column, all of which can be merged. When files are added,
only they are read; the rest of the table is in the parts already stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.names import DEFAULT_POLICY, NamePolicy
from plumbline.functions.values import INTEGRAL, NUMERIC

#: log2 of the registers of a distinct-values sketch (error about 1.04 / sqrt(2 ** n) = 1.6 %), and the size of a quantile sketch (rank error below 1 %)
REGISTERS, QUANTILE_SIZE = 12, 400
PART_SCHEMA = (
    "part string, column string, rows bigint, filled bigint, empty bigint, smallest double, largest double, shortest bigint, longest bigint, "
    "distinct_sketch binary, quantile_sketch binary")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _sketched(dtype: T.DataType) -> bool:
    return isinstance(dtype, (*NUMERIC, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def profile_parts(df: DataFrame, part: Column | None = None, policy: NamePolicy = DEFAULT_POLICY) -> DataFrame:
    """``PART_SCHEMA``: one pass over a table, a row for each part and column; secret columns are not read.

    ``part`` names the group a row belongs to, by default its file. ``smallest`` and ``largest`` are of numbers, ``shortest`` and
    ``longest`` lengths of texts.
    """
    part = F.col("_metadata.file_path") if part is None else part
    fields = [f for f in df.schema.fields if not policy.is_secret(f.name)]
    none, no_sketch = F.lit(None), F.lit(None).cast("binary")
    aggs, entries = [F.count(F.lit(1)).alias("rows")], []
    for i, f in enumerate(fields):
        c, text, number = _c(f.name), isinstance(f.dataType, T.StringType), isinstance(f.dataType, NUMERIC)
        double = c.cast("double")
        own = {"filled": F.count(c)}
        if text:
            own |= {"empty": F.count_if(c == ""), "shortest": F.min(F.char_length(c).cast("bigint")), "longest": F.max(F.char_length(c).cast("bigint"))}
        if number:
            own |= {"smallest": F.min(double), "largest": F.max(double), "quantiles": F.kll_sketch_agg_double(double, F.lit(QUANTILE_SIZE))}
        if _sketched(f.dataType):
            plain = c if isinstance(f.dataType, (T.StringType, *INTEGRAL)) else c.cast("string")
            own["distinct"] = F.hll_sketch_agg(plain.cast("bigint") if isinstance(f.dataType, INTEGRAL) else plain, F.lit(REGISTERS))
        aggs += [a.alias(f"{k}_{i}") for k, a in own.items()]
        at = lambda k, kind, own=own, i=i: F.col(f"{k}_{i}").cast(kind) if k in own else none.cast(kind)
        entries.append(F.struct(
            F.lit(f.name).alias("column"), at("filled", "bigint").alias("filled"), at("empty", "bigint").alias("empty"), at("smallest", "double").alias("smallest"),
            at("largest", "double").alias("largest"), at("shortest", "bigint").alias("shortest"), at("longest", "bigint").alias("longest"),
            (F.col(f"distinct_{i}") if "distinct" in own else no_sketch).alias("distinct_sketch"),
            (F.col(f"quantiles_{i}") if "quantiles" in own else no_sketch).alias("quantile_sketch")))
    names = [f.split()[0] for f in PART_SCHEMA.split(", ")]
    whole = df.select(part.cast("string").alias("_part"), *[_c(f.name) for f in fields]).groupBy("_part").agg(*aggs)
    return whole.select(F.col("_part").alias("part"), "rows", F.inline(F.array(*entries))).select(*names)


def merged_profile(parts: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile of all parts together: column, rows, nulls, empty, smallest, largest, shortest, longest, which are exact, and
    about how many distinct values, and the numbers at the given ranks, which are estimates."""
    filled = F.col("smallest").isNotNull()  # a sketch of no numbers has no quantiles
    ranks = [F.when(filled, F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q))).alias(f"q{round(q * 100)}") for q in quantiles]
    whole = parts.groupBy("column").agg(
        F.sum("rows").alias("rows"), (F.sum("rows") - F.sum("filled")).alias("nulls"), F.sum("empty").alias("empty"), F.min("smallest").alias("smallest"),
        F.max("largest").alias("largest"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_values"), F.kll_merge_agg_double("quantile_sketch").alias("quantile_sketch"))
    return whole.select(
        "column", "rows", "nulls", "empty", "smallest", "largest", "shortest", "longest", "distinct_values", *ranks)


def append_parts(parts: DataFrame, path: str) -> None:
    parts.write.mode("append").parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PART_SCHEMA).parquet(path)


def update_profile(df: DataFrame, path: str, stored: bool = True) -> DataFrame:
    """Profile the files of ``df`` that have no part yet, store the parts, and give all parts.

    ``stored`` is False for the first time. The names of stored files are a row a file; the files that are new are told apart before
    any column is read from them.
    """
    spark, file = df.sparkSession, F.col("_metadata.file_path")
    if stored:
        known = {r["part"] for r in read_parts(spark, path).select("part").distinct().collect()}
        df = df.filter(~file.isin(sorted(known))) if known else df
    append_parts(profile_parts(df, file), path)
    return read_parts(spark, path)
