"""One row for each key: the first one in a fixed order, and how many rows the key has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], copies: str = "_copies") -> DataFrame:
    """``df`` with one row per key, the smallest by ``order`` (NULL first), and the number of rows that have the key.

    Rows are counted per key by a hash aggregate of the keys alone. Only keys with several rows need an order: their rows are cut to
    one a task before they meet, so a key with a third of all rows is a few rows; all others pass as they are. NULL keys are equal.
    """
    names = [f"_key_{i}" for i in range(len(keys))]
    many = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count(F.lit(1)).alias(copies)).filter(F.col(copies) > 1)
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    met = df.join(many, same, "left").drop(*names)
    alone = met.filter(F.col(copies).isNull()).withColumn(copies, F.lit(1).cast("bigint"))
    turn = Window.partitionBy(*keys).orderBy(*order)
    firsts = met.filter(F.col(copies).isNotNull()).withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") == 1).drop("_turn")
    return alone.unionByName(firsts)
