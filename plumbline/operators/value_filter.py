"""A test for membership in a frame of values that travels with a scan: most rows without a match stop there, before any shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bits a value gets, and the most there are (8 MB); with more values the test lets more others pass, never fewer matches
BITS_A_VALUE, MOST_BITS = 10, 1 << 26
#: hashes a value sets
PROBES = 3


def _places(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), value), F.lit(bits)) for seed in range(PROBES)]


def value_filter(values: DataFrame, column: str = "value", expected: int | None = None) -> Callable[[Column], Column]:
    """A condition on text columns: true for every value of the frame, and for a few per cent of the others.

    The bits are set by an aggregate and read as one array, a scalar subquery of the plan that uses the condition. There are as many as
    ``expected`` values need; without it the values are counted, which is a job. Put the exact semi join behind it.
    """
    expected = values.count() if expected is None else expected
    bits = min(MOST_BITS, 1 << max(6, (expected * BITS_A_VALUE - 1).bit_length()))
    value = F.col(f"`{column}`")
    set_bits = values.filter(value.isNotNull()).select(F.explode(F.array(*_places(value, bits))).alias("at")).select(
        F.floor(F.col("at") / 64).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % 64).cast("int")).alias("bits"))
    no_bits = values.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = set_bits.unionAll(no_bits).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("held")).scalar()

    def passes(cell: Column) -> Column:
        found = None
        for at in _places(cell, bits):
            bit = F.call_function("getbit", F.get(held, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1
            found = bit if found is None else found & bit
        return found

    return passes
