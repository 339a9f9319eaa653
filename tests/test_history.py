"""Histories of check runs."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import checks as CH

SCHEMA = "connection string, check_id string, run_id long, result_rows long"


def plain(rows):
    """The count before each run, by a walk through the sorted history."""
    out, last = [], {}
    for r in sorted(rows, key=lambda r: (r[0] or "", r[1] or "", r[2], -1 if r[3] is None else r[3])):
        out.append((*r, last.get(r[:2])))
        last[r[:2]] = r[3]
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_changes_against_a_walk(spark, ranges):
    """One check with most runs, checks of one run, NULL counts, repeated ids, checks whose ranges hold one run each."""
    rng = random.Random(ranges)
    rows = [("db", "hot", 10 * i, rng.choice([None, i])) for i in range(120)]
    rows += [("db", f"c{i}", rng.randrange(50), i) for i in range(30)] + [("db2", "hot", i, i * i) for i in range(5)] + [("db", "hot", 50, 7), ("db", "hot", 50, 7)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = CH.changes(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(((r.connection, r.check_id, r.run_id, r.result_rows, r.previous_rows) for r in got), key=str) == plain(rows)
    assert all(r.change == (None if None in (r.result_rows, r.previous_rows) else r.result_rows - r.previous_rows) for r in got)


def test_changes_of_nothing(spark):
    assert CH.changes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_check_with_a_million_runs_is_spread(spark):
    """Run ids as ``run_checks`` makes them: microseconds of the batch and the place in it."""
    first = int(dt.datetime(2026, 1, 1).timestamp() * 1_000_000)
    i = F.col("id")
    runs = spark.range(1_000_000).select(
        F.lit("db").alias("connection"), F.lit("hot").alias("check_id"), (F.lit(first) + i * 60_000_000 + i % 3).alias("run_id"), (i % 977).alias("result_rows"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        sizes = [r["count"] for r in CH.ranged(runs).groupBy("_range").count().collect()]
        whole = runs.withColumn("want", F.lag("result_rows").over(Window.partitionBy("check_id").orderBy("run_id")))
        wrong = CH.changes(runs).join(whole.select("run_id", "want"), "run_id").filter(~F.col("want").eqNullSafe(F.col("previous_rows")))
        assert wrong.count() == 0 and CH.changes(runs).count() == 1_000_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 16 and max(sizes) < 2 * 1_000_000 / 16
