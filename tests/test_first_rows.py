"""First rows per key, and snapshots in storage."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import snapshots as SN
from plumbline.operators.first_rows import first_per_key
from plumbline.sources import snapshot_store as SS


def test_first_rows_against_a_walk(spark):
    rng = random.Random(2)
    rows = [("hot", rng.choice([None, "b", "a", "ä"]), rng.choice([None, 1.5, -2.0])) for _ in range(400)]
    rows += [(f"k{i}", "x", float(i)) for i in range(30)] + [(None, "z", 1.0), (None, "y", None), ("twice", None, None), ("twice", None, None)]
    rng.shuffle(rows)
    got = first_per_key(spark.createDataFrame(rows, "k string, a string, b double").repartition(5), ["k"], ["a", "b"]).collect()
    want = {}
    nulls_first = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    for k, a, b in rows:
        want.setdefault(k, []).append((a, b))
    firsts = [(k, *min(v, key=lambda r: [nulls_first(x) for x in r]), len(v)) for k, v in want.items()]
    assert sorted((tuple(r) for r in got), key=str) == sorted(firsts, key=str)


def test_rows_of_a_hot_key_are_cut_before_they_meet(spark):
    df = spark.range(1000).select(F.when(F.col("id") >= 0, "hot").alias("k"), "id").repartition(4)
    text = first_per_key(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "WindowGroupLimit" in text and "Partial" in text
    assert [tuple(r) for r in first_per_key(df, ["k"], ["id"]).collect()] == [("hot", 0, 1000)]


def people(spark, change=lambda i, v: v, skip=(), n=600):
    rows = [(i, change(i, f"name {i}"), f"m{i}@x.org", f"pw{i}") for i in range(n) if i not in skip]
    return SN.snapshot(spark.createDataFrame(rows, "id long, name string, email string, password string"), "id", b"key")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "snapshots")


def lines(df):
    return sorted(tuple(r) for r in df.select("key_label", "field", "change").collect())


def test_saved_snapshots_come_back(spark, folder):
    snapshot = people(spark)
    SS.save_snapshot(snapshot, folder, "before / after: 1")
    back = SS.read_snapshot(spark, folder, "before / after: 1")
    entries = lambda df: sorted((r.key_label, r.key_digest, sorted(r.fields.items()), sorted(r.digests.items())) for r in df.collect())
    assert back.columns == snapshot.columns and entries(back) == entries(snapshot)
    with pytest.raises(Exception, match="(?i)exists"):
        SS.save_snapshot(snapshot, folder, "before / after: 1")


def test_only_buckets_that_differ_are_read(spark, folder):
    before, after = people(spark), people(spark, lambda i, v: v + "!" if i in (7, 8) else v, skip=(9,))
    SS.save_snapshot(before, folder, "a", digits=1)
    SS.save_snapshot(after.repartition(3), folder, "b", digits=1)
    buckets = SS.changed_buckets(spark, folder, "a", "b")
    keys = {r.key_label: r.key_digest[:1] for r in before.collect()}
    assert buckets == sorted({keys[k] for k in ("7", "8", "9")})
    diff = SS.saved_snapshot_diff(spark, folder, "a", "b")
    want = [x for x in lines(SN.snapshot_diff(before, after)) if x[2] not in ("same", "hidden")]
    assert lines(diff) == want and len(want) == 2 + 4
    text = diff._jdf.queryExecution().executedPlan().toString()
    assert text.count("PartitionFilters: [bucket") >= 2
    # a bucket is a folder: without those that are equal the comparison still works
    for path in glob.glob(f"{folder}/*/records/bucket=*"):
        if path[-1:] not in buckets:
            os.rename(path, path.replace("records/bucket=", "records/_unread-"))
    assert lines(SS.saved_snapshot_diff(spark, folder, "a", "b")) == want


def test_equal_snapshots_read_no_records(spark, folder):
    SS.save_snapshot(people(spark), folder, "a", digits=1)
    SS.save_snapshot(people(spark).repartition(7), folder, "b", digits=1)
    assert SS.changed_buckets(spark, folder, "a", "b") == [] and SS.saved_snapshot_diff(spark, folder, "a", "b").collect() == []


@pytest.mark.parametrize("sizes", [(0, 0), (0, 40), (40, 0)])
def test_empty_snapshots(spark, folder, sizes):
    sides = [people(spark, n=n) if n else people(spark, n=1).limit(0) for n in sizes]
    for side, label in zip(sides, "ab"):
        SS.save_snapshot(side, folder, label, digits=1)
    assert lines(SS.saved_snapshot_diff(spark, folder, "a", "b")) == lines(SN.snapshot_diff(*sides))
