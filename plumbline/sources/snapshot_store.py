"""Snapshots in storage, with a tree of digests over their records.

Records lie in buckets by the first digits of their key digest, a folder each. Every bucket has a digest (the record hashes added
up, so neither order nor files matter), and so has every shorter prefix, up to the empty one that stands for the whole snapshot.
Two snapshots are compared from that root down: only below nodes that differ the next level is read, and only buckets that differ
are read at all.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.names import DEFAULT_POLICY, NamePolicy
from plumbline.operators.snapshots import snapshot_diff

#: hexadecimal digits of a bucket: 256 buckets
DIGITS = 2
_RECORDS = "key_label string, key_digest string, fields map<string,string>, digests map<string,string>, bucket string"
_NODES = "level int, prefix string, records bigint, first decimal(38,0), second decimal(38,0)"
_HEX = "0123456789abcdef"


def _place(path: str, label: str) -> str:
    return f"{path.rstrip('/')}/{quote(label, safe='')}"


def _record_hash(seed: int) -> Column:
    """Of what a comparison looks at: the key, the fields' fingerprints, the names of all fields."""
    entries = F.array_sort(F.map_entries("digests"))
    return F.xxhash64(F.lit(seed), "key_digest", entries, F.array_sort(F.map_keys("fields"))).cast("decimal(38,0)")


def save_snapshot(snapshot: DataFrame, path: str, label: str, digits: int = DIGITS) -> None:
    """Write a snapshot under its label; several labels live side by side, and a label that is there already is an error.

    The tree is made of the records as they are stored, so a snapshot frame is evaluated once.
    """
    place = _place(path, label)
    bucketed = snapshot.withColumn("bucket", F.substring("key_digest", 1, digits))
    # a bucket per file, or several where it is larger than a task should write
    bucketed.hint("rebalance", "bucket").write.mode("error").partitionBy("bucket").parquet(f"{place}/records")
    leaves = _records(snapshot.sparkSession, place).groupBy(F.col("bucket").alias("prefix")).agg(
        F.count(F.lit(1)).alias("records"), F.sum(_record_hash(1)).alias("first"), F.sum(_record_hash(2)).alias("second"))
    levels = F.explode(F.sequence(F.lit(0), F.lit(digits)))
    nodes = (
        leaves.withColumn("level", levels).withColumn("prefix", F.expr("substring(prefix, 1, level)"))
        .groupBy("level", "prefix").agg(F.sum("records").alias("records"), F.sum("first").alias("first"), F.sum("second").alias("second"))
    )
    nodes.coalesce(1).write.mode("error").partitionBy("level").parquet(f"{place}/nodes")


def _records(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.schema(_RECORDS).parquet(f"{place}/records")


def read_snapshot(spark: SparkSession, path: str, label: str) -> DataFrame:
    return _records(spark, _place(path, label)).drop("bucket")


def _nodes(spark: SparkSession, path: str, label: str) -> DataFrame:
    return spark.read.schema(_NODES).parquet(f"{_place(path, label)}/nodes")


def changed_buckets(spark: SparkSession, path: str, before: str, after: str) -> list[str]:
    """The buckets in which two snapshots of one folder differ, sorted. At most 16 ** digits short texts come to the driver."""
    sides = [_nodes(spark, path, label) for label in (before, after)]
    depths = [s.agg(F.max("level")).first()[0] for s in sides]
    if depths[0] != depths[1] and None not in depths:
        raise ValueError("the snapshots have buckets of different sizes")
    depth, open_nodes = max((d for d in depths if d is not None), default=0), [""]
    for level in range(depth + 1):
        # a side's children of the nodes that differ: one level is one folder, and the prefixes are pushed to the files
        a, b = (s.filter((F.col("level") == level) & F.col("prefix").isin(open_nodes)).drop("level") for s in sides)
        differs = a.exceptAll(b).select("prefix").union(b.exceptAll(a).select("prefix")).distinct()
        found = sorted(r["prefix"] for r in differs.collect())
        if not found or level == depth:
            return found if depth else []
        open_nodes = [p + x for p in found for x in _HEX]
    return []


def saved_snapshot_diff(spark: SparkSession, path: str, before: str, after: str, policy: NamePolicy = DEFAULT_POLICY) -> DataFrame:
    """What ``snapshot_diff`` finds between two saved snapshots, without fields that are the same or hidden.

    Records of equal buckets are not read; they have not changed.
    """
    buckets = changed_buckets(spark, path, before, after)
    sides = [
        _records(spark, _place(path, label)).filter(F.col("bucket").isin(buckets) if buckets else F.lit(False)).drop("bucket")
        for label in (before, after)]
    return snapshot_diff(*sides, policy=policy).filter(~F.col("change").isin("same", "hidden"))
