"""Consistency rules between two tables, and orphans.

The target side is reduced to its distinct keys before the join, so a key that fills a
third of the target is one row; NULL keys never take part in a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import values as V
from plumbline.operators.filters import apply_filters, newest
from plumbline.sources.environment import Env

MUST_HAVE = "exists"
MUST_NOT_HAVE = "not exists"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _source(env: Env, spec: Mapping) -> DataFrame:
    """Filtered source rows: the newest n first, NULL keys removed afterwards."""
    src = spec["source"]
    df = apply_filters(env.table(src["table"]), src.get("filters"))
    if spec.get("sample"):
        df = newest(df, spec.get("source_pk") or env.keys.get(src["table"]) or src["key"], int(spec["sample"]))
    if spec.get("skip_empty_keys", True):
        df = df.filter(_c(src["key"]).isNotNull())
    return df


def _target_keys(env: Env, spec: Mapping, source: T.DataType) -> DataFrame:
    """Distinct target keys in the type in which they meet a source key."""
    tgt = spec["target"]
    rows = apply_filters(env.table(tgt["table"]), tgt.get("filters"))
    keys = rows.select(V.raw_key(_c(tgt["key"]), rows.schema[tgt["key"]].dataType, source).alias("_key"))
    return keys.filter(F.col("_key").isNotNull()).distinct()


def _met(rows: DataFrame, column: str, env: Env, spec: Mapping) -> Column:
    """A source key in the type in which it meets the target's; NULL where that type cannot hold it."""
    tgt = spec["target"]
    return V.raw_key(_c(column), rows.schema[column].dataType, env.table(tgt["table"]).schema[tgt["key"]].dataType)


def rule_failures(env: Env, spec: Mapping, limit: int | None = None) -> DataFrame:
    """Source rows that break the rule: without a target row, or with one when it must not exist."""
    src = spec["source"]
    rows = _source(env, spec)
    rows = rows.select(*[_c(c) for c in env.policy.safe(rows.columns)])
    tgt = spec["target"]
    keys = apply_filters(env.table(tgt["table"]), tgt.get("filters")).select(_c(tgt["key"]).alias("_key"))
    must_have = spec.get("expect", MUST_HAVE) != MUST_NOT_HAVE
    keyed = rows.filter(_c(src["key"]).isNotNull())
    how = "left_anti" if must_have else "left_semi"
    out = V.raw_join(keyed, src["key"], keys.filter(F.col("_key").isNotNull()).distinct(), "_key", how)
    if must_have and not spec.get("skip_empty_keys", True):
        # a NULL key has no target: it fails as it stands
        out = out.unionByName(rows.filter(_c(src["key"]).isNull()))
    return out.limit(limit) if limit is not None else out


def rule_verdict(env: Env, spec: Mapping) -> DataFrame:
    """checked, failed, passed, pass_rate: rows are counted per key on both sides, then joined."""
    key = spec["source"]["key"]
    rows = _source(env, spec)
    counts = rows.groupBy(_met(rows, key, env, spec).alias("_source_key")).agg(F.count(F.lit(1)).alias("n"))
    keys = _target_keys(env, spec, rows.schema[key].dataType)
    joined = counts.join(keys, F.col("_source_key") == F.col("_key"), "left")
    exists = F.col("_key").isNotNull()
    bad = ~exists if spec.get("expect", MUST_HAVE) != MUST_NOT_HAVE else exists
    totals = joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
        F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("failed"),
    )
    passed = F.col("checked") - F.col("failed")
    return totals.select(
        "checked", "failed", passed.alias("passed"),
        F.when(F.col("checked") > 0, F.round(passed * 100.0 / F.col("checked"), 2)).alias("pass_rate"),
    )


def orphan_counts(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Missing parent values with the rows that point to them."""
    counts = (
        child.filter(_c(child_column).isNotNull())
        .groupBy(_c(child_column).alias("missing_parent_value"))
        .agg(F.count(F.lit(1)).alias("child_rows"))
    )
    parents = parent.select(_c(parent_column).alias("_key")).distinct()
    return V.raw_join(counts, "missing_parent_value", parents, "_key", "left_anti")


def orphan_total(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    missing = orphan_counts(child, child_column, parent, parent_column)
    return missing.agg(F.coalesce(F.sum("child_rows"), F.lit(0)).alias("orphan_rows"))


def orphan_values(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str, limit: int | None = None) -> DataFrame:
    missing = orphan_counts(child, child_column, parent, parent_column).orderBy(F.desc("child_rows"), F.asc("missing_parent_value"))
    return missing if limit is None else missing.limit(limit)


def orphan_rows(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """The child rows themselves."""
    parents = parent.select(_c(parent_column).alias("_key")).distinct()
    return V.raw_join(child.filter(_c(child_column).isNotNull()), child_column, parents, "_key", "left_anti")


def as_check(spec: Mapping, name: str, limit: int | None = None) -> dict:
    """A rule as a check that expects no failing rows."""
    return {
        "id": spec.get("id", name),
        "title": name,
        "area": "Data consistency",
        "severity": "high",
        "expect": "empty",
        "run": lambda env: rule_failures(env, spec, limit),
    }
