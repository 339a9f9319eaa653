"""Snapshots of records: masked values plus one keyed fingerprint per field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import privacy as P
from plumbline.functions import values as V
from plumbline.functions.names import DEFAULT_POLICY, NamePolicy
from plumbline.operators.first_rows import first_per_key

DASH = "—"
NULL_TEXT = "NULL"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def snapshot(df: DataFrame, key_column: str, secret: bytes, policy: NamePolicy = DEFAULT_POLICY,
             digest_len: int = 32) -> DataFrame:
    """key_label, key_digest, fields (name to masked text) and digests (name to fingerprint), one row per record."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def text(c: str) -> Column:
        shown = V.plain_text(P.masked_column(c, _c(c), types[c], policy=policy), types[c])
        return F.coalesce(shown, F.lit(NULL_TEXT))

    fields = [x for c in df.columns for x in (F.lit(c), text(c))]
    digests = [
        x for c in policy.safe(df.columns) for x in (F.lit(c), P.fingerprint(_c(c), types[c], secret, digest_len))
    ]
    key = V.plain_text(_c(key_column), types[key_column])
    key_digest = F.substring(P.hmac_sha256(F.concat(F.lit('"'), key, F.lit('"')), secret), 1, digest_len)
    return df.filter(_c(key_column).isNotNull()).select(
        F.coalesce(P.masked_column(key_column, _c(key_column), types[key_column], policy=policy).cast("string"),
                   F.lit(NULL_TEXT)).alias("key_label"),
        key_digest.alias("key_digest"),
        F.create_map(*fields).alias("fields"),
        F.create_map(*digests).alias("digests"),
    )


def snapshot_diff(before: DataFrame, after: DataFrame, policy: NamePolicy = DEFAULT_POLICY,
                  only_changes: bool = False) -> DataFrame:
    """Per record and field: hidden, added, removed, changed or same, or the side that lacks the record.

    Each side is cut to one row per key digest, the first in a fixed order, and the sides are joined on it.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        # entries sorted by name can be ordered, maps cannot
        entries = df.select("key_digest", *[F.array_sort(F.map_entries(c)).alias(c) for c in ("digests", "fields")], "key_label")
        first = first_per_key(entries, ["key_digest"], ["digests", "fields", "key_label"])
        return first.select(F.col("key_digest").alias(f"{tag}_key"), F.struct("digests", "fields", "key_label").alias(tag))

    both = side(before, "b").join(side(after, "a"), F.col("b_key") == F.col("a_key"), "full_outer").withColumn(
        "key_digest", F.coalesce("b_key", "a_key"))

    def as_map(entries: str) -> Column:
        return F.map_from_entries(F.coalesce(F.col(entries), F.array().cast("array<struct<key:string,value:string>>")))

    out = both.select(
        F.coalesce("a.key_label", "b.key_label").alias("key_label"), "key_digest",
        F.col("b").isNull().alias("no_before"), F.col("a").isNull().alias("no_after"),
        as_map("b.fields").alias("bf"), as_map("a.fields").alias("af"),
        as_map("b.digests").alias("bd"), as_map("a.digests").alias("ad"),
    )
    out = out.select(
        "*", F.explode(F.array_union(F.map_keys("bf"), F.map_keys("af"))).alias("field")
    )
    b, a = F.col("bf")[F.col("field")], F.col("af")[F.col("field")]
    change = (
        F.when(F.col("no_before"), "missing on the left")
        .when(F.col("no_after"), "missing on the right")
        .when(policy.secret_flag(F.col("field")), "hidden")
        .when(b.isNull(), "added")
        .when(a.isNull(), "removed")
        .when(~F.col("bd")[F.col("field")].eqNullSafe(F.col("ad")[F.col("field")]), "changed")
        .otherwise("same")
    )
    out = out.select(
        "key_label", "key_digest", "field", F.coalesce(b, F.lit(DASH)).alias("before"),
        F.coalesce(a, F.lit(DASH)).alias("after"), change.alias("change"),
    )
    return out.filter(F.col("change") != "same") if only_changes else out


def record_diff(a: DataFrame, b: DataFrame, key_column: str, keys: Sequence, secret: bytes,
                policy: NamePolicy = DEFAULT_POLICY) -> DataFrame:
    """The same records in two environments, field by field."""
    wanted = _c(key_column).isin(list(keys))
    return snapshot_diff(
        snapshot(a.filter(wanted), key_column, secret, policy), snapshot(b.filter(wanted), key_column, secret, policy), policy
    )


def linked_count_changes(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("key", "tbl", "col")) -> DataFrame:
    """Linked counts (keys, matches) that differ; the difference is NULL when one side has none."""
    stacked = before.select(*keys, F.col("matches").alias("before"), F.lit(None).cast("bigint").alias("after")).unionByName(
        after.select(*keys, F.lit(None).cast("bigint").alias("before"), F.col("matches").alias("after"))
    )
    both = stacked.groupBy(*keys).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    return both.filter(~F.col("before").eqNullSafe(F.col("after"))).withColumn(
        "difference", F.col("after") - F.col("before")
    )


def masked_evidence(df: DataFrame, rows: int = 25, policy: NamePolicy = DEFAULT_POLICY) -> tuple[DataFrame, DataFrame]:
    """(first rows, masked and as text; exact number of rows)."""
    shown = P.mask(df, policy=policy)
    shown = shown.select(*[F.coalesce(_c(c).cast("string"), F.lit("None")).alias(c) for c in shown.columns])
    return shown.limit(rows), df.agg(F.count(F.lit(1)).alias("total_rows"))
