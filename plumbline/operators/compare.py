"""Compare two tables, two results, two environments, two catalogs.

Where both sides are matched by key, one side (or both) is first reduced to one row per
key by an aggregation, so copies of a key are combined before the shuffle and never meet
in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import privacy as P
from plumbline.functions import values as V
from plumbline.functions.names import DEFAULT_POLICY, NamePolicy
from plumbline.operators.filters import apply_filters, newest
from plumbline.operators.first_rows import first_per_key
from plumbline.sources.catalog import local_frame, table_counts
from plumbline.sources.environment import Env

# Kinds of schema differences and the order of row-count statuses.
DIFFERENCE_KINDS = [
    "Missing table", "Extra table", "Missing column", "Extra column", "Type differs", "Nullable differs",
    "Index differs", "Default differs", "Foreign key missing", "Foreign key extra",
]
COUNT_STATUSES = ["missing in B", "missing in A", "could not count", "different", "same"]
DASH = "—"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# ---------------------------------------------------------------- two tables
def _matched(source: DataFrame, target: DataFrame, spec: Mapping, opt: V.Options) -> tuple[DataFrame, list]:
    """Source rows with the first target row of their key and the number of target rows.

    Returns the joined frame and per field (label, differs, source text, target text).
    """
    skey, tkey = spec["source"]["key"], spec["target"]["key"]
    stypes = {f.name: f.dataType for f in source.schema.fields}
    ttypes = {f.name: f.dataType for f in target.schema.fields}
    sk, tk = V.key_pair(_c(skey), stypes[skey], _c(tkey), ttypes[tkey], opt)
    fields = spec["fields"]
    scols = list(dict.fromkeys([skey] + [f["source"] for f in fields if f["source"] in stypes]))
    tcols = list(dict.fromkeys([tkey] + [f["target"] for f in fields if f["target"] in ttypes]))
    left = source.filter(_c(skey).isNotNull()).select(
        sk.alias("_sk"), *[_c(c).alias(f"s_{i}") for i, c in enumerate(scols)]
    )
    # first target row = smallest in column order; a total order, so the same on every run
    right = target.select(tk.alias("_tk"), *[_c(c).alias(f"t_{i}") for i, c in enumerate(tcols)]).filter(F.col("_tk").isNotNull())
    right = first_per_key(right, ["_tk"], [V.orderable(F.col(f"t_{i}"), ttypes[c]) for i, c in enumerate(tcols)])
    joined = left.join(right, F.col("_sk") == F.col("_tk"), "left")
    compared = []
    for f in fields:
        s = F.col(f"s_{scols.index(f['source'])}") if f["source"] in stypes else None
        t = F.col(f"t_{tcols.index(f['target'])}") if f["target"] in ttypes else None
        st, tt = stypes.get(f["source"]), ttypes.get(f["target"])
        if s is not None and t is not None:
            differs = ~V.same(s, st, t, tt, opt)
        else:  # a column that is not there equals only another missing column
            differs = F.lit((s is None) != (t is None))
        shown_s = V.display(s, st) if s is not None else F.lit(V.NOT_PRESENT)
        shown_t = V.display(t, tt) if t is not None else F.lit(V.NOT_PRESENT)
        compared.append((f"{f['source']} ↔ {f['target']}", differs, shown_s, shown_t))
    return joined, compared


def _sides(env_a: Env, env_b: Env, spec: Mapping, sample_newest: int | None) -> tuple[DataFrame, DataFrame]:
    src, tgt = spec["source"], spec["target"]
    source = apply_filters(env_a.table(src["table"]), src.get("filters"))
    if sample_newest is not None:
        source = newest(source.filter(_c(src["key"]).isNotNull()), src["key"], sample_newest)
    return source, apply_filters(env_b.table(tgt["table"]), tgt.get("filters"))


def compare_tables(env_a: Env, env_b: Env, spec: Mapping, opt: V.Options = V.DEFAULT,
                   sample_newest: int | None = None) -> DataFrame:
    """Details: key, status, field, source_value, target_value."""
    source, target = _sides(env_a, env_b, spec, sample_newest)
    joined, compared = _matched(source, target, spec, opt)
    found = F.col("_copies").isNotNull()

    def line(status: str, field: str, s: Column, t: Column) -> Column:
        return F.struct(
            F.lit(status).alias("status"), F.lit(field).alias("field"), s.alias("source_value"), t.alias("target_value")
        )

    empty = F.lit("")
    copies = F.concat(F.col("_copies").cast("string"), F.lit(" rows"))
    lines = [
        F.when(~found, line("Missing in target", "", empty, empty)),
        F.when(F.col("_copies") > 1, line("Duplicate in target", spec["target"]["key"], empty, copies)),
    ]
    lines += [F.when(found & differs, line("Mismatch", label, s, t)) for label, differs, s, t in compared]
    key = F.col("s_0").cast("string").alias("key")
    return joined.select(key, F.inline(F.array_compact(F.array(*lines))))


def compare_summary(env_a: Env, env_b: Env, spec: Mapping, opt: V.Options = V.DEFAULT,
                    sample_newest: int | None = None) -> DataFrame:
    """One row of counts; compared = matching + mismatched + missing_in_target."""
    source, target = _sides(env_a, env_b, spec, sample_newest)
    joined, compared = _matched(source, target, spec, opt)
    found = F.col("_copies").isNotNull()
    bad = F.lit(False)
    for _, differs, _, _ in compared:
        bad = bad | differs
    return joined.select(found.alias("found"), bad.alias("bad"), "_copies").agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(F.col("found") & ~F.col("bad")).alias("matching"),
        F.count_if(F.col("found") & F.col("bad")).alias("mismatched"),
        F.count_if(~F.col("found")).alias("missing_in_target"),
        F.count_if(F.col("_copies") > 1).alias("duplicate_in_target"),
    )


def full_summary(env_a: Env, env_b: Env, spec: Mapping, opt: V.Options = V.DEFAULT, sample_newest: int | None = None) -> DataFrame:
    """``compare_summary`` with missing_in_source: a scalar subquery over the target keys without a source row."""
    missing = missing_in_source(env_a, env_b, spec).agg(F.count(F.lit(1)).alias("n"))
    return compare_summary(env_a, env_b, spec, opt, sample_newest).withColumn("missing_in_source", missing.scalar())


def missing_in_source(env_a: Env, env_b: Env, spec: Mapping, reverse_uses_filters: bool = False,
                      limit: int | None = None) -> DataFrame:
    """Target keys (one line per target row) without a source row; source filters do not apply by default."""
    src, tgt = spec["source"], spec["target"]
    source = env_a.table(src["table"])
    if reverse_uses_filters:
        source = apply_filters(source, src.get("filters"))
    target = apply_filters(env_b.table(tgt["table"]), tgt.get("filters"))
    keys = source.select(_c(src["key"]).alias("_key")).distinct()
    wanted = target.select(_c(tgt["key"]).alias("target_key")).filter(F.col("target_key").isNotNull())
    out = V.raw_join(wanted, "target_key", keys, "_key", "left_anti")
    return out.orderBy(F.desc("target_key")).limit(limit) if limit is not None else out


def mask_compared(details: DataFrame, show_personal: bool = False, policy: NamePolicy = DEFAULT_POLICY) -> DataFrame:
    """Details safe to show: either side of the field name decides."""
    sides = F.split(F.col("field"), " ↔ ")
    first, second = F.get(sides, 0), F.coalesce(F.get(sides, 1), F.lit(""))
    secret = policy.secret_flag(first) | policy.secret_flag(second)

    def shown(value: Column) -> Column:
        visible = P.masked_by_field(value, F.col("field"), show_personal, policy)
        return F.when(secret, F.lit(P.HIDDEN)).otherwise(visible)

    return details.withColumn("source_value", shown(F.col("source_value"))).withColumn(
        "target_value", shown(F.col("target_value"))
    )


def suggest_fields(columns: DataFrame, source: str, target: str, skip: Sequence[str] = (), policy: NamePolicy = DEFAULT_POLICY,
                   limit: int | None = None, alike: DataFrame | None = None, likeness: float = 0.5) -> DataFrame:
    """Columns of the same name on both sides, in source order, without keys and bookkeeping columns.

    With ``alike`` (``inclusion.matching_fields``: source, target, likeness) columns of one name must share a value, and a source
    column without a namesake gets the free target column whose values are most like its own, from ``likeness`` on. Of several source
    columns that are most like one target, the likest takes it; then the first one.
    """
    ignored = list(dict.fromkeys([*skip, "id", "created", "updated", "created_at", "updated_at"]))
    safe = columns.filter(~policy.secret_flag(F.col("col")) & ~F.col("col").isin(ignored))
    s = safe.filter(F.col("tbl") == source).select(F.col("col").alias("source"), "pos")
    t = safe.filter(F.col("tbl") == target).select(F.col("col").alias("target"))
    out = s.join(t, F.col("source") == F.col("target"))
    if alike is not None:
        pairs = alike.select("source", "target", "likeness").join(s, "source").join(t, "target")
        out = out.join(pairs.filter("source = target").select("source"), "source", "left_semi")
        namesakes = out.select("source")
        free = pairs.filter(F.col("likeness") >= likeness).join(namesakes, "source", "left_anti").join(
            namesakes.withColumnRenamed("source", "target"), "target", "left_anti")
        best = Window.partitionBy("source").orderBy(F.desc("likeness"), "target")
        taken = Window.partitionBy("target").orderBy(F.desc("likeness"), "pos")
        renamed = free.withColumn("_n", F.row_number().over(best)).filter("_n = 1").withColumn("_n", F.row_number().over(taken)).filter("_n = 1")
        out = out.select("source", "target", "pos").unionByName(renamed.select("source", "target", "pos"))
    out = out.orderBy("pos").select("source", "target", "pos")
    return out.limit(limit) if limit is not None else out


# ---------------------------------------------------------------- two results
@dataclass(frozen=True)
class ResultComparison:
    summary: DataFrame
    only_a: DataFrame
    only_b: DataFrame
    different: DataFrame


def _key_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row per key text: rows on each side. Both sides are stacked and counted together, so there is no join to skew."""

    def side(df: DataFrame, is_a: bool) -> DataFrame:
        text = V.plain_text(_c(key), df.schema[key].dataType)
        return df.select(text.alias("_key"), F.lit(int(is_a)).alias("_a"), F.lit(int(not is_a)).alias("_b"))

    return side(a, True).unionAll(side(b, False)).groupBy("_key").agg(F.sum("_a").alias("rows_a"), F.sum("_b").alias("rows_b"))


def _paired(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The keys that both sides have, with the first row of each side as texts a_0, a_1, ... and b_0, ..."""

    def side(df: DataFrame, tag: str) -> DataFrame:
        types = {f.name: f.dataType for f in df.schema.fields}
        cells = [V.plain_text(_c(c), types[c]).alias(f"{tag}_{i}") for i, c in enumerate(fields)]
        rows = df.select(V.plain_text(_c(key), types[key]).alias(f"{tag}_key"), *cells)
        return first_per_key(rows, [f"{tag}_key"], [f"{tag}_{i}" for i in range(len(fields))])

    return side(a, "a").drop("_copies").join(side(b, "b").drop("_copies"), F.col("a_key").eqNullSafe(F.col("b_key")))


def compare_results(a: DataFrame, b: DataFrame, key: str, ignore: Sequence[str] = (),
                    policy: NamePolicy = DEFAULT_POLICY, show_personal: bool = False) -> ResultComparison:
    """Two results matched on a key as text (NULL keys match each other); values compare as text."""
    shared = [c for c in a.columns if c in b.columns and c not in ignore]
    if key not in shared:
        raise ValueError(f"{key!r} is not a column of both results")
    fields = [c for c in shared if c != key and not policy.is_secret(c)]
    per_key = _key_counts(a, b, key)
    both = (F.col("rows_a") > 0) & (F.col("rows_b") > 0)
    summary = per_key.agg(
        F.coalesce(F.sum("rows_a"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum("rows_b"), F.lit(0)).alias("rows_b"),
        F.count_if(both).alias("shared_keys"),
        F.coalesce(F.sum(F.greatest(F.col("rows_a") - 1, F.lit(0))), F.lit(0)).alias("duplicate_keys_a"),
        F.coalesce(F.sum(F.greatest(F.col("rows_b") - 1, F.lit(0))), F.lit(0)).alias("duplicate_keys_b"),
    ).select(
        "*",
        F.lit(", ".join(c for c in a.columns if c not in b.columns)).alias("columns_only_a"),
        F.lit(", ".join(c for c in b.columns if c not in a.columns)).alias("columns_only_b"),
    )
    lines = []
    for i, c in enumerate(fields):
        va, vb = F.col(f"a_{i}"), F.col(f"b_{i}")

        def shown(v: Column) -> Column:
            if not show_personal:
                v = P.hide_emails(P.hide_phone(v) if policy.is_personal(c) else v)
            return F.coalesce(v, F.lit("None"))

        lines.append(
            F.when(~va.eqNullSafe(vb), F.struct(F.lit(c).alias("field"), shown(va).alias("in_a"), shown(vb).alias("in_b")))
        )
    different = _paired(a, b, key, fields).select(
        F.coalesce("a_key", F.lit("None")).alias("key"), F.inline(F.array_compact(F.array(*lines)))
    )

    def only(mine: DataFrame, other: DataFrame) -> DataFrame:
        keys = other.select(V.plain_text(_c(key), other.schema[key].dataType).alias("_key")).distinct()
        rows = mine.join(keys, V.plain_text(_c(key), mine.schema[key].dataType).eqNullSafe(F.col("_key")), "left_anti")
        return P.mask(rows, show_personal, policy)

    return ResultComparison(summary, only(a, b), only(b, a), different)


def key_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct key texts only in A, only in B and in both, counted."""
    per_key = _key_counts(a, b, key)
    where = F.when(F.col("rows_b") == 0, "only A").when(F.col("rows_a") == 0, "only B").otherwise("both")
    return per_key.groupBy(where.alias("found")).agg(F.count(F.lit(1)).alias("keys"))


# ---------------------------------------------------------------- row counts
def count_diff(env_a: Env, env_b: Env) -> DataFrame:
    """Exact rows per table on both sides, worst first."""
    a = table_counts(env_a).select("tbl", F.col("rows").alias("rows_a"))
    b = table_counts(env_b).select(F.col("tbl").alias("tbl_b"), F.col("rows").alias("rows_b"))
    both = a.join(b, F.col("tbl") == F.col("tbl_b"), "full_outer")
    status = (
        F.when(F.col("rows_a").isNull() & F.col("rows_b").isNull(), "could not count")
        .when(F.col("rows_a").isNull(), "missing in A")
        .when(F.col("rows_b").isNull(), "missing in B")
        .when(F.col("rows_a") == F.col("rows_b"), "same")
        .otherwise("different")
    )
    difference = F.col("rows_b") - F.col("rows_a")
    order = F.array_position(F.array(*[F.lit(s) for s in COUNT_STATUSES]), F.col("status"))
    return (
        both.select(
            F.coalesce("tbl", "tbl_b").alias("table"), "rows_a", "rows_b", difference.alias("difference"),
            F.when(F.col("rows_a") != 0, F.round(difference * 100.0 / F.col("rows_a"), 1)).alias("change_pct"),
            status.alias("status"),
        )
        .orderBy(order, "table")
    )


def row_count_drift(counts_a: DataFrame, counts_b: DataFrame, min_rows: int = 1000, min_ratio: float = 0.5) -> DataFrame:
    """Shared tables whose sizes differ a lot."""
    a = counts_a.select("tbl", F.col("rows").alias("left_rows"))
    b = counts_b.select("tbl", F.col("rows").alias("right_rows"))
    big = F.greatest("left_rows", "right_rows")
    gap = F.abs(F.col("left_rows") - F.col("right_rows"))
    return (
        a.join(b, "tbl")
        .filter((big >= min_rows) & (gap / big >= min_ratio))
        .select("tbl", "left_rows", "right_rows", (F.col("right_rows") - F.col("left_rows")).alias("difference"))
    )


# ---------------------------------------------------------------- catalogs
def _norm(col: Column) -> Column:
    text = F.coalesce(col.cast("string"), F.lit(""))
    return F.when(text.isin("None", "nan", "NaN"), "").otherwise(text)


def _line(kind: str, table: Column, column: Column, left: Column, right: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("difference"), table.alias("table"), column.alias("column"),
        left.alias("left"), right.alias("right"),
    )


def schema_diff(columns_a: DataFrame, columns_b: DataFrame, links_a: DataFrame | None = None,
                links_b: DataFrame | None = None) -> DataFrame:
    """Differences of two catalogs (tbl, col, type, nullable, key, default): "Missing" is on the left only."""
    fields = ["type", "nullable", "key", "default"]
    dash, blank = F.lit(DASH), F.lit("")
    ta = columns_a.select(F.col("tbl").alias("ta")).distinct()
    tb = columns_b.select(F.col("tbl").alias("tb")).distinct()
    tables = ta.join(tb, F.col("ta") == F.col("tb"), "full_outer")
    table_rows = tables.select(
        F.inline(F.array_compact(F.array(
            F.when(F.col("tb").isNull(), _line("Missing table", F.col("ta"), blank, F.lit("exists"), dash)),
            F.when(F.col("ta").isNull(), _line("Extra table", F.col("tb"), blank, dash, F.lit("exists"))),
        )))
    )
    shared = tables.filter(F.col("ta") == F.col("tb")).select(F.col("ta").alias("tbl"))
    a = columns_a.join(shared, "tbl", "left_semi").select(
        F.col("tbl").alias("ta"), F.col("col").alias("ca"), *[F.col(f).alias(f"a_{f}") for f in fields]
    )
    b = columns_b.join(shared, "tbl", "left_semi").select(
        F.col("tbl").alias("tb"), F.col("col").alias("cb"), *[F.col(f).alias(f"b_{f}") for f in fields]
    )
    cols = a.join(b, (F.col("ta") == F.col("tb")) & (F.col("ca") == F.col("cb")), "full_outer")
    lines = [
        F.when(F.col("cb").isNull(), _line("Missing column", F.col("ta"), F.col("ca"), F.col("a_type"), dash)),
        F.when(F.col("ca").isNull(), _line("Extra column", F.col("tb"), F.col("cb"), dash, F.col("b_type"))),
    ]
    in_both = F.col("ca").isNotNull() & F.col("cb").isNotNull()
    kinds = dict(zip(fields, ["Type differs", "Nullable differs", "Index differs", "Default differs"]))
    for f in fields:
        left, right = _norm(F.col(f"a_{f}")), _norm(F.col(f"b_{f}"))
        shown = [F.when(v == "", dash).otherwise(v) for v in (left, right)]
        lines.append(F.when(in_both & (left != right), _line(kinds[f], F.col("ta"), F.col("ca"), *shown)))
    out = table_rows.unionByName(cols.select(F.inline(F.array_compact(F.array(*lines)))))
    if links_a is not None and links_b is not None:
        names = ["tbl", "col", "ref_tbl", "ref_col"]
        target = F.concat(F.lit("→ "), F.col("ref_tbl"), F.lit("."), F.col("ref_col"))
        la = links_a.select(*names).distinct().join(shared, "tbl", "left_semi")
        lb = links_b.select(*names).distinct().join(shared, "tbl", "left_semi")
        gone = la.join(lb, names, "left_anti").select(
            F.inline(F.array(_line("Foreign key missing", F.col("tbl"), F.col("col"), target, dash))))
        new = lb.join(la, names, "left_anti").select(
            F.inline(F.array(_line("Foreign key extra", F.col("tbl"), F.col("col"), dash, target))))
        out = out.unionByName(gone).unionByName(new)
    return out


def filter_differences(diff: DataFrame, kinds: Sequence[str] = (), text: str = "") -> DataFrame:
    """Differences of some kinds whose table or column holds a text, in any letter case."""
    out = diff.filter(F.col("difference").isin(list(kinds))) if kinds else diff
    if text:
        named = F.lower(F.concat_ws(".", "table", "column"))
        out = out.filter(named.contains(text.lower()))
    return out


def difference_counts(diff: DataFrame) -> DataFrame:
    """Differences per kind, every kind listed."""
    kinds = local_frame(diff.sparkSession, [(k,) for k in DIFFERENCE_KINDS], "difference string")
    counts = diff.groupBy("difference").agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(counts, "difference", "left").select("difference", F.coalesce("n", F.lit(0)).alias("rows"))
