"""JSON documents against rules, tables and expected values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import documents as D
from plumbline.functions import privacy as P
from plumbline.functions import values as V
from plumbline.functions.names import DEFAULT_POLICY, NamePolicy
from plumbline.operators.first_rows import first_per_key

VERDICTS = ["Match", "Mismatch", "Missing in API", "Missing in DB"]


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def check_rules(df: DataFrame, doc: str, rules: Sequence[D.Rule], opt: V.Options = V.DEFAULT,
                status_code: str | None = None) -> DataFrame:
    """One row per document and rule: the frame's other columns, rule number, path, operator, status, detail.

    Each path is read, typed and normalised once per document, however many rules it has.
    """
    code = _c(status_code) if status_code else None
    keep = [_c(c) for c in df.columns if c != doc]
    is_object = None
    if code is not None:
        df, is_object = df.withColumn("_object", V.json_type(_c(doc)) == "object"), F.col("_object")
    by_path: dict[str, list[tuple[int, D.Rule]]] = {}
    for i, r in enumerate(rules, start=1):
        by_path.setdefault(r.path, []).append((i, r))
    cells = [
        F.struct(F.lit(n).alias("_n"), F.lit(p).alias("path"), D.with_status(_c(doc), p, code, is_object).alias("_v"))
        for n, p in enumerate(by_path)
    ]
    # every step is a projection over columns of the one before: read a path, type it, normalise it, judge its rules
    read = df.select(*keep, F.inline(F.array(*cells)))
    typed = read.select("*", V.json_type(F.col("_v")).alias("_kind"), V.json_text(F.col("_v")).alias("_text"))
    plain = V.JsonValue(F.col("_v"), F.col("_kind"), F.col("_text"))
    compared = [n for n, of_path in enumerate(by_path.values()) if any(r.operator in ("equals", "not equals") for _, r in of_path)]
    form = F.when(F.col("_n").isin(compared), V.json_form(plain, opt, True)) if compared else F.lit(None).cast("string")
    # list look-ups are columns of their own: a lambda inside the generator would take it out of generated code
    look_ups = {
        i: F.when((F.col("_n") == n) & (F.col("_kind") == "list"), D.list_holds(plain, r.expected, opt))
        for n, of_path in enumerate(by_path.values()) for i, r in of_path if r.operator == "contains"
    }
    formed = typed.select("*", form.alias("_form"), *[c.alias(f"_in_{i}") for i, c in look_ups.items()])
    value = V.JsonValue(F.col("_v"), F.col("_kind"), F.col("_text"), form=F.col("_form"))
    judged = F.lit(None)
    for n, of_path in enumerate(by_path.values()):
        lines = F.array(*[
            F.struct(F.lit(i).alias("rule"), F.lit(r.operator).alias("operator"), F.lit(r.expected).alias("_expected"),
                     D.rule_holds(value, r, opt, F.col(f"_in_{i}") if i in look_ups else None).alias("_holds"))
            for i, r in of_path
        ])
        judged = F.when(F.col("_n") == n, lines) if n == 0 else judged.when(F.col("_n") == n, lines)
    out = formed.select(*keep, "path", "_v", "_kind", "_text", F.inline(judged))
    detail = D.rule_detail(plain, F.col("operator"), F.col("_expected"), F.col("_holds"))
    return out.select(
        *keep, "rule", "path", "operator", D.rule_status(F.col("_holds")).alias("status"), detail.alias("detail")
    )


def check_texts(df: DataFrame, body: str, rules: Sequence[D.Rule], opt: V.Options = V.DEFAULT, status_code: str | None = None) -> DataFrame:
    """``check_rules`` for documents that are still text: rule 0, "is JSON", holds the reason for a text that cannot be read, and
    such a text is judged by no other rule. Every text has a row."""
    keep = [_c(c) for c in df.columns if c != body]
    read = df.withColumn("_doc", D.parse(_c(body)))
    readable = F.col("_doc").isNotNull()
    first = read.select(
        *keep, F.lit(0).alias("rule"), F.lit("").alias("path"), F.lit("is JSON").alias("operator"), F.when(readable, "pass").otherwise("fail").alias("status"),
        F.when(readable, "").otherwise(F.coalesce(D.json_error(_c(body)), F.lit("no JSON text"))).alias("detail"))
    return first.unionByName(check_rules(read.filter(readable).drop(body), "_doc", rules, opt, status_code))


def rule_counts(results: DataFrame) -> DataFrame:
    """Documents per rule and status."""
    return results.groupBy("rule", "path", "operator").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "warn")]
    )


def flatten_documents(df: DataFrame, doc: str, **options) -> DataFrame:
    """Paths of every document with the JSON type and a display text."""
    flat = D.flatten(df, doc, **options)
    value = V.JsonValue(F.col("value"), F.col("type"), V.json_text(F.col("value")))
    return flat.withColumn("shown", V.json_shown(value))


def field_verdicts(docs: DataFrame, doc: str, table: DataFrame, match: tuple[str, str], mapping: Sequence[Mapping],
                   opt: V.Options = V.DEFAULT, keep: Sequence[str] = ()) -> DataFrame:
    """Compare mapped fields of each document with the table row it matches.

    ``match`` is (document path, table column).  When several rows match, the first in
    column order is used; ``db_rows`` tells how many there were.  Each mapping has
    ``api_field``, ``db_column`` and optionally ``expected``.
    """
    path, column = match
    types = {f.name: f.dataType for f in table.schema.fields}
    wanted = [m.get("db_column") for m in mapping if m.get("db_column") in types]
    cols = list(dict.fromkeys([column] + wanted))
    # the table side has one row per key before the join, so copies never multiply documents
    rows = table.select(_c(column).alias("_key"), *[_c(c).alias(f"t_{i}") for i, c in enumerate(cols)]).filter(F.col("_key").isNotNull())
    rows = first_per_key(rows, ["_key"], [V.orderable(F.col(f"t_{i}"), types[c]) for i, c in enumerate(cols)], "_rows")
    key = F.try_variant_get(_c(doc), D.spark_path(path), types[column].simpleString())
    mapping = [
        {"api": (m.get("api_field") or "").strip(), "db": (m.get("db_column") or "").strip(),
         "expected": None if m.get("expected") in (None, "") else str(m["expected"])}
        for m in mapping
    ]
    nothing = F.lit(None).cast("variant")
    reads = [
        (D.get_path(_c(doc), m["api"]) if m["api"] else nothing).alias(f"v_{i}") for i, m in enumerate(mapping)
    ]
    # documents are read before the join, so only the mapped values travel
    kept = [_c(c) for c in keep]
    read = docs.select(*kept, key.alias("_match"), *reads)
    joined = read.join(rows, F.col("_match") == F.col("_key"), "left")
    found = F.col("_rows").isNotNull()
    variant, string = T.VariantType(), T.StringType()
    typed = joined.select(
        *kept, "_rows", *[f"t_{i}" for i in range(len(cols))], *[f"v_{i}" for i in range(len(mapping))],
        *[V.json_type(F.col(f"v_{i}")).alias(f"k_{i}") for i in range(len(mapping))],
        *[V.json_text(F.col(f"v_{i}")).alias(f"x_{i}") for i in range(len(mapping))],
    )
    sides = []
    for i, m in enumerate(mapping):
        known = m["db"] in types
        db = F.col(f"t_{cols.index(m['db'])}") if known else F.lit(None).cast("string")
        db_type = types[m["db"]] if known else string
        api = V.JsonValue(F.col(f"v_{i}"), F.col(f"k_{i}"), F.col(f"x_{i}"))
        no_db = ~found if known else F.lit(True)
        sides += [
            api.value.isNull().alias(f"no_api_{i}"), no_db.alias(f"no_db_{i}"),
            V.json_form(api, opt, True).alias(f"f_api_{i}"), V.normalise(db, db_type, opt, True).alias(f"f_db_{i}"),
            V.json_shown(api).alias(f"s_api_{i}"), V.display(db, db_type, absent=no_db).alias(f"s_db_{i}"),
        ]
    formed = typed.select(*kept, "_rows", *sides)
    lines = []
    for i, m in enumerate(mapping):
        no_api, no_db = F.col(f"no_api_{i}"), F.col(f"no_db_{i}")
        agree = F.col(f"f_api_{i}").eqNullSafe(F.col(f"f_db_{i}"))
        if m["expected"] is not None:
            wanted = V.normalise(F.lit(m["expected"]), string, opt, True)
            api_ok, db_ok = wanted.eqNullSafe(F.col(f"f_api_{i}")), wanted.eqNullSafe(F.col(f"f_db_{i}"))
            result = F.when(api_ok & db_ok, "Match").otherwise("Mismatch")
            where = (
                F.when(api_ok & db_ok, "")
                .when(~api_ok & ~db_ok & ~agree, "API and DB both differ from expected")
                .when(~api_ok & ~db_ok, "API and DB agree, but differ from expected")
                .when(~api_ok, "API differs from expected (DB is correct)")
                .otherwise("DB differs from expected (API is correct)")
            )
        else:
            result = F.when(agree, "Match").otherwise("Mismatch")
            where = F.when(agree, "").otherwise("API ≠ DB")
        lines.append(
            F.struct(
                F.lit(m["api"] or m["db"]).alias("field"),
                F.lit(m["db"]).alias("db_column"),
                F.lit(m["expected"] or "").alias("expected"),
                F.col(f"s_api_{i}").alias("api"),
                F.col(f"s_db_{i}").alias("db"),
                F.when(no_api & no_db, "Missing in API and DB").when(no_api, "Missing in API")
                .when(no_db, "Missing in DB").otherwise(result).alias("result"),
                F.when(no_api & no_db, "API, DB").when(no_api, "API").when(no_db, "DB").otherwise(where).alias("where"),
            )
        )
    return formed.select(*kept, F.coalesce("_rows", F.lit(0)).alias("db_rows"), F.inline(F.array(*lines)))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """Counts per result; a field missing on both sides counts on both."""
    r = F.col("result")
    return verdicts.agg(
        F.count_if(r == "Match").alias("match"),
        F.count_if(r == "Mismatch").alias("mismatch"),
        F.count_if(r.isin("Missing in API", "Missing in API and DB")).alias("missing_in_api"),
        F.count_if(r.isin("Missing in DB", "Missing in API and DB")).alias("missing_in_db"),
    )


def mask_verdicts(verdicts: DataFrame, show_personal: bool = False, policy: NamePolicy = DEFAULT_POLICY) -> DataFrame:
    """Verdicts safe to show: the last path segment or the column name decides."""
    last = F.regexp_replace(F.element_at(F.split(F.col("field"), r"\."), -1), r"(\[\d+\])+$", "")
    hidden = policy.secret_flag(last) | policy.secret_flag(F.col("db_column"))
    out = verdicts
    for c in ("expected", "api", "db"):
        shown = P.masked_by_field(F.col(c), last, show_personal, policy)
        out = out.withColumn(c, F.when(hidden, F.lit(P.HIDDEN)).otherwise(shown))
    return out


def auto_map(fields: DataFrame, columns: DataFrame) -> DataFrame:
    """Pair document paths (``path``) with the columns (``col``, ``pos``) of one table by name."""
    by_key = (
        columns.select(D.field_name_key(F.col("col")).alias("name_key"), F.struct("pos", "col").alias("c"))
        .groupBy("name_key").agg(F.min("c").alias("c"))
    )
    keyed = fields.select("path").distinct().withColumn("name_key", D.field_name_key(F.col("path")))
    return keyed.join(by_key, "name_key").select(F.col("path").alias("api_field"), F.col("c.col").alias("db_column"))
