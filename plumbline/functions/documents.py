"""JSON documents as VARIANT columns: paths, flattening and response rules.

SQL NULL means "not present"; a variant null is a JSON null.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import values as V

# The rule operators.
RULE_OPERATORS = [
    "equals", "not equals", "exists", "not exists", "not null", "is null", "not empty", "contains",
    "matches regex", "greater than", "less than", "count at least", "count equals", "type is",
]

VARIANT = T.VariantType()
STRING = T.StringType()


def parse(text: Column) -> Column:
    """VARIANT of a JSON text, NULL where it is not valid JSON."""
    return F.try_parse_json(text)


def json_error(text: Column) -> Column:
    """Why a text is not JSON, with a hint; NULL when it is valid."""
    blank = text.isNull() | (V.strip(text) == "")
    hint = (
        F.when(text.contains("'") & ~text.contains('"'), "JSON needs double quotes, not single quotes")
        .when(text.rlike(r",\s*[}\]]"), "remove the comma before a closing } or ]")
        .otherwise("not valid JSON")
    )
    return F.when(blank, "no JSON text").when(parse(text).isNull(), hint)


def path_parts(path: str) -> list[str]:
    """``data.items[0].id`` as names and positions in brackets; an empty path or ``$`` has none."""
    return [] if path in ("", "$") else re.findall(r"[^.\[\]]+|\[\d+\]", path)


def spark_path(path: str) -> str | None:
    """The path as Spark reads it; None if a name holds both kinds of quotes, which a path cannot say."""
    steps = []
    for part in path_parts(path):
        quote = "'" if '"' in part else '"'
        if quote in part:
            return None
        steps.append(part if part.startswith("[") else f"[{quote}{part}{quote}]")
    return "$" + "".join(steps)


def get_path(doc: Column, path: str) -> Column:
    """The value at a path as VARIANT, NULL when absent."""
    known = spark_path(path)
    if known is not None:
        return F.try_variant_get(doc, known, "variant")
    value = doc
    for part in path_parts(path):  # names with both kinds of quotes are looked up in the members
        if part.startswith("["):
            value = F.try_variant_get(value, "$" + part, "variant")
        else:
            value = F.try_element_at(value.try_cast("map<string,variant>"), F.lit(part))
    return value


def with_status(doc: Column, path: str, status_code: Column | None, is_object: Column | None = None) -> Column:
    """Like ``get_path`` where ``response.status_code`` may come from a second column.

    A document that has its own ``response`` key wins; a document that is not an object
    is reachable under ``body``.
    """
    if status_code is None:
        return get_path(doc, path)
    if is_object is None:
        is_object = V.json_type(doc) == "object"
    if path == "response.status_code":
        own = get_path(doc, "response")
        return F.when(is_object & own.isNotNull(), get_path(doc, path)).otherwise(status_code.cast("variant"))
    if path == "body" or path.startswith(("body.", "body[")):
        rest = path[len("body"):].lstrip(".")
        return F.when(is_object, get_path(doc, path)).otherwise(get_path(doc, rest))
    return F.when(is_object, get_path(doc, path))


def nesting(doc: Column) -> Column:
    """How many containers lie inside each other in a document, itself included."""
    brackets = F.regexp_replace(F.regexp_replace(F.to_json(doc), r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, bracket: Column) -> Column:
        now = at["now"] + F.when(bracket.isin("[", "{"), 1).when(bracket.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step)["most"]


def flatten(df: DataFrame, doc: str, max_depth: int | None = None, list_items: int | None = None) -> DataFrame:
    """One row per leaf and per list of every document: the frame's columns plus ``path``, ``value`` and ``type``.

    Every level is a generator over the members of objects and lists; leaves pass through,
    so there is no shuffle and no array of a document's fields.  There are as many levels as
    the deepest document has, which one aggregate finds first; with a ``max_depth`` the
    containers below it stay whole as the value of their path.  ``list_items`` keeps only
    the first members of each list.
    """
    spark = df.sparkSession
    if max_depth is None:
        max_depth = df.agg(F.max(nesting(F.col(f"`{doc}`")))).first()[0] or 0
    keep = [F.col(f"`{c}`") for c in df.columns if c != doc]
    path, value, kind, done = F.col("_path"), F.col("_value"), F.col("_kind"), F.col("_done")
    out = df.filter(F.col(doc).isNotNull()).select(
        *keep, F.lit("").alias("_path"), F.col(doc).alias("_value"), F.lit(None).cast("string").alias("_kind"),
        F.lit(False).alias("_done"),
    )
    for _ in range(max_depth):
        typed = out.select(*keep, path, value, F.when(done, kind).otherwise(V.json_type(value)).alias("_kind"), done)
        # a list gives one row for itself and one for each member
        itself = F.when((kind == "list") & ~done, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
        copied = typed.select("*", F.explode(itself).alias("_itself"))
        opened = F.when(~done & ~F.col("_itself") & kind.isin("object", "list"), value)
        nodes = copied.withColumn("_opened", opened)
        members = nodes.lateralJoin(spark.tvf.variant_explode_outer(F.col("_opened").outer()).toDF("_pos", "_key", "_member"))
        is_member = F.col("_pos").isNotNull()
        # nothing comes out of an empty list (its own row is there) or an empty document
        hollow = ~is_member & F.col("_opened").isNotNull() & ((kind == "list") | (path == ""))
        members = members.filter(~F.coalesce(hollow, F.lit(False)))
        if list_items is not None:
            members = members.filter(~is_member | (kind == "object") | (F.col("_pos") < list_items))
        named = F.when(path == "", F.col("_key")).otherwise(F.concat(path, F.lit("."), F.col("_key")))
        placed = F.concat(path, F.lit("["), F.col("_pos").cast("string"), F.lit("]"))
        out = members.select(
            *keep,
            F.when(~is_member, path).when(kind == "object", named).otherwise(placed).alias("_path"),
            F.when(is_member, F.col("_member")).otherwise(value).alias("_value"),
            F.when(~is_member, kind).alias("_kind"),
            (~is_member).alias("_done"),
        )
    found = F.coalesce(kind, V.json_type(value))
    return out.select(*keep, path.alias("path"), value.alias("value"), found.alias("type"))


@dataclass(frozen=True)
class Rule:
    path: str
    operator: str
    expected: str = ""


def _is_number(text: str) -> bool:
    try:
        float(text)
    except (TypeError, ValueError):
        return False
    return True


def _is_whole(text: str) -> bool:
    try:
        int(text)
    except (TypeError, ValueError):
        return False
    return True


def _valid_pattern(text: str) -> bool:
    """Does the engine that will run the pattern take it?"""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(text)
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


def _items(v: Column) -> Column:
    return v.try_cast("array<variant>")


# What reads as a floating point number; anything else is sorted out before it is cast.
FLOAT_TEXT = r"(?i)^\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def list_holds(v: V.JsonValue, expected: str, opt: V.Options = V.DEFAULT) -> Column:
    """Does a list hold an item equal to a text?  Each item is typed once."""
    wanted = V.normalise(F.lit(expected), STRING, opt, True)
    typed = F.transform(
        _items(v.value), lambda x: F.struct(x.alias("value"), V.json_type(x).alias("kind"), V.json_text(x).alias("text"))
    )
    return F.exists(
        typed, lambda s: V.json_form(V.JsonValue(s["value"], s["kind"], s["text"]), opt, True).eqNullSafe(wanted)
    )


def _length(v: V.JsonValue) -> Column:
    return (
        F.when(v.kind == "list", F.size(_items(v.value)))
        .when(v.kind == "object", F.size(F.map_keys(v.value.try_cast("map<string,variant>"))))
        .when(v.kind == "string", F.length(v.text))
    )


def rule_holds(v: V.JsonValue, rule: Rule, opt: V.Options = V.DEFAULT, listed: Column | None = None) -> Column:
    """Does the value satisfy the rule?  NULL when that cannot be told.

    ``listed`` is the result of ``list_holds`` if an earlier projection has it.
    """
    op, exp = rule.operator, rule.expected
    kind, text, present = v.kind, v.text, v.value.isNotNull()
    unknown = F.lit(None).cast("boolean")
    if op not in RULE_OPERATORS:
        return unknown
    if op in ("exists", "not exists"):
        return present if op == "exists" else ~present
    if op in ("is null", "not null"):
        holds = kind == "null" if op == "is null" else kind != "null"
    elif op == "not empty":
        hollow = kind.isin("object", "list") & F.to_json(v.value).isin("[]", "{}")
        holds = ~((kind == "null") | ((kind == "string") & (text == "")) | hollow)
    elif op in ("equals", "not equals"):
        equal = V.json_form(v, opt, True).eqNullSafe(V.normalise(F.lit(exp), STRING, opt, True))
        holds = equal if op == "equals" else ~equal
    elif op == "contains":
        listed = list_holds(v, exp, opt) if listed is None else listed
        inside = F.lower(text).contains(exp.lower()) if opt.case_insensitive else text.contains(exp)
        holds = F.when(kind == "list", listed).when(kind == "string", inside)
    elif op == "matches regex":
        holds = F.when(kind == "string", text.rlike(exp)) if _valid_pattern(exp) else unknown
    elif op in ("greater than", "less than"):
        number = (
            F.when(kind.isin("number", "string") & text.rlike(FLOAT_TEXT), F.trim(text).try_cast("double"))
            .when(kind == "boolean", F.when(text == "true", 1.0).otherwise(0.0))
        )
        limit = F.lit(float(exp) if _is_number(exp) else None).cast("double")
        holds = number > limit if op == "greater than" else number < limit
    elif op in ("count at least", "count equals"):
        count = F.lit(int(exp) if _is_whole(exp) else None).cast("bigint")
        holds = _length(v) >= count if op == "count at least" else _length(v) == count
    else:  # type is
        holds = kind == exp.strip().lower()
    return F.when(~present, False).otherwise(holds)


def rule_status(holds: Column) -> Column:
    return F.when(holds, "pass").when(~holds, "fail").otherwise("warn")


def rule_detail(v: V.JsonValue, op: Column, expected: Column, holds: Column) -> Column:
    """What was seen, and for a failure what was expected; operator and expected text are columns."""
    kind, shown = v.kind, V.json_shown(v)
    counting, comparing = op.isin("count at least", "count equals"), op.isin("greater than", "less than")
    n = _length(v)
    told = F.concat(F.lit(" (expected "), F.when(counting | comparing, F.concat(op, F.lit(" "))).otherwise(""), expected, F.lit(")"))
    seen = (
        F.when(counting, F.concat(n.cast("string"), F.lit(" items"))).when(op == "type is", kind)
        .when((op == "is null") & holds, "null").when((op == "not null") & ~holds, "null")
        .when((op == "not empty") & ~holds, "empty").when(op == "not exists", F.concat(F.lit("present: "), shown))
        .otherwise(shown)
    )
    missed = (
        F.when((op == "equals") | counting | comparing | (op == "type is"), told)
        .when(op == "contains", F.concat(F.lit(" does not contain "), expected))
        .when(op == "matches regex", " does not match").otherwise("")
    )
    unclear = (
        F.when(op == "contains", F.concat(F.lit("cannot use contains on "), kind))
        .when((op == "matches regex") & (kind != "string"), F.concat(F.lit("value is "), kind, F.lit(", not text")))
        .when(op == "matches regex", "invalid regular expression")
        .when(comparing, F.concat(shown, F.lit(" or '"), expected, F.lit("' is not a number")))
        .when(n.isNull(), F.concat(F.lit("value is "), kind, F.lit(", it has no count")))
        .otherwise(F.concat(F.lit("expected count '"), expected, F.lit("' is not a whole number")))
    )
    return (
        F.when(~op.isin(RULE_OPERATORS), F.concat(F.lit("Unknown operator “"), op, F.lit("”")))
        .when(v.value.isNull(), "field is not present")
        .when(holds.isNull(), unclear)
        .when(holds, seen)
        .otherwise(F.concat(seen, missed))
    )


def check_rule(doc: Column, rule: Rule, opt: V.Options = V.DEFAULT, status_code: Column | None = None) -> Column:
    """struct(status, detail) of one rule on a document; ``operators.documents.check_rules`` takes many."""
    v = V.JsonValue.of(with_status(doc, rule.path, status_code))
    holds = rule_holds(v, rule, opt)
    detail = rule_detail(v, F.lit(rule.operator), F.lit(rule.expected), holds)
    return F.struct(rule_status(holds).alias("status"), detail.alias("detail"))


def field_name_key(name: Column) -> Column:
    """Last path segment, without list positions, lower case letters and digits only."""
    flat = F.regexp_replace(name, r"\[\d+\]", "")
    return F.regexp_replace(F.lower(F.element_at(F.split(flat, r"\."), -1)), "[^a-z0-9]", "")
