"""Small text rules over columns: identifiers, type strings, scores, expectations and alerts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.values import strip

# Integer widths, text sizes, schedules and severities.
INT_BITS = {"tinyint": 8, "smallint": 16, "mediumint": 24, "int": 32, "integer": 32, "bigint": 64}
DUE_AFTER_SECONDS = {"hourly": 3600, "daily": 24 * 3600, "weekly": 7 * 24 * 3600, "monthly": 30 * 24 * 3600}
SEVERITIES = ["critical", "high", "medium", "low", "info"]
STATUSES = ["failed", "error", "outdated", "passed", "info", "not run"]


# The classes of an identifier, tried in this order on the stripped text; anything else is text.
_MARKS = r"[ \t\n\r\f()+-]*"
IDENTIFIER_CLASSES = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "phone": rf"^(?:(?=\+)(?:{_MARKS}[0-9]){{10,13}}|(?:{_MARKS}[0-9]){{10}}|(?:{_MARKS}[0-9]){{12}}){_MARKS}$",
    "number": r"^-?[0-9]+$",
}


def classify(value: Column) -> Column:
    """email / phone / number / text of an identifier."""
    v = F.coalesce(strip(value), F.lit(""))
    kind = F.lit("text")
    for name, pattern in reversed(IDENTIFIER_CLASSES.items()):
        kind = F.when(v.rlike(pattern), name).otherwise(kind)
    return kind


def class_of(value: str | None) -> str:
    """The same class of a search term, at plan time."""
    v = (value or "").strip()
    return next((name for name, pattern in IDENTIFIER_CLASSES.items() if re.search(pattern, v, re.ASCII)), "text")


def _group(col: Column, pattern: str, i: int) -> Column:
    """A regex group, NULL instead of '' when there is none."""
    return F.nullif(F.regexp_extract(col, pattern, i), F.lit(""))


def parse_type(type_text: Column) -> Column:
    """struct(base, kind, length, precision, scale, unsigned, choices) of a type string."""
    t = F.lower(F.trim(F.coalesce(type_text, F.lit(""))))
    base = F.coalesce(_group(t, r"^([a-z]+)", 1), t)
    sized = r"^[a-z]+\((\d+)(?:,\s*(\d+))?\)"
    first, second = _group(t, sized, 1).try_cast("bigint"), _group(t, sized, 2).try_cast("bigint")
    is_decimal = base.isin("decimal", "numeric", "float", "double")
    length = F.when(~is_decimal, first)
    choices = F.when(
        base.isin("enum", "set"),
        F.transform(
            F.regexp_extract_all(type_text, F.lit(r"'((?:[^']|'')*)'"), F.lit(1)),
            lambda v: F.replace(v, F.lit("''"), F.lit("'")),
        ),
    )
    kind = (
        F.when(((base == "tinyint") & (length == 1)) | base.isin("bool", "boolean", "bit"), "boolean")
        .when(base.isin(*INT_BITS), "integer")
        .when(base.isin("decimal", "numeric", "float", "double", "real"), "decimal")
        .when(base.isin("date", "datetime", "timestamp", "time", "year"), "date")
        .when(base.isin("enum", "set"), "choice")
        .when(base == "json", "json")
        .when(base.isin("char", "varchar", "tinytext", "text", "mediumtext", "longtext"), "text")
        .when(base.contains("blob") | base.contains("binary"), "binary")
        .otherwise("other")
    )
    return F.struct(
        base.alias("base"),
        kind.alias("kind"),
        length.alias("length"),
        F.when(is_decimal, first).alias("precision"),
        F.when(is_decimal & first.isNotNull(), F.coalesce(second, F.lit(0))).alias("scale"),
        t.contains("unsigned").alias("unsigned"),
        choices.alias("choices"),
    )


def int_limits(base: Column, unsigned: Column) -> Column:
    """struct(smallest, largest) of an integer type, as decimals."""
    bits = F.lit(32)
    for name, width in INT_BITS.items():
        bits = F.when(base == name, F.lit(width)).otherwise(bits)

    def power(n: Column) -> Column:
        out = F.lit(None).cast("decimal(20,0)")
        for width in sorted({w for b in INT_BITS.values() for w in (b, b - 1)}):
            out = F.when(n == width, F.lit(str(2**width)).cast("decimal(20,0)")).otherwise(out)
        return out

    half = power(bits - 1)
    return F.struct(
        F.when(unsigned, F.lit(0).cast("decimal(20,0)")).otherwise(-half).alias("smallest"),
        (F.when(unsigned, power(bits)).otherwise(half) - 1).cast("decimal(20,0)").alias("largest"),
    )


def word_score(word: str, *fields: Column) -> Column:
    """Exact 100, prefix 60, word start 40, inside 20; other fields than the first count half."""
    w = word.lower()
    best = []
    for i, field in enumerate(fields):
        f = F.lower(F.coalesce(field.cast("string"), F.lit("")))
        weight = 1.0 if i == 0 else 0.5
        score = (
            F.when(f == "", 0.0)
            .when(f == w, 100 * weight)
            .when(f.startswith(w), 60 * weight)
            .when(f.rlike(r"(^|[^a-z0-9])" + re.escape(w)), 40 * weight)
            .when(f.contains(w), 20 * weight)
            .otherwise(0.0)
        )
        best.append(score)
    return F.greatest(*best) if len(best) > 1 else best[0]


def relevance(term: str, *fields: Column) -> Column:
    """Every word of the term must match: the lowest word score counts."""
    words = (term or "").split()
    if len((term or "").strip()) < 2:
        return F.lit(0.0)
    scores = [word_score(w, *fields) for w in words]
    return F.least(*scores) if len(scores) > 1 else scores[0]


def record_label(table: str, key_column: str, key: Column, name: Column | None = None) -> Column:
    parts = [F.lit(table), F.concat(F.lit(f"{key_column} = "), key.cast("string"))]
    if name is not None:
        parts.append(F.nullif(name.cast("string"), F.lit("")))
    return F.concat_ws(" / ", *parts)


BOUND = r"^(at most|at least|exactly)\s+(\d+)(\s+rows?)?$"


def evaluate(expect: Column, rows: Column, failed: Column, outdated: Column) -> Column:
    """Status of a run: outdated and error first, then the expectation on the row count."""
    e = F.lower(F.trim(expect))
    word = F.regexp_extract(e, BOUND, 1)
    limit = F.nullif(F.regexp_extract(e, BOUND, 2), F.lit("")).try_cast("bigint")
    ok = (
        F.when(e == "empty", rows == 0)
        .when(word == "at most", rows <= limit)
        .when(word == "at least", rows >= limit)
        .when(word == "exactly", rows == limit)
    )
    return (
        F.when(outdated, "outdated")
        .when(failed, "error")
        .when(rows.isNull(), "not run")
        .when(ok.isNull(), "info")
        .when(ok, "passed")
        .otherwise("failed")
    )


def change_text(delta: Column) -> Column:
    return (
        F.when(delta.isNull(), "")
        .when(delta > 0, F.concat(F.lit("+"), delta.cast("string"), F.lit(" since last run")))
        .when(delta < 0, F.concat(delta.cast("string"), F.lit(" since last run")))
        .otherwise("no change")
    )


def alerts(rules: Column, status: Column, rows: Column, seconds: Column, previous: Column) -> Column:
    """Texts of the alert rules (an array column) that fire."""
    # fixed values: the two rules with a number
    more_than = r"^rows\s*>\s*(\d+)$"
    slower = r"^slower than\s*(\d+(?:\.\d+)?)\s*s(?:econds?)?$"

    def fired(rule: Column) -> Column:
        r = F.lower(F.trim(rule))
        limit = F.nullif(F.regexp_extract(r, more_than, 1), F.lit(""))
        slow = F.nullif(F.regexp_extract(r, slower, 1), F.lit(""))
        return (
            F.when(rows > limit.try_cast("decimal(38,0)"), F.concat(rows.cast("string"), F.lit(" rows > "), limit))
            .when(
                (r == "rows increased") & (rows > previous),
                F.concat(F.lit("rows increased "), previous.cast("string"), F.lit(" → "), rows.cast("string")),
            )
            .when((r == "query failed") & status.isin("error", "outdated"), F.lit("query failed"))
            .when(
                seconds > slow.try_cast("double"),
                F.concat(F.lit("took "), F.round(seconds, 1).cast("decimal(12,1)").cast("string"), F.lit("s > "), slow, F.lit("s")),
            )
        )

    return F.array_compact(F.transform(F.coalesce(rules, F.array().cast("array<string>")), fired))


# Lint flags of SQL text, with their level.  ``absent`` flags fire when nothing matches.
LINT = [
    ("select_star", "low", r"select\s+(\w+\.)?\*"),
    ("function_on_column", "medium",
     r"\b(date|year|month|lower|upper|trim|substring|cast|convert|date_format)\s*\(\s*`?[\w.]+`?[^()]*\)\s*"
     r"(=|<|>|<=|>=|like|in|between)"),
    ("or_in_filter", "low", r"(?s)\bwhere\b.*\bor\b"),
    ("order_by_rand", "medium", r"order\s+by\s+rand\s*\("),
    ("not_in_select", "low", r"not\s+in\s*\(\s*select"),
]
LINT_LIMIT = r"\blimit\s+\d+"
LINT_AGGREGATE = r"\b(count|sum|avg|min|max)\s*\("
LINT_LEADING_WILDCARD = r"(?i)like\s*'%[^']*'"
SQL_STRING = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""


def lint_flags(sql: Column) -> list[tuple[str, str, Column]]:
    """(flag, level, condition) per lint; string literals are blanked first."""
    text = F.coalesce(sql, F.lit(""))
    bare = F.lower(F.regexp_replace(text, SQL_STRING, "''"))
    out = [(name, level, bare.rlike(pattern)) for name, level, pattern in LINT]
    out.insert(1, ("no_limit", "low", ~bare.rlike(LINT_LIMIT) & ~bare.rlike(LINT_AGGREGATE)))
    out.insert(2, ("leading_wildcard", "medium", text.rlike(LINT_LEADING_WILDCARD)))
    return out
