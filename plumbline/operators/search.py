"""Search: identifiers in the data, tables and columns by name, assets by words."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import names as N
from plumbline.functions import text as X
from plumbline.functions.values import INTEGRAL
from plumbline.operators.filters import typed_literal
from plumbline.operators.value_filter import value_filter
from plumbline.sources.catalog import local_frame, union_all
from plumbline.sources.environment import Env

# Asset kinds in report order and the rank of key classes.
ASSET_KINDS = ["Table", "Column", "Saved query", "QA check", "Playbook", "Consistency rule", "History"]
KEY_RANK = {"PRI": 0, "UNI": 1, "MUL": 2}


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def searchable(kind: str, name: str, dtype: T.DataType) -> bool:
    """May a column of this name and type hold an identifier of this kind?"""
    text = isinstance(dtype, T.StringType)
    number = isinstance(dtype, (T.ShortType, T.IntegerType, T.LongType, T.DecimalType))
    if kind == "email":
        return text and N.matches(N.EMAIL_NAME, name)
    if kind == "phone":
        return (text or isinstance(dtype, (T.LongType, T.DecimalType))) and N.matches(N.PHONE_NAME, name)
    if kind == "number":
        return (number or text) and (N.matches(N.ID_NAME, name) or N.matches(N.PHONE_NAME, name))
    return text and N.matches(N.ID_NAME, name)


def search_values(
    env: Env,
    values: Sequence[str],
    tables: Iterable[str] | None = None,
    columns: Mapping[str, Sequence[str]] | None = None,
    include_primary_ids: bool = False,
    cap: int | None = None,
) -> DataFrame:
    """Where identifiers occur: value, tbl, col, key_class, matches.  One scan per table.

    The scan keeps only rows that hold one of the values (a filter Parquet can push down),
    explodes their hits and counts them; the value list is part of the query.
    """
    parts = []
    for table in sorted(tables or env.tables):
        df = env.table(table)
        cells, hit = [], None
        for f in df.schema.fields:
            if env.policy.is_secret(f.name) or (columns and f.name not in columns.get(table, ())):
                continue
            primary = env.keys.get(table) == f.name
            wanted = []
            for v in values:
                kind = X.class_of(v)
                if not (columns or searchable(kind, f.name, f.dataType)):
                    continue
                if kind == "number" and f.name == "id" and primary and not include_primary_ids:
                    continue
                if isinstance(f.dataType, (T.StringType, *INTEGRAL, T.DecimalType)):
                    wanted.append(v.strip())
            if not wanted:
                continue
            linked = any(k.table == table and k.column == f.name for k in env.links)
            key_class = "PRI" if primary else "MUL" if linked else ""
            cond = _c(f.name).isin(*[typed_literal(v, f.dataType) for v in wanted])
            hit = cond if hit is None else hit | cond
            cells.append(
                F.when(cond, F.struct(
                    _c(f.name).cast("string").alias("value"), F.lit(f.name).alias("col"), F.lit(key_class).alias("key_class")
                ))
            )
        if not cells:
            continue
        found = df.filter(hit).select(F.inline(F.array_compact(F.array(*cells))))
        counts = found.groupBy("value", "col", "key_class").agg(F.count(F.lit(1)).alias("matches"))
        parts.append(counts.select("value", F.lit(table).alias("tbl"), "col", "key_class", "matches"))
    if not parts:
        return local_frame(env.spark, [], "value string, tbl string, col string, key_class string, matches bigint")
    out = union_all(parts)
    if cap is not None:
        out = out.withColumn("matches", F.least("matches", F.lit(cap)))
    return out


def ranked_hits(hits: DataFrame) -> DataFrame:
    """Most selective key class first, then matches, then table."""
    rank = F.lit(3)
    for key, r in KEY_RANK.items():
        rank = F.when(F.col("key_class") == key, F.lit(r)).otherwise(rank)
    return hits.orderBy(rank, F.desc("matches"), "tbl", "col")


def search_ids(env: Env, ids: DataFrame, id_column: str, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """The multi-value form: a frame of identifiers against chosen columns; value, tbl, col, matches.

    Each table is read once, its columns unpivoted. A filter made of the identifiers drops most cells in the scan; the rest is
    counted per value, and only the counts meet the identifiers.
    """
    wanted = ids.select(_c(id_column).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct()
    passes = value_filter(wanted)
    parts = []
    for table, names in columns.items():
        cells = F.array(*[F.struct(F.lit(c).alias("col"), _c(c).cast("string").alias("value")) for c in names])
        parts.append(env.table(table).select(F.lit(table).alias("tbl"), F.inline(cells)).filter(F.col("value").isNotNull() & passes(F.col("value"))))
    counts = union_all(parts).groupBy("value", "tbl", "col").agg(F.count(F.lit(1)).alias("matches"))
    return counts.join(wanted, "value", "left_semi")


def find_by_id(env: Env, column: str, value: str, rows: int | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(summary per table that has the column, first rows per table)."""
    summary, samples = [], {}
    for table in env.tables:
        df = env.safe_table(table)
        if column not in df.columns:
            continue
        match = df.filter(_c(column) == typed_literal(value, df.schema[column].dataType))
        summary.append(match.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("tbl"), "rows"))
        samples[table] = match if rows is None else match.limit(rows)
    if not summary:
        return local_frame(env.spark, [], "tbl string, rows bigint"), samples
    return union_all(summary), samples


# ---------------------------------------------------------------- by name
# Points for a word in the name and in the columns, for all words, for the whole term as the name and as its
# beginning, for each letter of the name, and for the first pinned table.
IN_NAME, IN_COLUMNS, ALL_WORDS, WHOLE_NAME, NAME_START, A_LETTER, PINNED = 10.0, 2.0, 25.0, 100.0, 30.0, -0.05, 500.0


def _alternatives(words: Sequence[str]) -> str:
    """A pattern of any of the words; up to three letters must be a name part of their own (or its plural)."""
    return "|".join(rf"(?:^|_){re.escape(w)}(?:_|s?$)" if len(w) < 4 else re.escape(w) for w in words)


def find_tables(tables: DataFrame, term: str, aliases: Mapping[str, Sequence[str]] | None = None,
                topics: Mapping[str, Sequence[str]] | None = None, limit: int | None = None) -> DataFrame:
    """Tables (name, columns as one text, rows) matching a loose description, best first.

    Each word of the term is a row of (name pattern, column pattern); a table holds them as an array, gets the points of each
    in ``earned``, and its score is their sum and the bonuses.
    """
    term = (term or "").strip().lower()
    words = re.findall(r"[^\s_.]+", term)
    order = [F.desc("score"), F.desc("rows"), F.asc("name")]
    known = tables.select("name", "rows", F.lower("name").alias("n"), F.lower("columns").alias("c"))
    if not words:
        out = known.select("name", "rows", F.lit(0.0).alias("score"), F.lit("").alias("matched"))
    else:
        patterns = [_alternatives([w, *map(str.lower, (aliases or {}).get(w, ()))]) for w in words]
        asked = F.array(*[F.struct(F.lit(p).alias("name"), F.lit(rf"(?:^|\s|_)(?:{p})").alias("cols")) for p in patterns])
        earned = F.transform(asked, lambda w: F.when(F.rlike("n", w["name"]), IN_NAME).when(F.rlike("c", w["cols"]), IN_COLUMNS).otherwise(0.0))
        spoken = f" {' '.join(term.split())} "
        pinned = dict.fromkeys(t for phrase, names in (topics or {}).items() if f" {phrase.lower()} " in spoken for t in names)
        place = F.array_position(F.array(*map(F.lit, pinned)) if pinned else F.array().cast("array<string>"), F.col("n"))
        whole = F.lit(term.replace(" ", "_"))
        scored = known.withColumn("earned", earned).withColumn("hits", F.size(F.filter("earned", lambda e: e > 0))).withColumn("place", place)
        bonuses = [
            (F.col("hits") == len(words), F.lit(ALL_WORDS)), (F.col("n") == whole, F.lit(WHOLE_NAME)), (F.col("n").startswith(whole), F.lit(NAME_START)),
            (F.col("place") > 0, PINNED + 1 - F.col("place")), (F.lit(True), F.char_length("n") * A_LETTER),
        ]
        points = F.aggregate("earned", F.lit(0.0), lambda a, e: a + e)
        for when, gain in bonuses:
            points = points + F.when(when, gain).otherwise(0.0)
        shown = F.greatest("hits", F.least("place", F.lit(1)))
        out = scored.where((F.col("hits") > 0) | (F.col("place") > 0)).select(
            "name", "rows", F.round(points, 2).alias("score"), F.concat(shown.cast("string"), F.lit(f"/{len(words)}")).alias("matched"))
        return out.orderBy(*order) if limit is None else out.orderBy(*order).limit(limit)
    out = out.orderBy(F.desc("rows"), "name")
    return out if limit is None else out.limit(limit)


def find_columns(columns: DataFrame, term: str, limit: int | None = None) -> DataFrame:
    term = (term or "").strip().lower()
    out = columns.filter(F.lower("col").contains(term)) if term else columns.limit(0)
    return out.orderBy("tbl", "pos").limit(limit) if limit else out


def search_assets(assets: DataFrame, term: str, fields: Sequence[str], per_kind: int | None = None) -> DataFrame:
    """Assets (kind, title, and the scored text columns) matching every word, best per kind.

    The best ones are chosen with a row limit per kind that Spark applies before the
    shuffle, so a kind with most of the assets stays cheap.
    """
    scored = assets.withColumn("score", X.relevance(term, *[_c(f) for f in fields])).filter(F.col("score") > 0)
    # the same history text appears once
    once = scored.filter(F.col("kind") == "History").dropDuplicates(["kind", "title"])
    scored = scored.filter(F.col("kind") != "History").unionByName(once)
    best = Window.partitionBy("kind").orderBy(F.desc("score"), "title", *[f for f in fields if f != "title"])
    placed = scored.withColumn("place", F.row_number().over(best))
    return placed if per_kind is None else placed.filter(F.col("place") <= per_kind)
