"""Jobs over a log of queries: scrubbing, lint, tables used, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import privacy as P
from plumbline.functions import text as X


def scrubbed_log(log: DataFrame) -> DataFrame:
    """The log with personal and secret values removed from the SQL and error texts."""
    return log.withColumn("sql", P.scrub_sql(F.col("sql"))).withColumn("error", P.scrub_sql(F.col("error")))


def lint_log(log: DataFrame) -> DataFrame:
    """One row per query and flag that fires."""
    keep = [F.col(f"`{c}`") for c in log.columns]
    flags = [
        F.when(cond, F.struct(F.lit(name).alias("flag"), F.lit(level).alias("level")))
        for name, level, cond in X.lint_flags(F.col("sql"))
    ]
    return log.select(*keep, F.inline(F.array_compact(F.array(*flags))))


def lint_summary(log: DataFrame) -> DataFrame:
    """Queries per flag, computed once per distinct text."""
    texts = log.groupBy("sql").agg(F.count(F.lit(1)).alias("n"))
    return lint_log(texts).groupBy("level", "flag").agg(F.sum("n").alias("queries"))


def tables_used(log: DataFrame, tables: DataFrame) -> DataFrame:
    """Known tables (name) named in the log, with the number of queries."""
    texts = log.groupBy("sql").agg(F.count(F.lit(1)).alias("n"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("sql"), F.lit(r"([a-z_][a-z0-9_]*)"), F.lit(1)))
    named = texts.select("n", F.explode(words).alias("word"))
    per_word = named.groupBy("word").agg(F.sum("n").alias("queries"))
    return per_word.join(tables.select(F.lower("name").alias("word")).distinct(), "word", "left_semi").select(
        F.col("word").alias("table"), "queries"
    )


def usage(log: DataFrame) -> DataFrame:
    """How often each text ran, and when last."""
    return log.groupBy("sql").agg(F.count(F.lit(1)).alias("runs"), F.max("ran_at").alias("last_run"))


def filter_log(log: DataFrame, connection: str | None = None, ok: bool | None = None, text: str = "",
               user: str | None = None) -> DataFrame:
    """History by database, outcome, words and person."""
    out = log
    if connection is not None:
        out = out.filter(F.col("connection") == connection)
    if ok is not None:
        out = out.filter(F.col("error").isNull() if ok else F.col("error").isNotNull())
    if text:
        out = out.filter(F.lower("sql").contains(text.lower()))
    if user is not None:
        out = out.filter(F.col("username") == user)
    return out
