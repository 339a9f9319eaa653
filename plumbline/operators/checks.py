"""Check definitions, batches of checks and the history of their runs.

A history is a frame of runs (see ``sources.stores.RUN_SCHEMA``); newest-run questions use
a per-check row limit that Spark applies on both sides of the shuffle.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import text as X
from plumbline.sources.catalog import local_frame
from plumbline.sources.environment import Env
from plumbline.sources.stores import RUN_SCHEMA

CHECK_SCHEMA = (
    "id string, title string, area string, why string, sql string, expect string, severity string, "
    "tags array<string>, owner string, alerts array<string>, database string, schedule string"
)


def checks_frame(env: Env, checks: Sequence[Mapping]) -> DataFrame:
    """Check definitions with every field filled: what a definition leaves out gets its default as a column expression."""
    schema = T.StructType.fromDDL(CHECK_SCHEMA)
    lists = {f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType)}

    def cell(value, name: str):
        if value is None or name not in lists:
            return value if value is None else str(value)
        return [str(x) for x in (value.split(",") if isinstance(value, str) else value)]

    given = local_frame(env.spark, [tuple(cell(c.get(n), n) for n in schema.names) for c in checks], CHECK_SCHEMA)
    filled = lambda name, *otherwise: F.coalesce(F.nullif(F.trim(name), F.lit("")), *otherwise)
    words = lambda name: F.filter(F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    expect = F.lower(filled("expect", F.lit("empty")))
    usual = F.when(expect == "info", "info").otherwise("medium")
    severity = F.lower(filled("severity", usual))
    defaults = {
        "title": F.coalesce("title", "id", F.lit("Untitled check")), "area": F.coalesce("area", F.lit("Other")), "expect": expect,
        "severity": F.when(severity.isin(list(X.SEVERITIES)), severity).otherwise(usual), "tags": words("tags"),
        "owner": F.coalesce("owner", F.lit("")), "alerts": words("alerts"), "schedule": F.lower(filled("schedule", F.lit("manual"))),
    }
    return given.select(*[defaults.get(n, F.col(n)).alias(n) for n in schema.names])


def filter_checks(checks: DataFrame, database: str | None = None, severities: Sequence[str] = (),
                  tags: Sequence[str] = (), area: str | None = None, term: str = "",
                  schedule: str | None = None, ids: Sequence[str] = ()) -> DataFrame:
    """Checks by database, severity, any of the tags, area, words, schedule and id."""
    out = checks.filter(F.col("database").isNull() | F.col("database").eqNullSafe(F.lit(database)))
    if severities:
        out = out.filter(F.col("severity").isin(list(severities)))
    if tags:
        out = out.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if area and area != "All areas":
        out = out.filter(F.col("area") == area)
    if schedule:
        out = out.filter(F.col("schedule") == schedule)
    if ids:
        out = out.filter(F.col("id").isin(list(ids)))
    if term:
        words = F.concat_ws(
            " ", F.coalesce("title", F.lit("")), F.coalesce("why", F.lit("")), F.coalesce("sql", F.lit("")),
            F.array_join("tags", " "), F.coalesce("owner", F.lit("")),
        )
        out = out.filter(F.lower(words).contains(term.lower()))
    return out


# ---------------------------------------------------------------- runs
def latest_two(runs: DataFrame) -> DataFrame:
    """The latest and the previous run of each check on each connection, side by side."""
    newest = Window.partitionBy("connection", "check_id").orderBy(F.desc("run_id"))
    top = runs.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= 2)
    fields = ["run_id", "status", "result_rows", "seconds", "ran_at"]
    picked = [F.max(F.when(F.col("_n") == 1, F.col(f))).alias(f) for f in fields]
    picked += [F.max(F.when(F.col("_n") == 2, F.col(f))).alias(f"previous_{f}") for f in ("run_id", "status", "result_rows")]
    return top.groupBy("connection", "check_id").agg(*picked)


def change(rows: Column, previous: Column) -> Column:
    """Difference of two counts, NULL if either is unknown."""
    return rows - previous


def ranged(runs: DataFrame) -> DataFrame:
    """The history sorted into ranges of (connection, check, run), cut at quantiles Spark samples, with the number of the range.

    Ranges hold about equally many runs, however the run ids are spaced and however many of them are one check's.
    """
    order = ["connection", "check_id", "run_id", "result_rows"]
    return runs.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())


def changes(runs: DataFrame) -> DataFrame:
    """Every run with the count before it and the change since; runs of one id go by their counts.

    Each range is looked through by itself. Only the first run of a check in a range lacks its predecessor, which is the last one of
    that check in an earlier range: the last runs send a copy of their count, and per check these copies meet the first runs, a
    row or two a range. All of it is one pass over one partitioning, so both sides see the same cuts.
    """
    check = ["connection", "check_id"]
    inside = Window.partitionBy("_range", *check).orderBy("run_id", "result_rows")
    own = ranged(runs).withColumn("_turn", F.row_number().over(inside)).withColumn("_before", F.lag("result_rows").over(inside)).withColumn(
        "_last", F.lead(F.lit(1)).over(inside).isNull())
    # _copy 1: what a last run sends on. Rows that have their predecessor stay among their range
    sent = own.withColumn("_copy", F.explode(F.when(F.col("_last"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    meets = (F.col("_copy") == 1) | (F.col("_turn") == 1)
    sent = sent.withColumn("_at", F.when(meets, F.lit(-1)).otherwise(F.col("_range")))
    between = Window.partitionBy(*check, "_at").orderBy("_range", "_copy", "run_id")
    carried = F.when(F.col("_at") == -1, F.lag("result_rows").over(between)).otherwise(F.col("_before"))
    out = sent.withColumn("previous_rows", carried).filter("_copy = 0").select(*runs.columns, "previous_rows")
    delta = change(F.col("result_rows"), F.col("previous_rows"))
    return out.withColumn("change", delta).withColumn("change_text", X.change_text(delta))


def issue_trend(runs: DataFrame) -> DataFrame:
    """Rows found per day by the last run of each check that day, failed ones only."""
    day = F.date_format("ran_at", "yyyy-MM-dd")
    last = Window.partitionBy("connection", "day", "check_id").orderBy(F.desc("run_id"))
    last_runs = runs.withColumn("day", day).withColumn("_n", F.row_number().over(last)).filter(F.col("_n") == 1)
    return (
        last_runs.filter(F.col("status") == "failed").groupBy("connection", "day")
        .agg(F.coalesce(F.sum("result_rows"), F.lit(0)).alias("issues"))
    )


def due(checks: DataFrame, runs: DataFrame, connection: str, now: Column) -> DataFrame:
    """Checks whose schedule window has passed since their latest run; manual and never run are due."""
    latest = (
        runs.filter(F.col("connection") == connection).groupBy("check_id")
        .agg(F.max_by("ran_at", "run_id").alias("last_run"))
    )
    window = F.lit(None).cast("bigint")
    for schedule, seconds in X.DUE_AFTER_SECONDS.items():
        window = F.when(F.col("schedule") == schedule, F.lit(seconds)).otherwise(window)
    ran = F.col("last_run").try_cast("timestamp_ntz")
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(ran.cast("timestamp"))
    out = checks.join(latest, F.col("id") == F.col("check_id"), "left").drop("check_id")
    return out.withColumn("due", F.coalesce(age >= window, F.lit(True)))


def dashboard(checks: DataFrame, runs: DataFrame, connection: str, today: str) -> DataFrame:
    """One row per check: status, rows, change, duration, last run, and whether it ran today."""
    latest = latest_two(runs.filter(F.col("connection") == connection)).drop("connection")
    status = F.coalesce("status", F.lit("not run"))
    delta = F.when(
        ~status.isin("error", "outdated"), change(F.col("result_rows"), F.col("previous_result_rows"))
    )
    return checks.join(latest, F.col("id") == F.col("check_id"), "left").select(
        "id", F.col("title").alias("check"), "area", "severity", status.alias("status"),
        F.col("result_rows").alias("rows"), delta.alias("change"), F.col("seconds").alias("duration_s"),
        F.date_format("ran_at", "yyyy-MM-dd HH:mm:ss").alias("last_run"),
        F.coalesce(F.date_format("ran_at", "yyyy-MM-dd") == today, F.lit(False)).alias("ran_today"),
        "owner", F.array_join("tags", ", ").alias("tags"),
    )


def _ordinal(col: str, order: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in order]), F.col(col))


def ordered_by_urgency(table: DataFrame) -> DataFrame:
    """Worst status first, then severity."""
    return table.orderBy(_ordinal("status", X.STATUSES), _ordinal("severity", X.SEVERITIES), "id")


def dashboard_totals(table: DataFrame) -> DataFrame:
    today = F.col("ran_today")
    failed = today & (F.col("status") == "failed")
    return table.agg(
        F.count_if(today).alias("run_today"),
        F.count_if(today & (F.col("status") == "passed")).alias("passed"),
        F.count_if(failed).alias("failed"),
        F.count_if(today & F.col("status").isin("error", "outdated")).alias("warnings"),
        F.coalesce(F.sum(F.when(failed, F.col("rows"))), F.lit(0)).alias("total_issues"),
    )


def got_worse(table: DataFrame) -> DataFrame:
    return table.filter((F.col("status") == "failed") & (F.col("change") > 0))


def with_problems(table: DataFrame) -> DataFrame:
    """Checks to run again."""
    return table.filter(F.col("status").isin("failed", "error", "outdated"))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("checks"))


def batch_summary(results: DataFrame) -> DataFrame:
    """One row: checks run, how many passed, and the ids of those that failed, could not run (error or outdated), or set off an alert.

    ``results`` are the runs of a batch, a row per check, with ``fired`` as ``run_checks`` returns it.
    """

    def ids(cond: Column) -> Column:
        return F.array_sort(F.collect_set(F.when(cond, F.col("check_id"))))

    return results.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") == "passed").alias("passed"), ids(F.col("status") == "failed").alias("failed"),
        ids(F.col("status").isin("error", "outdated")).alias("errored"), ids(F.size("fired") > 0).alias("alerting"))


def top_issues(table: DataFrame, n: int = 15) -> DataFrame:
    return table.filter(F.col("status") == "failed").orderBy(F.desc("rows"), "id").limit(n)


def slowest(table: DataFrame, n: int = 5) -> DataFrame:
    return table.filter(F.col("duration_s").isNotNull()).orderBy(F.desc("duration_s"), "id").limit(n)


def evaluated(runs: DataFrame) -> DataFrame:
    """Runs (expect, alerts, result_rows, seconds, error, previous_rows) with status and fired alerts."""
    failed = F.col("error").isNotNull()
    status = X.evaluate(F.col("expect"), F.col("result_rows"), failed, F.coalesce(F.col("error").startswith(OUTDATED), F.lit(False)))
    out = runs.withColumn("status", status)
    return out.withColumn(
        "fired", X.alerts(F.col("alerts"), F.col("status"), F.col("result_rows"), F.col("seconds"), F.col("previous_rows"))
    )


# ---------------------------------------------------------------- batches
#: how the error of a check begins that names a column that is not there any more
OUTDATED = "no longer there"


def _run_one(env: Env, session: SparkSession, check: Mapping, cap: int | None, pool: str) -> tuple[int | None, float, str | None]:
    started = time.monotonic()
    # a property of this thread: with spark.scheduler.mode FAIR, batches share the cluster evenly, without it it does nothing
    env.spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
    try:
        run: Callable[[Env], DataFrame] | None = check.get("run")
        df = run(env) if run else session.sql(check["sql"])
        rows, error = (df if cap is None else df.limit(cap + 1)).count(), None
    except AnalysisException as e:
        kind = OUTDATED if (e.getCondition() or "").startswith("UNRESOLVED_COLUMN") else type(e).__name__
        rows, error = None, f"{kind}: {str(e).splitlines()[0]}"
    except Exception as e:  # a failing check is a result; it never stops the batch
        rows, error = None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
    return rows, round(time.monotonic() - started, 2), error


def run_checks(env: Env, checks: Sequence[Mapping], history: DataFrame | None = None, connection: str | None = None,
               workers: int = 6, cap: int | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Run a batch and return its runs: only counts come to the driver, never rows.

    Every check is one Spark job; a few are submitted at a time so that small jobs share
    the cluster, each batch in a scheduler pool and a session of its own.  Append the result to the history with ``stores.append_runs``.
    """
    connection = connection or env.name
    batch = f"checks-{uuid.uuid4().hex}"
    with env.isolated() as session, ThreadPoolExecutor(max_workers=workers) as threads:
        outcomes = list(threads.map(lambda c: _run_one(env, session, c, cap, batch), checks))
    moment = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    first_id = int(moment.timestamp() * 1_000_000)
    rows = [
        (first_id + i, c["id"], rows, seconds, error, moment) for i, (c, (rows, seconds, error)) in enumerate(zip(checks, outcomes))
    ]
    ran = local_frame(
        env.spark, rows, "run_id bigint, check_id string, result_rows bigint, seconds double, error string, ran_at timestamp_ntz"
    )
    defined = checks_frame(env, checks).select(
        F.col("id").alias("check_id"), "title", "area", "severity", "expect", F.col("alerts").alias("alerts")
    )
    out = ran.join(defined, "check_id").withColumn("connection", F.lit(connection)).withColumn("user_id", F.lit(None).cast("string"))
    if history is not None:
        before = latest_two(history.filter(F.col("connection") == connection)).select(
            "check_id", F.col("result_rows").alias("previous_rows")
        )
        out = out.join(before, "check_id", "left")
    else:
        out = out.withColumn("previous_rows", F.lit(None).cast("bigint"))
    out = evaluated(out)
    return out.withColumn("change", change(F.col("result_rows"), F.col("previous_rows"))).select(
        *RUN_SCHEMA.names, "previous_rows", "change", "fired"
    )


def as_history(runs: DataFrame) -> DataFrame:
    """The columns of a batch that are kept."""
    return runs.select(*RUN_SCHEMA.names)
