"""Readers and writers: JDBC, JSON documents, run history, snapshots and masked exports."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import documents as D
from plumbline.functions.privacy import mask

RUN_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("check_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("area", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("connection", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("result_rows", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("error", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("ran_at", T.TimestampNTZType()),
    ]
)


def jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: int | None = None,
    upper: int | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """A table (or ``(select ...) as t``) read in parallel slices of a numeric column."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column is not None:
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", str(lower))
            .option("upperBound", str(upper))
            .option("numPartitions", str(partitions))
        )
    return reader.load()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one where Spark runs on one machine only."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def json_documents(df: DataFrame, column: str, doc: str = "doc") -> DataFrame:
    """The frame with a parsed document and, for texts that are not JSON, the reason."""
    return df.withColumn(doc, D.parse(F.col(column))).withColumn("json_error", D.json_error(F.col(column)))


def append_runs(runs: DataFrame, path: str) -> None:
    """Add check runs to the history, one folder per connection."""
    runs.write.mode("append").partitionBy("connection").parquet(path)


def read_runs(spark: SparkSession, path: str, connection: str | None = None) -> DataFrame:
    runs = spark.read.schema(RUN_SCHEMA).parquet(path)
    return runs.filter(F.col("connection") == connection) if connection else runs


def check_history(runs: DataFrame, connection: str, check_id: str | None = None, limit: int | None = None) -> DataFrame:
    """The runs of a connection or of one check, newest first; ``limit`` keeps the newest ones."""
    runs = runs.filter(F.col("connection") == connection)
    if check_id is not None:
        runs = runs.filter(F.col("check_id") == check_id)
    runs = runs.orderBy(F.desc("run_id"))
    return runs if limit is None else runs.limit(limit)


def write_masked_csv(df: DataFrame, path: str, show_personal: bool = False) -> None:
    mask(df, show_personal).write.option("header", True).mode("error").csv(path)


def write_counts_json(counts: DataFrame, path: str) -> None:
    """Check results for other tools: counts and statuses only."""
    counts.write.mode("append").json(path)


def write_counts_text(counts: DataFrame, path: str) -> None:
    """One readable line per check."""
    counts.select(
        F.concat_ws(
            "  ", F.col("ran_at").cast("string"), "connection", "check_id", "status",
            F.coalesce(F.col("result_rows").cast("string"), F.lit("-")),
        ).alias("value")
    ).write.mode("append").text(path)
