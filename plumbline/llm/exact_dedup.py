"""Operator 2, exact dedup: equal texts are found by combining in three steps, each comparing whole texts.

Equal means identical after lower-casing A-Z. A map task first merges its own equal texts (the partial aggregate), winners
meet per (digest, salt) and the salts' winners per digest. The grouping keys hold the whole text besides its SHA-256, so two
texts of one digest would stay two groups. A text with a third of all rows sends at most one row a task to a salt and one row a
salt to the end. Members find
their group by digest and a second hash; that no two texts share both is checked, not assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, read_docs, written

SALTS = 16


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("norm")).withColumn("digest", F.sha2("norm", 256))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, tag, keep_id (largest id; NULL if no copy has one), group_size (long). ``tag`` is a
    second hash of the text: 64 bits more to tell apart texts whose digests collide."""
    salted = (
        _keyed(docs, id_col, text_col).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "norm", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    )
    whole = salted.groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole.select("digest", F.xxhash64("norm").alias("tag"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    NULL text counts as empty; empty texts equal each other. Rows repeated with one id and one text carry the same decision. A
    NULL id loses to any other; copies without any id keep each other (kept, keep_id NULL). Other columns are not read.
    """
    winners = written(groups(docs, id_col, text_col, salts), "op2-groups")
    clash = winners.groupBy("digest", "tag").count().where("count > 1")
    if not clash.isEmpty():
        raise ValueError("two different texts share their SHA-256 and their 64-bit hash")
    members = _keyed(docs, id_col, text_col).select("doc_id", "digest", F.xxhash64("norm").alias("tag"))
    joined = members.join(winners, ["digest", "tag"])
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns, whatever their names: one for each distinct text, that of the largest id.

    NULL text counts as empty. Of several rows with that id and text (repeated ones, or texts that differ in the case of A-Z only) the
    smallest row stays, by all its columns; any one where the columns have no order. Nothing remains of an empty table.
    """
    winners = groups(docs, id_col, text_col, salts).select(F.col("keep_id").alias("w_id"), F.col("digest").alias("w_digest"))
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    # the row travels as one struct, so its columns may have any names
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("own_id"), F.sha2(text, 256).alias("own_digest"))
    found = rows.join(winners, F.col("own_id").eqNullSafe(F.col("w_id")) & (F.col("own_digest") == F.col("w_digest")), "left_semi")
    ordered = not any(word in docs.schema.simpleString() for word in ("map<", "variant"))
    return found.groupBy("own_id", "own_digest").agg((F.min if ordered else F.first)("row").alias("row")).select("row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_docs(spark, sf_dir))


ORACLE = """
WITH k AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM k GROUP BY norm)
SELECT k.doc_id, g.keep_id, g.group_size, k.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(k.norm) AS text_sha256
FROM k JOIN g ON k.norm = g.norm
"""
