"""Operator 8, line dedup, in DataFrame functions only.

Every text is split at newlines; a line's key is the line without white space at both ends, A-Z in lower case. Keys travel as
128-bit hashes with document and position, range-partitioned by (hash, salt) and sorted by document and position, so that each
run of equal hashes is streamed: its first occurrence, and its documents counted where the document changes. The salt comes from
the document, so a line that a third of all documents share is spread over all salts, and only its sums meet. What comes back
per document is a run-length bitmap of the lines it keeps, not text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, read_docs, written

#: salts of a hash; 64 keep a line of a third of all documents below 1 % of the rows in one run
SALTS = 64
_BLANKS = "' \\t\\n\\u000B\\u000C\\r'"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("body")).withColumn(
        "row_hash", F.xxhash64("doc_id", "body"))


def _keys(texts: DataFrame, min_chars: int, salts: int) -> DataFrame:
    """doc_id, row_hash, n_lines, pos, h1, h2, salt: one row per line whose key is long enough."""
    lines = texts.select("doc_id", "row_hash", F.split(ascii_lower(F.col("body")), "\n").alias("lines"))
    return (
        lines.select("doc_id", "row_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
        .withColumn("key", F.expr(f"trim(BOTH {_BLANKS} FROM line)")).where(F.char_length("key") >= min_chars)
        .select("doc_id", "row_hash", "n_lines", "pos", F.xxhash64("key").alias("h1"),
                F.xxhash64(F.lit(7), F.reverse("key")).alias("h2"), F.pmod("row_hash", F.lit(salts)).cast("int").alias("salt"))
    )


def keep_bitmaps(docs: DataFrame, min_docs: int | None = 10, min_chars: int = 1, salts: int = SALTS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, row_hash, keep_runs: lengths of alternating runs of kept and dropped lines, the first run kept (may be 0).

    ``min_docs`` = n: keys found in n documents or more lose all their lines everywhere. ``min_docs`` = None: the first line of
    each key, by document and position, stays and the others go. Keys below ``min_chars`` code points are never dropped. Only
    documents that lose a line have a row. Rows repeated with one id and one text are one document; NULL ids sort first.
    """
    keys = written(_keys(_texts(docs, id_col, text_col), min_chars, salts), "op8-keys")
    run = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "row_hash", "pos")
    before = F.lag("row_hash").over(run)
    streamed = keys.repartitionByRange("h1", "h2", "salt").withColumn(
        "new_doc", (F.row_number().over(run) == 1) | ~before.eqNullSafe(F.col("row_hash")))
    if min_docs is None:
        opens = streamed.where("new_doc").groupBy("h1", "h2", "salt").agg(F.min(F.struct("doc_id", "row_hash", "pos")).alias("first"))
        first = opens.groupBy("h1", "h2").agg(F.min("first").alias("first"))
        decided = opens.select("h1", "h2", "salt").join(first, ["h1", "h2"])
        lost = keys.join(decided, ["h1", "h2", "salt"]).where(
            ~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.row_hash") == F.col("row_hash")) & (F.col("first.pos") == F.col("pos"))))
    else:
        per_salt = streamed.groupBy("h1", "h2", "salt").agg(F.count_if("new_doc").alias("n_docs"))
        common = per_salt.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs)
        decided = per_salt.select("h1", "h2", "salt").join(common, ["h1", "h2"])
        lost = keys.join(decided, ["h1", "h2", "salt"])
    per_doc = lost.groupBy("doc_id", "row_hash").agg(
        F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("pos")).alias("gone"))
    starts = F.filter("gone", lambda p, i: F.get("gone", i - 1).isNull() | (F.get("gone", i - 1) != p - 1))
    ends = F.filter("gone", lambda p, i: F.get("gone", i + 1).isNull() | (F.get("gone", i + 1) != p + 1))
    runs = per_doc.select("doc_id", "row_hash", "n_lines", F.arrays_zip(starts.alias("s"), ends.alias("e")).alias("runs"))
    pairs = F.transform("runs", lambda r, j: F.array(
        r["s"] - F.coalesce(F.get("runs", j - 1)["e"] + 1, F.lit(0)), r["e"] - r["s"] + 1))
    return runs.select("doc_id", "row_hash", F.concat(
        F.flatten(pairs), F.array(F.col("n_lines") - F.element_at("runs", -1)["e"] - 1)).alias("keep_runs"))


def kept_texts(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_text: the bitmaps applied to the texts; NULL text gives one empty line."""
    texts = _texts(docs, id_col, text_col).withColumnRenamed("doc_id", "t_id").withColumnRenamed("row_hash", "t_hash")
    same = [F.col("t_hash") == F.col("row_hash"), F.col("t_id").eqNullSafe(F.col("doc_id"))]
    joined = texts.join(bitmaps, same, "left").select(
        F.col("t_id").alias("doc_id"), "body", "keep_runs", F.split("body", "\n").alias("lines"))
    marks = F.flatten(F.transform("keep_runs", lambda n, j: F.array_repeat(j % 2 == 0, n)))
    kept = F.filter(F.arrays_zip(F.col("lines").alias("line"), marks.alias("keep")), lambda x: x["keep"])
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("keep_runs").isNull(), F.lit(0)).otherwise(
            F.aggregate(F.filter("keep_runs", lambda n, j: j % 2 == 1), F.lit(0), lambda a, n: a + n)).cast("long").alias("n_dropped"),
        F.when(F.col("keep_runs").isNull(), F.col("body")).otherwise(
            F.array_join(F.transform(kept, lambda x: x["line"]), "\n")).alias("kept_text"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir)
    out = kept_texts(docs, keep_bitmaps(docs, min_docs=10, min_chars=1))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
h AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.doc_id, k.pos, k.line, h.key IS NOT NULL AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
