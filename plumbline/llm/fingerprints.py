"""Operator 5, document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of words (``[^\\x20\\x09-\\x0D]+``, A-Z in lower case), a word's weight is its count. Sample k of a bag draws
for every word r and c from Gamma(2, 1) and b from [0, 1), all of them hashes of (word, k); with t = floor(ln(weight) / r + b)
the word's value is ln(c) - r * (t - b + 1), and the smallest value gives the sample (word, t). Two bags agree on a sample with
a probability equal to their generalised Jaccard similarity, the sum of smaller weights over the sum of larger ones.

A value is kept as 31 bits of fixed point followed by 32 bits that name (word, t), so a sample is the minimum of a long and the
K minima are one hash aggregate inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import ascii_lower, read_docs

#: samples of a fingerprint; the likeness of two has a standard error of at most 0.5 / sqrt(K)
SAMPLES = 32
_LOW = 0xFFFFFFFF
_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"


def _sample(k: int) -> Column:
    """Of one word: 31 bits of its value in sample k, then 32 bits that name (word, t)."""
    first, second = F.xxhash64("term", F.lit(2 * k)), F.xxhash64("term", F.lit(2 * k + 1))
    unit = lambda bits: (bits.cast("double") + 0.5) / float(1 << 32)
    r = -F.ln(unit(first.bitwiseAND(_LOW)) * unit(F.shiftrightunsigned(first, 32)))
    c = -F.ln(unit(second.bitwiseAND(_LOW)) * unit(F.shiftrightunsigned(second, 32)))
    b = unit(first.bitwiseXOR(F.shiftrightunsigned(second, 17)).bitwiseAND(_LOW))
    t = F.floor(F.col("log_weight") / r + b)
    value = F.floor((F.ln(c) - r * (t - b + 1.0) + 96.0) * float(1 << 24))
    return F.shiftleft(value, 32).bitwiseOR(F.xxhash64("term", t).bitwiseAND(_LOW))


def samples(texts: DataFrame, keys: list[str], text_col: str = "text", k: int = SAMPLES) -> DataFrame:
    """``keys`` and ``samples`` (k integers as an array) for each text that has a word; ``keys`` must name a row. Texts already
    partitioned by some of the keys are not shuffled again."""
    words = texts.select(*keys, F.explode(F.split(ascii_lower(F.col(text_col)), _SPLIT)).alias("word")).where("word <> ''")
    bags = words.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.count("*").alias("weight"))
    minima = bags.withColumn("log_weight", F.ln(F.col("weight").cast("double"))).groupBy(*keys).agg(
        *[F.min(_sample(i)).alias(f"s{i}") for i in range(k)])
    return minima.select(*keys, F.array(*[F.col(f"s{i}").bitwiseAND(_LOW) for i in range(k)]).alias("samples"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples; two empty fingerprints are alike, an empty and another one are not."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), (a.isNull() & b.isNull()).cast("double")).otherwise(same / F.size(a))


def printed(samples_col: Column) -> Column:
    """A fingerprint as text: eight hex digits a sample; 'empty' for a text without words."""
    return F.coalesce(F.lower(F.array_join(F.transform(samples_col, lambda x: F.lpad(F.hex(x), 8, "0")), "")), F.lit("empty"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES) -> DataFrame:
    """doc_id, fingerprint for each row; NULL counts as empty. Rows with one id and one text are one row of the result."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = rows.withColumn("row_hash", F.xxhash64("doc_id", "body")).dropDuplicates(["row_hash"])
    prints = samples(rows.select("row_hash", "body"), ["row_hash"], "body", k)
    return rows.select("doc_id", "row_hash").join(prints, "row_hash", "left").select("doc_id", printed(F.col("samples")).alias("fingerprint"))


def _in_buckets(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``bucket``, a range of ``place`` with about 1/n of the rows, each with a guard row behind its last row: the
    first row of the next bucket that has rows, after the last bucket of the first. To the driver come n numbers."""
    shares = [i / n for i in range(1, n)]
    cuts = rows.agg(F.percentile_approx("place", shares, 10 * n).alias("c")).first()["c"] if shares else []
    cuts = sorted(set(cuts or []))
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = cuts[::step], [cuts[i:i + step] for i in range(0, len(cuts), step)]
    below = lambda array: F.size(F.filter(array, lambda x: x < F.col("place")))
    if cuts:
        block = below(F.array(*map(F.lit, coarse)))
        inner = F.element_at(F.array(*[F.array(*map(F.lit, f)) for f in fine]), F.greatest(block, F.lit(1)))
        bucket = F.when(block == 0, F.lit(0)).otherwise((block - 1) * step + below(inner))
    else:
        bucket = F.lit(0)
    # never NULL, so that no reader adds a filter and all can share one shuffle
    rows = rows.withColumn("bucket", F.coalesce(bucket.cast("int"), F.lit(0)))
    firsts = sorted((r["bucket"], r["place"]) for r in rows.groupBy("bucket").agg(F.min("place").alias("place")).collect())
    if not firsts:
        return rows.withColumn("guard", F.lit(False))
    follows = [(place, firsts[i - 1][0]) for i, (_, place) in enumerate(firsts)]
    small = rows.sparkSession.createDataFrame(follows, "place long, before int")
    guards = rows.drop("bucket").join(F.broadcast(small), "place").withColumn("bucket", F.coalesce("before", F.lit(0))).drop("before")
    return rows.withColumn("guard", F.lit(False)).unionByName(guards.withColumn("guard", F.lit(True)))


def with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the next row's text, by
    ascending id, then text hash; after the last comes the first. NULL ids come first. NULL text counts as empty. A single row is
    its own next row. ``buckets`` (default: four a shuffle partition) are the ranges of ids within which rows meet their neighbours.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).withColumn(
        "place", F.coalesce("doc_id", F.lit(-(1 << 63))))
    order = Window.partitionBy("bucket").orderBy("guard", "place", "doc_id", "row_hash")
    turn = _in_buckets(rows, n).withColumn("row_hash", F.xxhash64("body"))
    sized = turn.withColumn("n_chars", F.char_length("body").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    seen = sized.select(
        "bucket", F.row_number().over(order).alias("rn"), "doc_id", "guard", "n_chars", "body",
        F.coalesce(F.lead("body").over(order), F.lit("")).alias("after"))
    seen = seen.select(
        "bucket", "rn", "doc_id", "guard", "n_chars", "body",
        F.concat(F.left("body", (F.col("n_chars") - half).cast("int")), F.left("after", half)).alias("edited"))
    both = seen.select("bucket", "rn", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("body").alias("text")),
                                                         F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("x"))
    prints = samples(both.select("bucket", "rn", "x.kind", "x.text"), ["bucket", "rn", "kind"], "text", k)
    prints = prints.groupBy("bucket", "rn").agg(
        F.max(F.when(F.col("kind") == 0, F.col("samples"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("samples"))).alias("edited"))
    info = seen.select("bucket", "rn", "doc_id", "guard", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    joined = info.join(prints, ["bucket", "rn"], "left")
    by_turn = Window.partitionBy("bucket").orderBy("rn")
    out = joined.withColumn("following", F.lead("own").over(by_turn)).where(~F.col("guard"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"),
        printed(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited(read_docs(spark, sf_dir))
