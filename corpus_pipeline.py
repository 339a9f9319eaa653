"""A training-corpus pipeline over ``documents``: each stage's rows are written as Parquet and read again by the next stage.

Every stage but the last returns the columns of ``documents``; each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import exact_dedup, ngram_join, packing, quality, substring_dedup
from plumbline.llm.common import read_docs, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier keeps (operator 9); it is fitted on the labelled ones among ``docs``.

    NULL and empty texts are judged by their form, repeated rows alike; with no labels every document stays; an empty table stays empty.
    Columns keep their names, whatever they are.
    """
    model = quality.train(docs, read_docs(spark, sf_dir, "labels"))
    return quality.kept_documents(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays (operator 2).

    NULL texts count as empty, and empty texts equal each other. Of repeated rows one stays. Columns keep their names, whatever they are.
    """
    return exact_dedup.kept_documents(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays (operator 3).

    Texts without words are in no group and stay; so do rows that repeat the smallest id. Columns keep their names.
    """
    return ngram_join.kept_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier one are cut out of the texts (operator 10); ``n_chars`` follows, if there is such a column.

    The first place by id, NULL ids before all, stays. A document that loses all its words goes; texts without words, NULL among them,
    stay as they are. Columns keep their names, whatever they are.
    """
    return substring_dedup.without_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents left (operator 7): a row for each piece. NULL and empty texts give their end token alone; rows
    repeated are packed as often as they occur; an empty table gives no rows."""
    import public_tokenizers

    return packing.pack(docs, packing.read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality classifier", good_documents), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages), ("packing", packed),
]

#: none: SQL fits no classifier and finds no components
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = read_docs(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "pipeline-" + name.lower().replace(" ", "-"))
    return docs
