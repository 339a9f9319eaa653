"""Operator 6, byte-level BPE encoding and decoding.

Texts are cut into pre-tokens by the tokenizer's pattern. Pre-tokens leave a block of documents once each, in packed lists by part of
all words (``blocks``); a part meets over the whole corpus, each distinct word in it is encoded once, and its ids go back to every
block that has it, where a document's ids are put together by position. Decoding joins the table of token bytes.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import blocks
from plumbline.llm.common import gathered, read_docs


#: characters of text for one part of all words
PART_CHARS = 20_000_000
#: characters of text in a block; a task holds one block, its ids and its decoded bytes
BLOCK_CHARS = 8_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) for each row of ``docs``.

    NULL text counts as empty and gives no ids. Rows repeated and NULL ids stay as they are, pre-tokens of any length are encoded whole, an
    empty table gives no rows; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # as large as the vocabulary file
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))

    def pre_tokens(text):
        import regex

        return regex.findall(pattern, text) if text else []

    def encoded(table: pa.Table) -> pa.Table:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        known: dict[bytes, bytes] = {}  # each word of this part of all words once
        out = []
        for sizes, words in zip(table.column("sizes").to_pylist(), table.column("words").to_pylist()):
            ids = []
            for word in blocks.unpacked_pieces(sizes, words):
                if word not in known:
                    known[word] = np.array(own.encode_ordinary(word.decode()), "<u4").tobytes()
                ids.append(known[word])
            out.append((blocks.packed(np.array([len(x) // 4 for x in ids], np.int64)), blocks.packed(np.frombuffer(b"".join(ids), "<u4"))))
        return pa.table([table.column("part"), table.column("block"), table.column("dictionary"), pa.array([o[0] for o in out], pa.binary()),
                         pa.array([o[1] for o in out], pa.binary())], [c.split()[0] for c in answer.split(", ")])

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("part").to_numpy())
        take = lambda name: [x for i in order for x in [right.column(name)[int(i)].as_py()]]
        none = np.zeros(0, np.int64)
        lengths = np.concatenate([none, *[blocks.unpacked(x).astype(np.int64) for x in take("lengths")]])
        flat = np.concatenate([none.astype("<u4"), *[blocks.unpacked(x).astype("<u4") for x in take("ids")]])
        blocks.checked(left, right, len(lengths))
        starts = np.cumsum(lengths) - lengths
        out = []
        for codes in left.column("codes").to_pylist():
            codes = blocks.unpacked(codes)
            out.append(gathered(flat, starts[codes], lengths[codes]).tobytes() if len(codes) else b"")
        return pa.table([left.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "ids"])

    answer = "part long, block long, dictionary long, lengths binary, ids binary"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((rows.agg(F.sum(F.char_length(text_col))).first()[0] or 0) / PART_CHARS))
    answers = blocks.word_lists(rows, pre_tokens, parts, BLOCK_CHARS).groupBy("part").applyInArrow(encoded, answer)
    own = blocks.texts(rows, pre_tokens, BLOCK_CHARS, parts)
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(put_together, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """All columns of ``encoded`` and ``bytes``: its ids joined with the table of token bytes, in order.

    A column that is called ``bytes`` already gives way. NULL ids decode to nothing; rows repeated stay; an empty table gives no rows.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    encoded = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != "bytes"])
    at = encoded.columns.index("ids")

    def decoded(batches):
        table = [b""] * (max(shared.value.values(), default=-1) + 1)
        for token, rank in shared.value.items():
            table[rank] = token
        flat = np.frombuffer(b"".join(table), np.uint8)
        lengths = np.array([len(t) for t in table], np.int64)
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            out = []
            for ids in batch.column(at).to_pylist():
                ids = np.frombuffer(ids or b"", "<u4")
                out.append(gathered(flat, starts[ids], lengths[ids]).tobytes() if len(ids) else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "bytes"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(decoded, f"{kinds}, bytes binary")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = encode(read_docs(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return decode(ids, ranks).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
