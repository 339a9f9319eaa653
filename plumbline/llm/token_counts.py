"""Operator 1, token counts: how many pieces of a unigram vocabulary the best segmentation of each text has.

The best segmentation of a word is found by dynamic programming over its prefixes: the forward score of a prefix is the best sum
of piece scores that spells it. Words with a common prefix share that work: the distinct pre-tokens of a batch go into a trie, each
of whose nodes gets its forward score once, from the nodes above it, and the node where a word ends gives the word's count. The trie
is walked depth first, which is the sorted order of its words, so only the branch being walked is held, not the nodes. A document's
count is the sum over its pre-tokens. No piece crosses from a word into the blank before the next one, so the sum is the count of the
whole text. A character no piece spells costs one token per UTF-8 byte.

Nothing is shuffled. A task holds the distinct words of a batch.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read_docs

BLANK = "▁"
#: below every piece's score by this much: a character spelled in bytes, as the public unigram encoder scores it
UNKNOWN = 10.0


def read_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a model file, without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): model.get_score(i) for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


class CountTrie:
    """Token counts of words by a depth-first walk of their trie."""

    def __init__(self, pieces: dict[str, float]):
        #: every end of a piece: its score if it is a piece itself, else None. A text that ends no piece ends no longer one either
        self.ends: dict[str, float | None] = {p[i:]: None for p in pieces for i in range(1, len(p))}
        self.ends |= pieces
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN

    def counts(self, words: list[str]) -> list[int]:
        """The counts of sorted words."""
        ends, unknown, no_end = self.ends, self.unknown, object()
        best, count = [0.0], [0]  # of the nodes from the root to where the walk is
        out, before = [], ""
        for word in words:
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del best[shared + 1:], count[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                own = ends.get(char, no_end)
                if own is None or own is no_end:
                    score, tokens = best[-1] + unknown, count[-1] + len(char.encode())
                else:
                    score, tokens = best[-1] + own, count[-1] + 1
                if own is not no_end:
                    # shorter pieces first, and >=: of equal scores the longest last piece stands
                    for start in range(end - 2, -1, -1):
                        own = ends.get(word[start:end], no_end)
                        if own is not None:
                            if own is no_end:
                                break
                            if best[start] + own >= score:
                                score, tokens = best[start] + own, count[start] + 1
                best.append(score)
                count.append(tokens)
            out.append(count[-1])
            before = word
        return out


def pre_tokens(text: str | None) -> list[str]:
    """Runs of blanks with the word behind them; a blank stands before the first word; line breaks stand alone."""
    return re.findall(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+", BLANK + text.replace(" ", BLANK)) if text else []


def token_counts(docs: DataFrame, pieces: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_pre_tokens for each row of ``docs``; NULL and empty texts have none.

    Rows repeated and NULL ids stay as they are, words of any length are counted whole, an empty table gives no rows; other columns are
    not read, whatever their names. ``pieces`` must hold none that has a blank or line break behind another character.
    """
    if any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces):
        raise ValueError("a piece crosses from one word into the next")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)

    def counted(batches):
        trie = CountTrie(shared.value)
        for batch in batches:
            numbers: dict[str, int] = {}  # the batch's distinct words
            codes = [np.array([numbers.setdefault(w, len(numbers)) for w in pre_tokens(t)], np.int32) for t in batch.column(1).to_pylist()]
            words = sorted(numbers)
            counts = np.zeros(len(words), np.int64)
            counts[[numbers[w] for w in words]] = trie.counts(words)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([int(counts[c].sum()) for c in codes], pa.int64()), pa.array([len(c) for c in codes], pa.int64())],
                ["doc_id", "n_tokens", "n_pre_tokens"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(counted, "doc_id long, n_tokens long, n_pre_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_docs(spark, sf_dir), read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
