"""Documents as blocks of dictionary codes, for operators that need one answer per distinct word of the whole corpus.

A block is a run of documents of one input partition. Inside it each distinct word gets a number, so a
document is an array of small numbers (its words by position) and the block's distinct words are few. Only those travel: they meet
by word, get their answer once, and the answers return to the block, where a document is put together by position.

Both sides, ``words`` and ``texts``, read the input by themselves; they agree because a file's rows come in one order. Each block
carries a checksum of its dictionary, and ``matched`` fails if the two sides ever differ, so give frames that read files (or
a table of ``common.written``), not the output of a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from plumbline.llm.shingles import Hasher, buffers

#: characters (or bytes) of text before a block is closed; a task holds one block
BLOCK_CHARS = 16_000_000

WORDS = "block long, code int, dictionary long, word binary, n long"
LISTS = "part long, block long, dictionary long, sizes binary, words binary"
TEXTS = "block long, dictionary long, doc_id long, codes binary"


def packed(codes: np.ndarray) -> bytes:
    wide = len(codes) and int(codes.max()) >= 1 << 16
    data = codes.astype("<u4" if wide else "<u2").tobytes()
    return (b"4" if wide else b"2") + len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    whole = pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), "zstd", asbytes=True)
    return np.frombuffer(whole, "<u4" if data[:1] == b"4" else "<u2")


class Block:
    """A dictionary (distinct words by number), how often the counted documents have each, and the documents' codes; ``listed`` ones
    hold the words only, in the order in which they come."""

    def __init__(self, number: int, listed: bool = False):
        self.number, self.size, self.listed = number, 0, listed
        self.index: dict[bytes, int] | list[bytes] = {}
        self.n = np.zeros(1024, np.int64)
        self.ids: list = []
        self.codes: list[np.ndarray] = []

    def add(self, doc_id, words: list[bytes] | list[str], counted: bool, keep: bool) -> None:
        index = self.index
        if self.listed:
            index.update(dict.fromkeys(words))
            return
        codes = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
        if len(index) > len(self.n):
            self.n = np.concatenate([self.n, np.zeros(max(len(index), len(self.n)), np.int64)])
        if counted:
            np.add.at(self.n, codes, 1)
        if keep:
            self.ids.append(doc_id)
            self.codes.append(codes.astype(np.int32))

    def dealt(self, parts: int) -> list[list[bytes]]:
        """The words of each of so many parts of all words (by checksum); codes now follow that order."""
        words = [w.encode() if isinstance(w, str) else w for w in self.index]
        part = np.array([zlib.crc32(w) % parts for w in words], np.int64)
        order = np.argsort(part, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.codes = [rank[c] for c in self.codes]
        self.index = [words[i] for i in order]
        ends = np.cumsum(np.bincount(part, minlength=parts))
        return [self.index[b - n:b] for n, b in zip(np.diff(ends, prepend=0), ends)]

    def checksum(self) -> int:
        crc = 0
        for w in self.index:
            crc = zlib.crc32(w, crc + 1 & 0xFFFFFFFF)
        return crc << 24 | len(self.index) & 0xFFFFFF


def _blocks(batches: Iterator[pa.RecordBatch], split: Callable | bytes, counted: Callable, most: int, keep: bool, listed: bool = False) -> Iterator[Block]:
    """Blocks of a partition. ``split`` cuts a text into words as bytes; bytes instead of a function mean words between
    blanks, A-Z in lower case, and these bytes behind them, which are found for a whole block at once."""
    number = TaskContext.get().partitionId() << 24
    if isinstance(split, bytes):
        hasher = Hasher()
        for batch in batches:
            at, bounds = 0, buffers(batch.column(1))[1]
            while at < batch.num_rows:
                to = min(batch.num_rows, max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1))
                yield _worded(batch.slice(at, to - at), hasher, number, split, counted, keep)
                number, at = number + 1, to
        return
    block = Block(number, listed)
    parts = (batch.slice(at, 256) for batch in batches for at in range(0, batch.num_rows, 256))
    for batch in parts:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            block.add(doc_id, split(text), counted(doc_id), keep)
            block.size += len(text or "") + 8
            if block.size >= most:
                yield block
                block = Block(block.number + 1, listed)
    if block.size:
        yield block


def _worded(batch: pa.RecordBatch, hasher: Hasher, number: int, end: bytes, counted: Callable, keep: bool) -> Block:
    block, ids = Block(number), batch.column(0).to_pylist()
    data, bounds = buffers(batch.column(1))
    hashes, counts, starts, ends = hasher.placed(data, bounds)
    coded = pa.array(hashes).dictionary_encode()  # numbers words as they come; np.unique would sort them all
    distinct, codes = coded.dictionary, coded.indices.to_numpy()
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    whole = data.tobytes()
    block.index = [whole[a:b].lower() for a, b in zip(starts[first].tolist(), ends[first].tolist())] + [end]
    learned = np.array([counted(i) for i in ids], bool)
    block.n = np.append(np.bincount(codes[np.repeat(learned, counts)], minlength=len(distinct)), learned.sum())
    if keep:
        last = np.cumsum(counts)
        block.ids = ids
        block.codes = [np.append(codes[b - n:b], len(distinct)) for n, b in zip(counts.tolist(), last.tolist())]
    return block


def words(docs: DataFrame, split: Callable[[str | None], list[bytes]] | bytes, counted: Callable = lambda i: False, most: int = BLOCK_CHARS) -> DataFrame:
    """A row for each distinct word of each block; n counts it in the documents that ``counted`` accepts."""

    def rows(batches):
        for block in _blocks(batches, split, counted, most, False):
            index, crc = list(block.index), block.checksum()
            for i in range(0, len(index), 65536):
                part = index[i:i + 65536]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(part), block.number)), pa.array(np.arange(i, i + len(part), dtype=np.int32)),
                    pa.array(np.full(len(part), crc)), pa.array(part, pa.binary()), pa.array(block.n[i:i + len(part)])],
                    ["block", "code", "dictionary", "word", "n"])

    return docs.mapInArrow(rows, WORDS)


def word_lists(docs: DataFrame, split: Callable[[str | None], list[str]], parts: int, most: int = BLOCK_CHARS) -> DataFrame:
    """A row for each block and part of all words: the block's words in that part, packed. Far smaller than ``words``. Here and in
    ``texts`` with parts, ``split`` gives text; a block's distinct words become bytes."""

    def rows(batches):
        for block in _blocks(batches, split, lambda i: False, most, False, True):
            lists, crc = block.dealt(parts), block.checksum()
            out = [(p, block.number, crc, *packed_pieces(own)) for p, own in enumerate(lists) if own]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in LISTS.split(", ")])

    return docs.mapInArrow(rows, LISTS)


def packed_pieces(pieces: list[bytes]) -> tuple[bytes, bytes]:
    """Sizes and bytes of a list, compressed."""
    return packed(np.array([len(x) for x in pieces], np.int64)), zlib.compress(b"".join(pieces), 1)


def unpacked_pieces(sizes: bytes, data: bytes) -> list[bytes]:
    whole, ends = zlib.decompress(data), np.cumsum(unpacked(sizes).astype(np.int64)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def texts(docs: DataFrame, split: Callable[[str | None], list[str]] | bytes, most: int = BLOCK_CHARS, parts: int | None = None) -> DataFrame:
    """A row for each document: its block and its words as codes of the block's dictionary (in the order of ``word_lists`` with
    so many parts)."""

    def rows(batches):
        for block in _blocks(batches, split, lambda i: False, most, True):
            if parts:
                block.dealt(parts)
            crc = block.checksum()
            for i in range(0, len(block.ids), 1024):
                part = block.ids[i:i + 1024]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(part), block.number)), pa.array(np.full(len(part), crc)), pa.array(part, pa.int64()),
                    pa.array([packed(c) for c in block.codes[i:i + 1024]], pa.binary())], ["block", "dictionary", "doc_id", "codes"])

    return docs.mapInArrow(rows, TEXTS)


def checked(texts_table: pa.Table, answers: pa.Table, n: int) -> None:
    """Fail if the answers (for n words) are not those of the block's dictionary."""
    if texts_table.num_rows:
        crc = texts_table.column("dictionary")[0].as_py()
        if n & 0xFFFFFF != crc & 0xFFFFFF or n and set(answers.column("dictionary").unique().to_pylist()) != {crc}:
            raise RuntimeError("the input gave other rows when it was read again; write it to a table first")


def in_order(texts_table: pa.Table, answers: pa.Table) -> pa.Table:
    """The answers sorted by code, after a check that they are those of the block's dictionary."""
    checked(texts_table, answers, answers.num_rows)
    return answers.take(pa.array(np.argsort(answers.column("code").to_numpy(), kind="stable")))


def matched(texts_frame: DataFrame, answers: DataFrame, joined: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``joined(texts, answers by code)`` for each block; answers has block, code, dictionary and what ``joined`` needs."""

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        return joined(left, in_order(left, right))

    return texts_frame.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(block, schema)
