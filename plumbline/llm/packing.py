"""Operator 7, packing: token sequences of a fixed length with little padding, by the sum-of-squares rule.

Documents are tokenized where they are read (each distinct word once a task) and packed in the same task, so nothing is
shuffled. A document longer than a sequence gives whole sequences and a rest. A rest goes, whole, to an open sequence: ``levels``
counts the open sequences at each fill level, and the level chosen is the one after which the sum of squared counts is smallest;
an empty level opens a sequence. A full sequence is written out. What is open when the partition ends (or when ``max_open``
sequences are open) is cut anew: its pieces, one after the other, fill whole sequences, and the last tokens go to sequences whose
lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from string import ascii_letters
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import gathered, read_docs
from plumbline.llm.shingles import Hasher, buffers, slices

LENGTH = 4096
#: open sequences a task may hold (two or four bytes a token)
MAX_OPEN = 4096
#: distinct pieces of words a task remembers the ids of
MAX_WORDS = 400_000
MARKS = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
# How the public vocabulary reads a text. Runs of letters, digits, and other signs are cut from each other.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Packs pieces (doc_id, start, ids, doc_tokens) into sequences and yields the rows of sequences that are done."""

    def __init__(self, length: int, first: int, max_open: int = MAX_OPEN):
        self.length, self.next, self.max_open = length, first, max_open
        self.levels = np.zeros(length + 1, np.int64)  # open sequences by fill level; level 0 is a new one, level `length` a full one
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def add(self, piece: tuple) -> Iterator[tuple]:
        size = len(piece[2])
        if not size:
            return
        if size == self.length:
            yield from self._done([piece])
            return
        n = self.levels
        to = n[size:]  # level h goes to level h + size
        # change of the sum of squares: (n[h]-1)^2 - n[h]^2 + (n[h+size]+1)^2 - n[h+size]^2; the ends do not count
        gain = 2 * to + 1
        gain[-1] = 0
        own = gain + 1 - 2 * n[: len(gain)]
        own[n[: len(gain)] == 0] = np.iinfo(np.int64).max
        own[0] = gain[0]
        level = int(own.argmin())
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            window = []
        window.append(piece)
        if level + size == self.length:
            yield from self._done(window)
            return
        self.open.setdefault(level + size, []).append(window)
        self.levels[level + size] += 1
        self.n_open += 1
        if self.n_open >= self.max_open:
            yield from self.closed()

    def closed(self) -> Iterator[tuple]:
        """What is open, cut anew into whole sequences and at last powers of two."""
        pieces = [p for level in sorted(self.open) for window in self.open[level] for p in window]
        self.open, self.n_open = {}, 0
        self.levels[:] = 0
        left, room, window = sum(len(p[2]) for p in pieces), 0, []
        for doc_id, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                if not room:
                    room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
                    left -= room
                part = ids[at:at + room]
                window.append((doc_id, start + at, part, total))
                at += len(part)
                room -= len(part)
                if not room:
                    yield from self._done(window)
                    window = []

    def _done(self, window: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in window:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset
            offset += len(ids)
        self.next += 1


class WordIds:
    """Ids of words; white space ends a token of this vocabulary and letter case does not count, so a text's ids are those of its
    words. Where its rule for cutting words is the known one, marks at a word's ends are pieces of their own, so a word is encoded once
    whatever stands around it. Pieces are remembered until there are ``most``; then those of the last texts stay.
    """

    def __init__(self, tokenizer_json: str, most: int = MAX_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        settings = json.loads(tokenizer_json)
        self.plain, self.most = Tokenizer.from_str(tokenizer_json), most
        self.plain.encode_special_tokens = True  # their strings in a text are ordinary text
        self.known = (settings.get("normalizer"), settings.get("pre_tokenizer")) == (NORMALIZER, PRE_TOKENIZER)
        self.joining = Tokenizer.from_str(tokenizer_json)
        # letters in lower case are one piece and stay as they are: only their bytes are looked up
        self.letters = Tokenizer.from_str(json.dumps(settings | {"normalizer": None, "pre_tokenizer": PRE_TOKENIZER["pretokenizers"][1]})) if self.known else self.joining
        special = [t for t in settings.get("added_tokens", []) if t["special"] and not (t["lstrip"] or t["rstrip"] or t["normalized"])]
        self.between, self.between_id = (special[0]["content"], special[0]["id"]) if special else (None, None)
        self.apart = set("".join(t["content"] for t in settings.get("added_tokens", []))) - set(ascii_letters)
        self._start([], np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _start(self, pieces: list[str], flat: np.ndarray, lengths: np.ndarray) -> None:
        """Piece 0 is the empty one."""
        self.index = {"": 0} | {p: i for i, p in enumerate(pieces, 1)}
        self.flat, self.lengths = flat, np.append(np.int64(0), lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _parts(self, word: str) -> tuple[str, str, str]:
        """Marks before a word, the word, marks behind it, where they are cut there in any case."""
        core = word.strip(MARKS)
        if not self.known or core == word or not core or not (core[0].isalnum() and core[-1].isalnum()):
            return "", word, ""
        at = word.index(core)
        before = word[:at]
        if before.endswith("'"):  # may belong to the letters behind it
            return "", word, ""
        return before, core, word[at + len(core):]

    def _encoded(self, pieces: list[str]) -> None:
        """Remember the ids of new pieces: many at once, a special token between them, and those that hold a sign of such a token alone."""
        routes: dict[str, list[str]] = {"letters": [], "joining": [], "plain": []}
        for p in pieces:
            if self.between and self.known and p.isalpha() and p == p.lower() and (p.isascii() or is_normalized("NFC", p)):
                routes["letters"].append(p)
            else:
                routes["joining" if self.between and self.apart.isdisjoint(p) else "plain"].append(p)
        flat, lengths = [self.flat], [self.lengths]
        for route in ("letters", "joining"):
            own, tokenizer = routes[route], getattr(self, route)
            for i in range(0, len(own), 65536):
                texts = [self.between.join(own[k:min(k + 256, i + 65536)]) for k in range(i, min(i + 65536, len(own)), 256)]
                codes = [np.array([*c.ids, self.between_id], np.uint32) for c in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                ids = np.concatenate(codes)
                flat.append(ids[ids != self.between_id])
                lengths.append(np.diff(np.flatnonzero(ids == self.between_id), prepend=-1) - 1)
        for i in range(0, len(routes["plain"]), 8192):
            found = [c.ids for c in self.plain.encode_batch_fast(routes["plain"][i:i + 8192], add_special_tokens=False)]
            flat.append(np.array([x for f in found for x in f], np.uint32))
            lengths.append(np.array([len(f) for f in found], np.int64))
        self.index.update(zip((p for own in routes.values() for p in own), range(len(self.index), len(self.index) + len(pieces))))
        self.flat, self.lengths = np.concatenate(flat), np.concatenate(lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def words(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each word its number, and for each number start and length in the ids that come last."""
        coded = pa.array(hashes).dictionary_encode()
        numbers = coded.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(coded.dictionary), np.int64)
        first[numbers[::-1]] = np.arange(len(numbers))[::-1]
        whole = data.tobytes().lower()  # of bytes: A-Z only
        parts: list[str] = []
        for a, b in zip(starts[first].tolist(), ends[first].tolist()):
            word = whole[a:b].decode()
            parts += ("", word, "") if word.isalnum() else self._parts(word)
        if len(self.index) > self.most:
            held = [p for p in dict.fromkeys(parts) if p and p in self.index]
            at = np.array([self.index[p] for p in held], np.int64)
            self._start(held, gathered(self.flat, self.starts[at], self.lengths[at]), self.lengths[at])
        self._encoded([p for p in dict.fromkeys(parts) if p not in self.index])
        at = np.array([self.index[p] for p in parts], np.int64)
        flat, lengths = gathered(self.flat, self.starts[at], self.lengths[at]), self.lengths[at].reshape(-1, 3).sum(1)
        return numbers, np.cumsum(lengths) - lengths, lengths, flat


def pack(docs: DataFrame, tokenizer_json: str, end_id: int = 2, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
         max_open: int = MAX_OPEN) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids are followed by ``end_id``, so NULL and empty texts have one token. Rows repeated are packed as often as
    they occur. Sequence ids are unique, not gapless: partition number, then a count.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(tokenizer_json)  # as large as the vocabulary file

    def packed(batches):
        return pieces(batches, WordIds(shared.value), SumOfSquares(length, TaskContext.get().partitionId() << 32, max_open), end_id)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(packed, PIECES)


def pieces(batches: Iterator[pa.RecordBatch], known: WordIds, packer: SumOfSquares, end_id: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``pack`` for batches of ids and texts, some of them at a time."""
    hasher, length = Hasher(), packer.length
    kind = np.uint16 if max(end_id, *known.plain.get_vocab().values()) < 1 << 16 else np.uint32  # what open sequences hold
    for batch in slices(batches, 1):
        data, bounds = buffers(batch.column(1))
        hashes, counts, starts, ends = hasher.placed(data, bounds)
        numbers, at, sizes, flat = known.words(data, hashes, starts, ends)
        rows, last = [], 0
        for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist()):
            own = numbers[last:last + n]
            last += n
            ids = np.append(gathered(flat, at[own], sizes[own]), np.uint32(end_id))
            for start in range(0, len(ids), length):
                rows.extend(packer.add((doc_id, start, ids[start:start + length].astype(kind), len(ids))))
        yield _batch(rows)
    yield _batch(list(packer.closed()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_docs(spark, sf_dir), read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))
