"""Operator 13, secret scan: strings in sensitive places that a primed compressor cannot shorten.

Candidates are the matches of three patterns and, besides, long mixed strings on a line behind a sensitive word. Each one's novelty is
measured: the bytes that zstandard needs more for the text around it and the candidate than for that text alone (every copy of the
candidate is taken out of it first). The compressor is primed with a dictionary of identifiers made of the commonest words of the
whole corpus, joined as code joins them, so names, paths and words cost little, random strings almost their length or more. Matches
of the patterns are always reported; other candidates if they cost ``NOVEL`` bytes a code point or more.

Texts are scanned where they are read. Only counts of words are shuffled, added up in each task first; the dictionary has
``DICTIONARY`` bytes and travels with the tasks.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, read_docs, written

#: bytes of the identifier dictionary, and the words it is made of
DICTIONARY, WORDS = 64 << 10, 16_000
#: code points of text on each side of a candidate that it is measured against
AROUND = 512
#: code points behind a sensitive word in which a candidate starts (on the same line)
REACH = 80
#: shortest candidate beside the patterns, and the bytes a code point from which it is novel: in texts of the sample tables, of random
#: strings of 20 base-64 digits 5 % cost less than 0.9, of identifiers of four words 5 % more than 0.75
LEAST, NOVEL = 16, 0.85
_LEVEL = 3
#: distinct words a task holds before it sends their counts on
_HELD = 400_000

# The kinds of spans in the order they are listed.
KINDS = ["assign", "access", "hex", "novel"]
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a match is the longest run, so its least length may stand in the pattern
_HEX = re.compile(r"[0-9a-f]{24,}")
_SENSITIVE = re.compile(r"(?ai)pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|secret|auth|signing|encryption)[ _-]?key|credential|authorization|bearer")
_STARTS = ("pass", "pwd", "secret", "token", "key", "credential", "authorization", "bearer")
_STRING = re.compile(r"[A-Za-z0-9+/_.=~-]{%d,}" % LEAST)
_MIXED = re.compile(r"[0-9]|[a-z][A-Z]")
_JOINTS = [" ", " ", " ", "_", ".", "/", "-", ""]
_WORD = re.compile(r"\b[^\W\d_]{3,24}\b")
SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,novelty:int>>"


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def identifiers(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> dict[str, int]:
    """The commonest words (3 to 24 letters) of all texts and how often they occur.

    Words are counted as they stand, letter case kept; ties go to the word that sorts first. Words with digits are never taken, so no
    secret of the usual forms primes the compressor against itself.
    """

    def counted(batches):
        found: Counter = Counter()
        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                found.update(_WORD.findall(text or ""))
            if len(found) > _HELD:
                yield _counts(found)
                found = Counter()
        yield _counts(found)

    parts = docs.select(F.col(f"`{text_col}`").alias("t")).mapInArrow(counted, "word string, n long")
    counts = written(parts.groupBy("word").agg(F.sum("n").alias("n")), "op13-words").withColumn("size", F.length(F.bin("n")))
    # words per size of count, some 60 rows: only words of the sizes that hold the commonest ones are sorted
    left, least = words, 1
    for row in counts.groupBy("size").count().orderBy(F.desc("size")).collect():
        least, left = row["size"], left - row["count"]
        if left <= 0:
            break
    top = counts.where(F.col("size") >= least).orderBy(F.desc("n"), "word").limit(words)
    found = {row["word"]: row["n"] for row in top.collect()}  # ``words`` rows at most
    dropped(counts)
    return found


def trained(counts: dict[str, int], size: int = DICTIONARY, lines: int = 4000) -> bytes:
    """A zstandard dictionary, with tables of frequencies, of lines of identifiers: words drawn by their counts and joined in the ways
    of prose and code. The same counts give the same dictionary; too few words give a plain list of them."""
    if not counts:
        return b""
    rng, words = random.Random(13), list(counts)
    shares = list(accumulate(counts.values()))
    samples = []
    for i in range(lines):
        drawn, joint = rng.choices(words, cum_weights=shares, k=40), _JOINTS[i % len(_JOINTS)]
        samples.append((joint.join(drawn) if joint else "".join(w.title() for w in drawn)).encode())
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        listed = " ".join(reversed(words)).encode()
        return listed if len(listed) >= 8 else b""


def _counts(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])


class Scanner:
    """Finds and measures the candidates of a text."""

    def __init__(self, dictionary: bytes, novel: float = NOVEL):
        self.novel = novel
        primed = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if primed:
            primed.precompute_compress(level=_LEVEL)
        self.compressor = zstandard.ZstdCompressor(level=_LEVEL, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def novelty(self, text: str, start: int, end: int) -> int:
        """Compressed bytes that the candidate adds to the text around it."""
        own = text[start:end]
        around = text[max(0, start - AROUND):start].replace(own, "") + text[end:end + AROUND].replace(own, "") + "\n"
        size = lambda t: len(self.compressor.compress(t.encode()))
        return size(around + own) - size(around)

    def base(self, text: str, low: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) of the patterns' matches."""
        found = []
        if "pass" in low or "secret" in low or "token" in low or "api" in low:
            found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        return found

    def candidates(self, text: str, low: str) -> set[tuple[int, int]]:
        """Mixed strings that start within ``REACH`` behind a sensitive word, on its line."""
        found = set()
        if any(word in low for word in _STARTS):
            for m in _SENSITIVE.finditer(text):
                line = text.find("\n", m.end(), m.end() + REACH)
                stop = m.end() + REACH if line < 0 else line
                for s in _STRING.finditer(text, m.end()):
                    if s.start() >= stop:
                        break
                    if _MIXED.search(s[0]):
                        found.add(s.span())
        return found

    def spans(self, text: str | None) -> list[dict]:
        """All spans by start and kind."""
        text = text or ""
        low = text.lower()  # only says where to look
        found = self.base(text, low)
        out = [(a, k, b, self.novelty(text, a, b)) for a, k, b in found]
        for a, b in self.candidates(text, low):
            if not any(a < y and x < b for x, _, y in found):
                cost = self.novelty(text, a, b)
                if cost >= self.novel * (b - a):
                    out.append((a, 3, b, cost))
        return [{"kind": KINDS[k], "start": a, "end": b, "novelty": n} for a, k, b, n in sorted(out)]


def scan(docs: DataFrame, dictionary: bytes, novel: float = NOVEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end, novelty) for each row of ``docs``: places in code points, ends exclusive.

    Matches of one pattern do not overlap each other, those of two may; a ``novel`` span overlaps none of them. NULL and empty
    texts have no spans, texts of any length are scanned whole, repeated rows and NULL ids stay as they are, an empty table gives
    no rows. Other columns are not read, whatever their names.
    """

    def rows(batches):
        scanner = Scanner(dictionary, novel)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.int32())]))
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([scanner.spans(t) for t in batch.column(1).to_pylist()], kind)], ["doc_id", "spans"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("t")).mapInArrow(rows, SPANS)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir)
    found = scan(docs, trained(identifiers(docs)))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(shown(of(*KINDS[:3])), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
