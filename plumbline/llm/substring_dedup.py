"""Operator 10, substring dedup: passages that repeat, across documents or within one.

Paragraphs (lines of ``MIN_WORDS`` words or more) are sets of word shingles. Their MinHash values, ``ROWS`` to a band, give ``BANDS``
keys: a pair at the threshold of 0.75 shares one with probability 1 - (1 - 0.75^ROWS)^BANDS = 0.997. Paragraphs with equal sets are
one node; ``linking`` compares nodes that collide by their exact Jaccard similarity; of each component the first paragraph stays.

A passage need not be a line of its own: it may stand in the middle of a longer line or run over several short ones. So each text also
gives windows of ``WINDOW`` words that start where the text's own words say (``shingles.windows``): two documents that share 50 words
in a row share a window. These are seeds: around those that occur twice every window is looked up by its key, so a passage is found
from its first word to its last. Windows travel as packed lists, each block of texts naming a key once, and meet by range of keys; what
returns to the block says which occur elsewhere and who keeps them.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import mixed, read_docs, written
from plumbline.llm.linking import linked
from plumbline.llm.shingles import WORDS_A_SHINGLE, Hasher, buffers, from_bytes, slices, to_bytes, window_hashes, windows, word_runs

PERCENT, MIN_WORDS = 75, 40
BANDS, ROWS = 15, 4
#: words of a window, and shingles among which a window's start is the smallest: together 50 words
WINDOW, REACH = 25, 26
#: bytes of text whose windows are dealt out together
PIECE_BYTES = 4_000_000
#: characters of text to a part of all windows
PART_CHARS = 8_000_000
_KINDS = {"doc_id": pa.int64(), "row_hash": pa.int64(), "paragraph": pa.int32(), "start": pa.int64(), "n_chars": pa.int32(),
          "n_words": pa.int32(), "node": pa.int64(), "n": pa.int32()}


def _multipliers(k: int) -> np.ndarray:
    return mixed(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_keys(flat: np.ndarray, sizes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """For each set (not empty; ``sizes`` of them, one after the other) the keys of its bands, as 64-bit numbers."""
    at = np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), bands), np.uint64)
    for i, m in enumerate(_multipliers(bands * rows)):
        turned = (flat ^ m) * m
        least = np.minimum.reduceat(turned ^ (turned >> np.uint64(32)), at)
        out[:, i // rows] = mixed(out[:, i // rows] + least + np.uint64(i))
    return out


def _paragraphs(column: pa.Array, hasher: Hasher, min_words: int, words: int):
    """Row, number, first byte, last byte, number of words of each long enough line, then their shingle sets and the sets' sizes."""
    data, bounds = buffers(column)
    breaks = np.flatnonzero(data == 10)
    of_break = np.searchsorted(bounds, breaks, "right") - 1
    lines = np.bincount(of_break, minlength=len(column)) + 1
    first = np.cumsum(lines) - lines
    row = np.repeat(np.arange(len(column)), lines)
    number = np.arange(len(row)) - np.repeat(first, lines)
    stop = np.empty(len(row), np.int64)
    last = first + lines - 1
    stop[last] = bounds[1:]
    inner = np.ones(len(row), bool)
    inner[last] = False
    stop[inner] = breaks
    start = np.empty(len(row), np.int64)
    start[1:] = stop[:-1] + 1
    start[first] = bounds[:-1]
    # segments for the hasher: each line, with its break as a blank at the end
    flat, sizes, counts = hasher.sets(data, np.append(start, len(data)), words, min_words)
    long = counts >= max(1, min_words)
    return data, row[long], number[long], start[long], stop[long], counts[long], flat, sizes[long], bounds


def _nodes(flat: np.ndarray, sizes: np.ndarray) -> list[int]:
    ends = np.cumsum(sizes)
    return [int.from_bytes(hashlib.blake2b(flat[e - n:e].tobytes(), digest_size=8).digest(), "little", signed=True) for n, e in zip(sizes, ends)]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row_hash"), text.alias("text"))


def repeated_paragraphs(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, words: int = WORDS_A_SHINGLE, bands: int = BANDS,
                        rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph that has a near copy: doc_id, row_hash, paragraph (number of the line, from 0), start and n_chars (code
    points), n_words, group_size (paragraphs), keep_id and keep_paragraph (the one that stays: the first by id and paragraph; NULL
    ids come first), kept.

    Documents without such a paragraph (NULL and empty texts among them) have no row. Rows repeated are copies of each other.
    """
    source = _rows(docs, id_col, text_col)

    def signed(batches):
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                data, row, number, start, stop, counts, flat, sizes, bounds = _paragraphs(part.column(2), hasher, min_words, words)
                if not len(row):
                    continue
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                take = pa.array(row)
                columns = [part.column(0).take(take), part.column(1).take(take)] + [pa.array(c, kind) for c, kind in zip(
                    (number, points[start] - points[bounds[row]], points[stop] - points[start], counts, _nodes(flat, sizes), sizes),
                    list(_KINDS.values())[2:])]
                keys = band_keys(flat, sizes, bands, rows)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([k.tobytes() for k in keys], pa.binary())], [*_KINDS, "bands"])

    paragraphs = written(source.mapInArrow(
        signed, "doc_id long, row_hash long, paragraph int, start long, n_chars int, n_words int, node long, n int, bands binary"), "op10-paragraphs")

    def posted(batches):
        seen: set[int] = set()  # a task posts a node once, however many copies of a paragraph it has
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            new = []
            for i, node in enumerate(nodes):
                if node not in seen:
                    seen.add(node)
                    new.append(i)
            part = batch.take(pa.array(new, pa.int64()))
            keys = [np.frombuffer(k, "<i8") for k in part.column(2).to_pylist()]
            lengths = [len(k) for k in keys]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), lengths)),
                pa.array(np.repeat(part.column(1).to_numpy(), lengths))], ["key", "node", "n"])

    # copies of a paragraph are one node; its postings meet by key, where those of several tasks become one
    postings = paragraphs.select("node", "n", "bands").mapInArrow(posted, "key long, node long, n int").repartition("key").distinct()

    def grams(batches):
        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                *_, flat, sizes, _ = _paragraphs(batch.slice(at, 512).column(0), hasher, min_words, words)
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    pa.array(_nodes(flat, sizes), pa.int64()), pa.array(sizes.astype(np.int32)),
                    pa.array([to_bytes(flat[e - n:e]) for n, e in zip(sizes, ends)], pa.binary())], ["node", "n", "grams"])

    def sets_of(nodes: DataFrame) -> DataFrame:
        every = source.select("text").mapInArrow(grams, "node long, n int, grams binary")
        return written(every.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "op10-sets")

    def index(others: list[tuple]):
        flat = from_bytes(b"".join(g for _, _, g in others))
        lengths = np.array([m for _, m, _ in others], np.int64)
        owners = np.repeat(np.arange(len(others)), lengths)

        def search(row: tuple) -> list[int]:
            own = np.sort(from_bytes(row[2]))
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            overlap = np.bincount(owners, own[place] == flat, len(others)).astype(np.int64)
            return np.flatnonzero(100 * overlap >= percent * (len(own) + lengths - overlap)).tolist()

        return search

    comps = linked(postings, sets_of, index, percent / 100)
    members = paragraphs.drop("bands", "n").join(comps, "node", "left").withColumn("root", F.coalesce("comp", "node"))
    groups = members.groupBy("root").agg(
        F.count("*").alias("group_size"), F.min(F.struct("doc_id", "paragraph", "row_hash")).alias("first")).where("group_size > 1")
    out = members.join(groups, "root")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("paragraph") == F.col("first.paragraph")) & (F.col("row_hash") == F.col("first.row_hash"))
    return out.select("doc_id", "row_hash", "paragraph", "start", "n_chars", "n_words", "group_size", F.col("first.doc_id").alias("keep_id"),
                      F.col("first.paragraph").alias("keep_paragraph"), kept.alias("kept"))


def _pieces(batches, hasher: Hasher):
    """Rows of ``_rows`` in pieces of some ``PIECE_BYTES`` of text, and their words: (rows, bytes, bounds, hashes, counts, starts, ends)."""
    for rows in slices(batches, 2, PIECE_BYTES):
        data, bounds = buffers(rows.column(2))
        yield rows, data, bounds, *hasher.placed(data, bounds)


def _seeds(hashes: np.ndarray, counts: np.ndarray, window: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place among all words of the piece, and hash of each text's sampled windows."""
    row, at, keys, last = [], [], [], 0
    for i, n in enumerate(counts.tolist()):
        places, own = windows(hashes[last:last + n], window, reach, every=True)
        row.append(np.full(len(places), i))
        at.append(places + last)
        keys.append(own)
        last += n
    return np.concatenate(row), np.concatenate(at), np.concatenate(keys)


def _dealt(keys: np.ndarray, parts: int) -> np.ndarray:
    """Part of all keys that each belongs to; it grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _marks(keys: np.ndarray) -> np.ndarray:
    """Four of 64 bits."""
    out = np.zeros(len(keys), np.uint64)
    for shift in (24, 30, 36, 42):
        out |= np.uint64(1) << (keys >> np.uint64(shift) & np.uint64(63))
    return out


class _Filter:
    """A Bloom filter of keys, some 16 bits a key, by part; it may accept other keys too, but refuses none of its own."""

    def __init__(self, slices: dict[int, bytes], parts: int):
        words = [np.frombuffer(slices.get(p, bytes(8)), "<u8") for p in range(parts)]
        self.sizes = np.array([len(w) for w in words], np.uint64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bits = np.concatenate(words)

    @staticmethod
    def slice(keys: np.ndarray) -> bytes:
        words = np.zeros(1 << max(0, (len(keys) // 4).bit_length()), np.uint64)
        np.bitwise_or.at(words, keys & np.uint64(len(words) - 1), _marks(keys))
        return words.astype("<u8").tobytes()

    def accepts(self, keys: np.ndarray) -> np.ndarray:
        part, marks = _dealt(keys, len(self.sizes)), _marks(keys)
        return self.bits[self.starts[part] + (keys & (self.sizes[part] - np.uint64(1)))] & marks == marks


def _shared_seeds(source: DataFrame, window: int, reach: int, parts: int) -> _Filter:
    """Sampled windows that occur twice or more."""

    def sampled(batches):
        hasher = Hasher()
        for _, _, _, hashes, counts, *_ in _pieces(batches, hasher):
            keys, n = np.unique(_seeds(hashes, counts, window, reach)[2], return_counts=True)
            keys = np.repeat(keys, np.minimum(n, 2))
            cuts = np.searchsorted(_dealt(keys, parts), np.arange(parts + 1))
            own = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([keys[cuts[p]:cuts[p + 1]].tobytes() for p in own], pa.binary())], ["part", "keys"])

    def met(table: pa.Table) -> pa.Table:
        keys, n = np.unique(np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint64), return_counts=True)
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([_Filter.slice(keys[n > 1])], pa.binary())})

    slices = source.mapInArrow(sampled, "part long, keys binary").groupBy("part").applyInArrow(met, "part long, bits binary").collect()
    return _Filter({r.part: bytes(r.bits) for r in slices}, parts)


def _packed(values: np.ndarray, kind: str) -> bytes:
    """Numbers as their differences, compressed."""
    return zlib.compress(np.diff(values.astype(kind), prepend=values.astype(kind)[:0].dtype.type(0)).astype(kind).tobytes(), 1)


def _unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), kind), dtype=kind)


def _runs(doc: np.ndarray, word: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each row of windows that overlap or touch, in order of document and word."""
    opens = np.ones(len(doc), bool)
    opens[1:] = (doc[1:] != doc[:-1]) | (word[1:] > word[:-1] + window)
    first = np.flatnonzero(opens)
    return first, np.append(first[1:], len(doc)) - 1


_PLACED = "block long, part int, base long, keys binary, n binary, doc binary, word binary, place binary, hash binary, start binary, stop binary, none binary"


def repeated_passages(docs: DataFrame, window: int = WINDOW, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run of words that stand elsewhere too: doc_id, row_hash, start and n_chars (code points), n_words, group_size
    (occurrences of a part of it, at most), keep_id (the smallest id among them), kept (it is this document's).

    A run is a union of windows: each ``window`` words in a row of it occur elsewhere, and the first occurrence, by id, text hash and
    word, stays. Around a seed that two texts share, runs are whole: every window up to ``reach`` words from a seed is looked up by
    key, and two seeds of a common run are no further apart. Inside one text, windows that overlap the first occurrence are neither kept
    nor dropped, and words that only go on repeating themselves (each window overlaps its copy) are dropped from ``window + reach - 1`` words
    on, the length from which runs are found for certain. Rows repeated with one id and one text are one document; NULL ids come first.
    """
    source, spark = _rows(docs, id_col, text_col), docs.sparkSession
    chars = source.agg(F.sum(F.char_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    shared = spark.sparkContext.broadcast(_shared_seeds(source, window, reach, parts).__dict__)

    def placed(batches):
        hasher, seeds = Hasher(), _Filter({}, 1)
        seeds.__dict__.update(shared.value)
        block = TaskContext.get().partitionId() << 24
        for rows, data, bounds, hashes, counts, starts, ends in _pieces(batches, hasher):
            row, at, keys = _seeds(hashes, counts, window, reach)
            hit = seeds.accepts(keys)
            row, at, first = row[hit], at[hit], np.cumsum(counts) - counts
            change = np.bincount(np.maximum(at - reach, first[row]), minlength=len(hashes) + 1)
            change -= np.bincount(np.minimum(at + reach + 1, first[row] + counts[row] - window + 1), minlength=len(hashes) + 1)
            at = np.flatnonzero(np.cumsum(change) > 0)
            if not len(at):
                continue
            doc = np.searchsorted(first + counts, at, "right")
            used, doc = np.unique(doc, return_inverse=True)
            first = first[used]
            place = rows.column(0).take(pa.array(used))
            none = place.is_null().to_numpy(zero_copy_only=False)
            place, hashed = place.fill_null(-(1 << 63)).to_numpy(), rows.column(1).take(pa.array(used)).to_numpy()
            rank = np.unique(np.stack([place, hashed], 1), axis=0, return_inverse=True)[1].reshape(-1)
            word = at - first[doc]
            own = window_hashes(word_runs(hashes), at, window)
            order = np.lexsort((word, rank[doc], own))
            a, b = order[1:], order[:-1]
            new = np.append(True, own[a] != own[b])
            other = ~new & np.append(False, (rank[doc[a]] != rank[doc[b]]) | (word[a] != word[b]))
            lead, number = order[new], np.empty(len(at), np.int64)
            number[order] = np.cumsum(new) - 1
            n = np.bincount(number) * 2 + (np.bincount(number[order], other) > 0)  # occurrences, and whether they are at two places
            points = np.zeros(len(data) + 1, np.int32)
            np.cumsum((data & 0xC0) != 0x80, dtype=np.int32, out=points[1:])
            zero = points[bounds[used]][doc]
            lines = [(block, -1, 0, number.astype("<u4").tobytes(), b"", _packed(doc, "<i4"), _packed(word, "<i4"), place.tobytes(), hashed.tobytes(),
                      _packed(points[starts[at]] - zero, "<i4"), _packed(points[ends[at + window - 1]] - zero, "<i4"), none.tobytes())]
            del points, zero, data, starts, ends, hashes, change
            cuts = np.searchsorted(_dealt(own[lead], parts), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                mine = lead[cuts[p]:cuts[p + 1]]
                named, inner = np.unique(doc[mine], return_inverse=True)
                lines.append((block, p, cuts[p], own[mine].tobytes(), _packed(n[cuts[p]:cuts[p + 1]], "<i4"), _packed(inner, "<i4"), _packed(word[mine], "<i4"),
                              place[named].tobytes(), hashed[named].tobytes(), b"", b"", b""))
            kinds = (pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 9)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*lines), kinds)], [c.split()[0] for c in _PLACED.split(", ")])
            block += 1

    every = written(source.mapInArrow(placed, _PLACED), "op10-windows")

    def decided(table: pa.Table) -> pa.Table:
        """For each block the keys that occur at two places: whether the first is its own, the first one's id, the occurrences."""
        lists = table.to_pylist()
        keys = [np.frombuffer(x["keys"], np.uint64) for x in lists]
        doc = [_unpacked(x["doc"], "<i4") for x in lists]
        place = np.concatenate([np.frombuffer(x["place"], "<i8")[d] for x, d in zip(lists, doc)])
        hashed = np.concatenate([np.frombuffer(x["hash"], "<i8")[d] for x, d in zip(lists, doc)])
        word, n = (np.concatenate([_unpacked(x[c], "<i4") for x in lists]) for c in ("word", "n"))
        lengths, flat = [len(k) for k in keys], np.concatenate(keys)
        order = np.lexsort((word, hashed, place, flat))
        new = np.append(True, flat[order[1:]] != flat[order[:-1]])
        group = np.empty(len(flat), np.int64)
        group[order] = np.cumsum(new) - 1
        lead = order[new][group]
        first = (place == place[lead]) & (hashed == hashed[lead]) & (word == word[lead])
        twice = (np.bincount(group, ~first | (n % 2 == 1)) > 0)[group]
        size = np.bincount(group, n // 2).astype(np.int64)[group]
        out, end = [], 0
        for x, length in zip(lists, lengths):
            at = np.flatnonzero(twice[end:end + length])
            far = at + end
            names, name = np.unique(place[lead[far]], return_inverse=True)
            out.append((x["block"], _packed(at + x["base"], "<i8"), np.packbits(first[far]).tobytes(), names.tobytes(), _packed(name, "<i4"), _packed(size[far], "<i8")))
            end += length
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), *[pa.binary()] * 5))], ["block", "at", "first", "names", "name", "size"])

    answers = every.where("part >= 0").groupBy("part").applyInArrow(decided, "block long, at binary, first binary, names binary, name binary, size binary")
    kinds = {"doc_id": pa.int64(), "row_hash": pa.int64(), "start": pa.int64(), "n_chars": pa.int32(), "n_words": pa.int32(), "group_size": pa.int64(),
             "keep_id": pa.int64(), "kept": pa.bool_()}

    def joined(own: pa.Table, found: pa.Table) -> pa.Table:
        x = own.to_pylist()[0]
        number = np.frombuffer(x["keys"], "<u4").astype(np.int64)
        doc, word, start, stop = (_unpacked(x[c], "<i4") for c in ("doc", "word", "start", "stop"))
        place, hashed, none = np.frombuffer(x["place"], "<i8"), np.frombuffer(x["hash"], "<i8"), np.frombuffer(x["none"], bool)
        twice, mine, low, size = np.zeros(number.max() + 1, bool), np.zeros(number.max() + 1, bool), np.zeros(number.max() + 1, np.int64), np.zeros(number.max() + 1, np.int64)
        for y in found.to_pylist():
            at = _unpacked(y["at"], "<i8")
            twice[at], size[at] = True, _unpacked(y["size"], "<i8")
            mine[at] = np.unpackbits(np.frombuffer(y["first"], np.uint8), count=len(at))
            low[at] = np.frombuffer(y["names"], "<i8")[_unpacked(y["name"], "<i4")]
        rank = np.unique(np.stack([place, hashed], 1), axis=0, return_inverse=True)[1].reshape(-1)[doc]
        order = np.lexsort((word, rank, number))
        lead = order[np.append(True, number[order[1:]] != number[order[:-1]])][number]
        near = mine[number] & (rank == rank[lead])
        kept = near & (word == word[lead])
        order = np.lexsort((word, doc, number))
        c, d = order[1:], order[:-1]
        overlaps = np.zeros(len(doc), bool)  # the same window in the same text, less than its length before
        overlaps[c] = (number[c] == number[d]) & (doc[c] == doc[d]) & (word[c] < word[d] + window)
        dropped = np.flatnonzero(twice[number] & ~kept & ~(near & (word < word[lead] + window)))
        if len(dropped):
            a, b = _runs(doc[dropped], word[dropped], window)
            over = np.logical_and.reduceat((near & overlaps)[dropped], a) & (word[dropped[b]] - word[dropped[a]] < reach - 1)
            dropped = dropped[~np.repeat(over, b - a + 1)]
        local = np.bincount(number)
        others = (size > local) | (np.bincount(number[dropped], minlength=len(local)) > 0)
        parts = []
        for value, at in ((True, np.flatnonzero(kept & twice[number] & others[number])), (False, dropped)):
            if not len(at):
                continue
            a, b = _runs(doc[at], word[at], window)
            begin, end, d = at[a], at[b], doc[at[a]]
            least, most = np.minimum.reduceat(low[number[at]], a), np.maximum.reduceat(size[number[at]], a)
            parts.append(pa.table([pa.array(c, k) for c, k in zip((
                pa.array(place[d], mask=none[d]), hashed[d], start[begin], stop[end] - start[begin], word[end] + window - word[begin], most,
                pa.array(least, mask=least == -(1 << 63)), np.full(len(d), value)), kinds.values())], list(kinds)))
        return pa.concat_tables(parts) if parts else pa.schema(kinds.items()).empty_table()

    runs = every.where("part < 0").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        joined, "doc_id long, row_hash long, start long, n_chars int, n_words int, group_size long, keep_id long, kept boolean")
    return runs.distinct()  # rows repeated give theirs once


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``repeated_paragraphs`` and, with NULL as paragraph, ``repeated_passages``."""
    lines = repeated_paragraphs(docs, id_col=id_col, text_col=text_col, **options)
    return lines.unionByName(repeated_passages(docs, id_col=id_col, text_col=text_col), allowMissingColumns=True)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """``docs`` with the repeats that are not kept taken out of ``text_col`` (a paragraph with its line break); all columns as they
    were, but for ``length_col``, the text's code points, if named. Documents that lost all their words go."""
    stop = F.col("start") + F.col("n_chars") + F.when(F.col("paragraph").isNotNull(), 1).otherwise(0)
    gone = repeats(docs, id_col=id_col, text_col=text_col, **options).where(~F.col("kept")).groupBy("doc_id", "row_hash").agg(
        F.array_sort(F.collect_set(F.struct(F.col("start"), stop.alias("stop")))).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("row_hash").alias("g_hash"), F.col("gone.start").alias("g_starts"), F.col("gone.stop").alias("g_stops"))
    # the row travels as one struct, so its columns may have any names
    ident, text = F.col(f"`{id_col}`").cast("long"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.select(F.struct("*").alias("row"), ident.alias("own_id"), F.xxhash64(ident, text).alias("own_hash"))
    joined = own.join(gone, (F.col("own_hash") == F.col("g_hash")) & F.col("own_id").eqNullSafe(F.col("g_id")), "left")
    names = docs.columns
    joined = joined.select(*[F.col(f"row.`{c}`").alias(f"c_{i}") for i, c in enumerate(names)], "g_starts", "g_stops")
    at, sized = docs.columns.index(text_col), docs.columns.index(length_col) if length_col else None

    def cut(batches):
        for batch in slices(batches, at):
            texts, starts, stops = (batch.column(i).to_pylist() for i in (at, batch.num_columns - 2, batch.num_columns - 1))
            left = [_left(t, a, b) if a else t for t, a, b in zip(texts, starts, stops)]
            columns = list(batch.columns[:-2])
            columns[at] = pa.array(left, pa.string())
            if sized is not None:
                lengths = [len(t) if a else n for t, a, n in zip(left, starts, columns[sized].to_pylist())]
                columns[sized] = pa.array(lengths, columns[sized].type)
            keep = pa.array([not a or bool(t.strip()) for t, a in zip(left, starts)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names).filter(keep)

    return joined.mapInArrow(cut, docs.schema)


def _left(text: str, starts: list[int], stops: list[int]) -> str:
    """The text without the given spans, which may overlap; a line break that ended the last line goes with it."""
    pieces, end = [], 0
    for start, stop in zip(starts, stops):
        if start > end:
            pieces.append(text[end:start])
        end = max(end, stop)
    tail = text[end:]
    whole = "".join(pieces)
    return whole + tail if tail or end <= len(text) or not whole.endswith("\n") else whole[:-1]


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read_docs(spark, sf_dir)).drop("row_hash")
