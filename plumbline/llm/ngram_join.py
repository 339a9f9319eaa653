"""Operator 3, n-gram Jaccard join: documents whose sets of word shingles overlap enough, as groups, exactly.

1. How common is a shingle? Each block of documents sends its distinct shingle hashes once, sorted and as differences, to ranges of
   the hash space; a range counts documents and answers with one byte a hash: 0 for a shingle of one document, else a class that
   rises with the number of documents. Hashes are cut to as many bits as the corpus needs (two shingles that share the bits only look
   more common than they are).
2. A document keeps its shared shingles only, rarest class first. Fewer shared shingles than the required overlap T: linked with
   nothing. Otherwise it must share one of its first (shared - T + 1) shingles with each partner: these are its postings.
3. Documents with equal sets become one node. ``linking`` picks the pairs to compare.
4. A comparison is a T-occurrence search (DivideSkip): the nodes that met in a task form inverted lists by shingle; of the lists of a
   searching node's shingles the short ones are merged with a heap, the long ones are only probed, by binary search, for nodes that
   can still reach T.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read_docs, written
from plumbline.llm.linking import linked
from plumbline.llm.shingles import WORDS_A_SHINGLE, Hasher, buffers, from_bytes, pack_sorted, to_bytes, unpack_sorted

#: similarity in percent
PERCENT = 75
#: bytes of text in a block, hashes counted in one range
BLOCK_BYTES, RANGE_HASHES = 16_000_000, 2_000_000
SETS = "doc_id long, n_shingles long, node long, required int, prefix int, shared binary"


def overlap_needed(n: int, m: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Smallest overlap o of sets of n and m with 100 * o >= percent * (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


class InvertedLists:
    """For each number the positions of the sets that hold it. All sets sorted and distinct."""

    def __init__(self, sets: list[np.ndarray]):
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.owners = owners[order]
        self.values, self.starts = np.unique(flat[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(flat))

    def divide_skip(self, query: np.ndarray, needed: np.ndarray) -> list[int]:
        """Positions of the sets that share at least ``needed`` (one number a set) numbers with ``query``.

        With T the smallest number needed, the L longest lists are set aside: a set that reaches T must be in T - L of the others.
        Those are merged with a heap; each set that comes often enough is looked up in the long lists by binary search, until it
        has what it needs or cannot get it any more.
        """
        if not len(query) or not len(self.values):
            return []
        at = np.minimum(np.searchsorted(self.values, query), len(self.values) - 1)
        at = at[self.values[at] == query]
        lists = sorted((self.owners[a:b] for a, b in zip(self.starts[at], self.ends[at])), key=len)
        least = max(1, int(needed.min()))
        if len(lists) < least:
            return []
        long = min(least - 1, int(least / (0.01 * math.log2(max(2, len(lists[-1]))) + 1)))
        short, aside = lists[:len(lists) - long], lists[len(lists) - long:][::-1]
        found = []
        for one, run in groupby(heapq.merge(*[s.tolist() for s in short])):
            count, want = sum(1 for _ in run), max(1, int(needed[one]))
            if count + long < want:
                continue
            for i, own in enumerate(aside):
                if count >= want or count + len(aside) - i < want:
                    break
                place = own.searchsorted(one)
                count += bool(place < len(own) and own[place] == one)
            if count >= want:
                found.append(one)
        return found


def _index(percent: int):
    def index(others: list[tuple]):
        lists = InvertedLists([np.sort(from_bytes(g)) for _, _, g in others])
        sizes = np.array([m for _, m, _ in others])
        return lambda row: lists.divide_skip(np.sort(from_bytes(row[2])), overlap_needed(row[1], sizes, percent))

    return index


def _in_blocks(batches, most: int):
    """(number, ids, texts) of runs of rows of one partition, as Arrow arrays."""
    number, held, size = TaskContext.get().partitionId() << 24, [], 0
    for batch in batches:
        data, bounds = buffers(batch.column(1))
        at, n = 0, batch.num_rows
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(bounds, bounds[at] + max(1, most - size), "right"))))
            held.append(batch.slice(at, to - at))
            size += int(bounds[to] - bounds[at]) + to - at
            at = to
            if size >= most:
                yield number, *_joined(held)
                number, held, size = number + 1, [], 0
    if held:
        yield number, *_joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    return pa.concat_arrays([b.column(0) for b in held]), pa.concat_arrays([b.column(1) for b in held])


def shared_shingles(docs: DataFrame, percent: int = PERCENT, words: int = WORDS_A_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, and for documents that can have a partner node (a hash of the set),
    required (overlap with a set of equal size), prefix (number of postings) and shared (48-bit hashes, rarest first)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chars = rows.agg(F.sum(F.char_length("text"))).first()[0] or 0
    bits = min(64, max(24, math.ceil(math.log2(chars / 6 + 2)) + 6))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / 6 / RANGE_HASHES))
    cut = np.uint64(64 - bits)
    starts = np.array([(r << bits) // ranges for r in range(ranges)], np.uint64)

    def sent(batches):
        hasher = Hasher()
        for number, _, texts in _in_blocks(batches, BLOCK_BYTES):
            flat, sizes, _ = hasher.sets(*buffers(texts), words)
            flat >>= cut
            new = np.ones(len(flat), bool)  # once a document; the documents are sorted
            new[1:] = flat[1:] != flat[:-1]
            new[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
            values, counts = np.unique(flat[new], return_counts=True)
            at = np.append(np.searchsorted(values, starts), len(values))
            out = [(r, number, pack_sorted(values[a:b]), zlib.compress(np.minimum(counts[a:b], 255).astype(np.uint8).tobytes(), 1))
                   for r, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                ["part", "block", "hashes", "counts"])

    def answered(table: pa.Table) -> pa.Table:
        parts = [unpack_sorted(h) for h in table.column("hashes").to_pylist()]
        counts = [np.frombuffer(zlib.decompress(c), np.uint8) for c in table.column("counts").to_pylist()]
        flat = np.concatenate(parts)
        order = np.argsort(flat, kind="stable")
        ordered = flat[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        group = np.cumsum(new) - 1
        total = np.bincount(group, np.concatenate(counts)[order].astype(np.float64))
        classes = np.where(total < 2, 0, np.minimum(255, 1 + 4 * np.log2(np.maximum(total, 2)))).astype(np.uint8)
        answer = np.empty(len(flat), np.uint8)
        answer[order] = classes[group]
        ends = np.cumsum([len(p) for p in parts])
        out = [zlib.compress(answer[e - len(p):e].tobytes(), 1) for p, e in zip(parts, ends)]
        return pa.table([table.column("part"), table.column("block"), pa.array(out, pa.binary())], ["part", "block", "classes"])

    def in_block(batches):
        for number, ids, texts in _in_blocks(batches, BLOCK_BYTES):
            for a in range(0, len(ids), 1024):
                part = ids.slice(a, 1024)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), number)), part, texts.slice(a, 1024)], ["block", "doc_id", "text"])

    def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
        flat, sizes, _ = Hasher().sets(*buffers(left.column("text")), words)
        answers = sorted(zip(right.column("part").to_pylist(), right.column("classes").to_pylist()))
        classes = np.frombuffer(b"".join(zlib.decompress(c) for _, c in answers), np.uint8)
        order = np.argsort(flat >> cut)
        ordered = (flat >> cut)[order]
        rank = np.cumsum(ordered[1:] != ordered[:-1])
        if len(classes) != (rank[-1] + 1 if len(rank) else len(flat)):
            raise RuntimeError("the input gave other rows when it was read again; write it to a table first")
        own = np.empty(len(flat), np.uint8)
        own[order] = classes[np.append(0, rank)] if len(flat) else classes
        running = np.concatenate([[0], np.cumsum(own > 0)])
        ends = np.cumsum(sizes)
        shared = running[ends] - running[ends - sizes]
        required = -(-percent * sizes // 100)  # with any partner: their union is n or more
        able = (sizes > 0) & (shared >= required)
        nodes, sets = [], []
        for i in np.flatnonzero(able):
            s, c = flat[ends[i] - sizes[i]:ends[i]], own[ends[i] - sizes[i]:ends[i]]
            nodes.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
            order = np.argsort(c[c > 0], kind="stable")  # hashes of one class stay sorted
            sets.append(to_bytes(s[c > 0][order]))
        place = pa.array(np.cumsum(able) - 1, pa.int64(), mask=~able)
        return pa.table([
            left.column("doc_id"), pa.array(sizes), pa.array(nodes, pa.int64()).take(place), pa.array(required.astype(np.int32), mask=~able),
            pa.array((shared - required + 1).astype(np.int32), mask=~able), pa.array(sets, pa.binary()).take(place)], [c.split()[0] for c in SETS.split(", ")])

    answers = rows.mapInArrow(sent, "part long, block long, hashes binary, counts binary").groupBy("part").applyInArrow(
        answered, "part long, block long, classes binary")
    texts = rows.mapInArrow(in_block, "block long, doc_id long, text string")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(chosen, SETS)


def jaccard_groups(docs: DataFrame, percent: int = PERCENT, words: int = WORDS_A_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs``.

    Two rows link when 100 * overlap >= percent * union of their sets of ``words``-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z
    in lower case; fewer words make one shingle). A NULL, empty or blank text has no shingle and links with nothing. component_id
    is the smallest id reachable by links, NULL ids left out (NULL if there is no other). Rows repeated are linked like any copies.
    """
    sets = written(shared_shingles(docs, percent, words, id_col, text_col), "op3-sets")
    able = sets.where("node IS NOT NULL")
    nodes = written(able.select("node", F.col("n_shingles").cast("int").alias("n"), "prefix", F.col("shared").alias("grams")).dropDuplicates(["node"]), "op3-nodes")

    def posted(batches):
        for batch in batches:
            node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            prefix = batch.column(2).to_numpy()
            keys = [from_bytes(g[:6 * p]) for g, p in zip(batch.column(3).to_pylist(), prefix.tolist())]
            flat = np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(node, prefix)), pa.array(np.repeat(n, prefix))], ["key", "node", "n"])

    postings = nodes.select("node", "n", "prefix", "grams").mapInArrow(posted, "key long, node long, n int")
    comps = linked(postings, lambda _: nodes.select("node", "n", "grams"), _index(percent), percent / 100)
    found = able.select("doc_id", "node").join(comps, "node", "left").select("doc_id", "node", F.coalesce("comp", "node").alias("comp"))
    least = found.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_node = found.select("node", "comp").distinct().join(least, "comp").select("node", "component_id")
    return sets.select("doc_id", "n_shingles", "node").join(of_node, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their group or in none, all columns.

    NULL, empty and blank texts are in no group and stay. Rows that share the smallest id of a group all stay. Rows without an id are not
    told apart: all of them stay if one of them has no partner with an id. An empty table stays empty.
    """
    groups = jaccard_groups(docs, id_col=id_col, text_col=text_col)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first_id")).distinct()
    return docs.join(first, docs[id_col].cast("long").eqNullSafe(first["first_id"]), "left_semi")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_docs(spark, sf_dir))
