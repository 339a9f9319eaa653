"""Operator 4, LM scoring: a hashed maximum-entropy model with class-factored softmax.

P(token | context) = P(class | context) * P(token | class). A token's class depends on how often training documents have it: the end
of a text, the most common words (a class each), the rest by powers of two of their share, and one class of words seen once or
never. P(token | class) is the token's share of its class; inside the last class, the Good-Turing estimate divides the mass between words
seen once and the event of an unseen word, so the model spends a total probability of one on the V known tokens and that event.

P(class | context) is a softmax over hashed features: the word before, the two words before, and as skips the second and the third word
before. It is trained in rounds: each partition takes adaptive gradient steps over all its training tokens from the common weights, and
the new common weights are the partitions' weights, averaged row by row by how often a partition had the feature.

Word counts come from all documents by word (``blocks``): a block sends each distinct word once and gets its count back.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import blocks
from plumbline.llm.common import dropped, read_docs, written

#: rows of the weight table; classes: end, TOP common words, BINS shares, rare
WIDTH, TOP, BINS = 1 << 15, 30, 16
CLASSES = TOP + BINS + 2
RARE = CLASSES - 1
ROUNDS, BATCH, RATE = 2, 4096, 0.3
#: logarithms up to this size become powers as they are
_PLAIN = 60
#: rows of weights that travel together
_PART = 2048
#: no word holds a line break
END = b"\n"
_CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inside double, hashes binary, classes binary"


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text, modulo 7, is 2; a NULL id is no text and is learned from."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


@dataclass
class Counts:
    """What the model needs to know of all training tokens; the numbers of values do not grow with the corpus."""

    total: int  # N
    known: int  # V
    once: int
    twice: int
    end: int
    top: dict[tuple[int, int], int]  # (count, hash) of a common word -> class
    in_class: np.ndarray  # training tokens of each class

    def parts(self) -> tuple:
        return self.total, self.known, self.once, self.twice, self.end, self.top, self.in_class

    def class_of(self, count: np.ndarray, hashes: np.ndarray, is_end: np.ndarray) -> np.ndarray:
        out = np.full(len(count), RARE, np.uint8)
        more = count >= 2
        out[more] = TOP + 1 + np.minimum(BINS - 1, np.floor(np.log2(self.total / count[more]))).astype(np.uint8)
        if self.top:
            least = min(c for c, _ in self.top)
            for i in np.flatnonzero(count >= least):
                out[i] = self.top.get((int(count[i]), int(hashes[i])), out[i])
        out[is_end] = 0
        return out

    def inside(self, count: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 P(token | class)."""
        unseen = (self.once + 1) / (self.once + 2 * self.twice + 2)
        out = np.log10(np.maximum(count, 1) / np.maximum(self.in_class[classes], 1))
        out[classes <= TOP] = 0.0
        rare = classes == RARE
        out[rare & (count > 0)] = math.log10((1 - unseen) / max(1, self.once))
        out[rare & (count == 0)] = math.log10(unseen)
        return out

    def bias(self) -> np.ndarray:
        return np.log((self.in_class + 1.0) / (self.in_class.sum() + CLASSES)).astype(np.float32)


def _counted(answers: DataFrame) -> Counts:
    """Statistics of ``answers`` (one row of each word has ``first``): two small aggregates."""
    words = answers.where("first AND count > 0")
    by = words.agg(
        F.sum("count").alias("n"), F.count("*").alias("v"), F.count_if(F.col("count") == 1).alias("n1"), F.count_if(F.col("count") == 2).alias("n2"),
        F.sum(F.when(F.col("is_end"), F.col("count"))).alias("end")).first()
    total = by["n"] or 0
    common = words.where("NOT is_end AND count >= 2").orderBy(F.desc("count"), "hash").select("count", "hash").limit(TOP).collect()
    top = {(r["count"], r["hash"]): i + 1 for i, r in enumerate(common)}
    in_class = np.zeros(CLASSES)
    in_class[0], in_class[RARE] = by["end"] or 0, by["n1"] or 0
    share = F.least(F.lit(BINS - 1), F.floor(F.log2(F.lit(float(max(total, 1))) / F.col("count")))).cast("int")
    for r in words.where("NOT is_end AND count >= 2").groupBy(share.alias("bin")).agg(F.sum("count").alias("n")).collect():
        in_class[TOP + 1 + r["bin"]] = r["n"]
    for (count, _), k in top.items():
        in_class[k] = count
        in_class[TOP + 1 + min(BINS - 1, math.floor(math.log2(total / count)))] -= count
    return Counts(total, by["v"] or 0, by["n1"] or 0, by["n2"] or 0, by["end"] or 0, top, in_class)


def features(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each token four rows of the weight table, from the 16-bit hashes of the words before it in its document."""
    n = len(hashes)
    place = np.arange(n) - np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0))
    before = []
    for k in (1, 2, 3):
        h = np.zeros(n, np.uint32)
        h[k:] = hashes[:-k] if n > k else 0
        before.append(np.where(place >= k, h + np.uint32(1), np.uint32(0)))
    one, two, three = before
    mixes = (one * np.uint32(0x9E3779B1), (one * np.uint32(0x85EBCA77)) ^ (two * np.uint32(0xC2B2AE3D)) + np.uint32(1),
             two * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1), three * np.uint32(0xD3A2646D) + np.uint32(0x9E3779F9))
    out = np.empty((4, n), np.uint16)
    for i, m in enumerate(mixes):
        m = (m ^ (m >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[i] = (m ^ (m >> np.uint32(13))) % np.uint32(WIDTH)
    return out


def _sums(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Unnormalised log-probabilities of the classes, in a range whose powers are neither too large nor all zero."""
    out, part = np.empty((2, rows.shape[1], weights.shape[1]), np.float32)
    np.take(weights, rows[0], 0, out=out, mode="clip")
    for r in rows[1:]:
        np.take(weights, r, 0, out=part, mode="clip")
        out += part
    part[:] = bias
    out += part
    if max(out.max(initial=0), -out.min(initial=0)) > _PLAIN:
        out -= out.max(1, keepdims=True)
    return out


def _totals(powers: np.ndarray) -> np.ndarray:
    """The sum of each row; a product is quicker than so many short sums."""
    return powers @ np.ones(powers.shape[1], np.float32)


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, classes: np.ndarray | None = None) -> np.ndarray:
    """log P(class | context) of each token: of all classes, or of its own one."""
    out = _sums(weights, bias, rows)
    own = out if classes is None else out[np.arange(len(classes)), classes]
    total = np.log(_totals(np.exp(out, out=None if classes is None else out)))
    return own - (total[:, None] if classes is None else total)


def _summed_runs(values: np.ndarray, order: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rows of ``values``, taken in this order, summed over runs of so many rows. Most runs are one row, which is only copied."""
    out = np.take(values, order[np.cumsum(counts) - counts], 0, mode="clip")
    longer = counts > 1
    if longer.any():
        n = counts[longer]
        own = np.take(values, order[np.repeat(longer, counts)], 0, mode="clip")
        # a sum of complex numbers is that of both halves: reduceat goes column by column, so this halves its calls
        out[longer] = np.add.reduceat(own.view(np.complex64), np.cumsum(n) - n).view(np.float32)
    return out


class Trainer:
    """Adaptive gradient steps on a copy of the common weights; ``seen`` counts how often each row was stepped."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights.copy(), bias
        self.squares, self.seen = np.full(len(weights), 1e-4, np.float32), np.zeros(len(weights), np.float32)
        self._whole = self.weights.view(f"V{weights.shape[1] * weights.itemsize}")[:, 0]  # the same memory, a row as one value

    def step(self, rows: np.ndarray, classes: np.ndarray) -> None:
        slope = _sums(self.weights, self.bias, rows)
        np.exp(slope, out=slope)
        slope /= _totals(slope)[:, None]
        slope[np.arange(len(classes)), classes] -= 1
        for r in rows:
            order = np.argsort(r, kind="stable")
            own = r[order]
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts = np.diff(np.append(starts, len(own)))
            row, n = own[starts].astype(np.int64), counts.astype(np.float32)
            summed = _summed_runs(slope, order, counts)
            self.seen[row] += n
            # of the mean of a row's slopes, so that common features do not overshoot
            squares = self.squares[row] + np.einsum("ij,ij->i", summed, summed) * np.float32(4 / summed.shape[1]) / (n * n)
            self.squares[row] = squares
            summed *= (np.float32(RATE) / (np.sqrt(squares) * n))[:, None]
            now = np.take(self.weights, row, 0, mode="clip")
            now -= summed
            self._whole[row] = now.view(self._whole.dtype)[:, 0]


def _batches_of(batch: pa.RecordBatch, at: int, learn: bool):
    """(rows of the table, classes, ends) of the documents of a batch (only those learned from), some hundred at a time."""
    size = 256
    for a in range(0, batch.num_rows, size):
        part = batch.slice(a, size)
        hashes = [np.frombuffer(h, "<u2") for h in part.column(at).to_pylist()]
        classes = [np.frombuffer(c, np.uint8) for c in part.column(at + 1).to_pylist()]
        if learn:
            out = part.column(at - 1).to_pylist()
            hashes, classes = [h for h, o in zip(hashes, out) if not o], [c for c, o in zip(classes, out) if not o]
        if hashes:
            ends = np.cumsum([len(h) for h in hashes])
            yield features(np.concatenate(hashes).astype(np.uint32), ends), np.concatenate(classes), ends


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Counts]:
    """A table of the documents as token hashes and classes with their base scores, and the counts."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    each = blocks.words(rows, END, lambda i: not held_out(i))
    of_word = Window.partitionBy("word").orderBy("block", "code")  # one order for both, so that rows are sorted once
    whole = of_word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    answers = written(each.select(
        "block", "code", "dictionary", F.sum("n").over(whole).alias("count"), F.pmod(F.xxhash64("word"), F.lit(1 << 16)).cast("int").alias("hash"),
        (F.row_number().over(of_word) == 1).alias("first"), (F.col("word") == F.lit(bytearray(END))).alias("is_end")), "op4-counts")
    counts = _counted(answers)
    shared = docs.sparkSession.sparkContext.broadcast(counts.parts())  # plain values travel without the class

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        own = Counts(*shared.value)
        count, hashes = right.column("count").to_numpy(), right.column("hash").to_numpy()
        classes = own.class_of(count, hashes, right.column("is_end").to_numpy())
        base = np.log10((count + 1.0) / (own.total + own.known + 1.0))
        inside = own.inside(count, classes)
        hashes = hashes.astype("<u2")
        out = []
        for doc_id, codes in zip(left.column("doc_id").to_pylist(), left.column("codes").to_pylist()):
            codes = blocks.unpacked(codes)
            out.append((doc_id, held_out(doc_id), len(codes), int((count[codes] > 0).sum()), math.fsum(base[codes]), math.fsum(inside[codes]),
                        hashes[codes].tobytes(), classes[codes].tobytes()))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
        columns = list(zip(*out)) if out else [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in _CODED.split(", ")])

    table = written(blocks.matched(blocks.texts(rows, END), answers, put_together, _CODED), "op4-coded")
    dropped(answers)
    return table, counts


def train(table: DataFrame, counts: Counts, rounds: int = ROUNDS) -> np.ndarray:
    """The common weights after so many rounds over all training tokens; WIDTH rows of CLASSES numbers."""
    context = table.sparkSession.sparkContext
    weights, bias = np.zeros((WIDTH, CLASSES), np.float32), counts.bias()
    lanes = max(1, math.isqrt(table.rdd.getNumPartitions()))
    for _ in range(rounds):
        now = context.broadcast((weights, bias))

        def stepped(batches):
            from pyspark import TaskContext

            trainer = Trainer(*now.value)
            for batch in batches:
                for rows, classes, _ in _batches_of(batch, 1, True):
                    for at in range(0, len(classes), BATCH):
                        trainer.step(rows[:, at:at + BATCH], classes[at:at + BATCH])
            if trainer.seen.any():
                lane = TaskContext.get().partitionId() % lanes
                for part in range(WIDTH // _PART):
                    own = slice(part * _PART, (part + 1) * _PART)
                    yield _summed(part, lane, trainer.weights[own] * trainer.seen[own, None], trainer.seen[own])

        def merged(found: pa.Table) -> pa.Table:
            w, seen = np.zeros((_PART, CLASSES), np.float64), np.zeros(_PART)
            for a, b in zip(found.column("weights").to_pylist(), found.column("seen").to_pylist()):
                w += np.frombuffer(a, np.float32).reshape(w.shape)
                seen += np.frombuffer(b, np.float32)
            return pa.Table.from_batches([_summed(found.column("part")[0].as_py(), 0, w, seen)])

        kinds = "part int, lane int, weights binary, seen binary"
        sent = table.select("held_out", "hashes", "classes").mapInArrow(stepped, kinds)
        # two steps, so that no task adds up all partitions
        for r in sent.groupBy("part", "lane").applyInArrow(merged, kinds).groupBy("part").applyInArrow(merged, kinds).collect():
            w, seen = np.frombuffer(r["weights"], np.float32).reshape(_PART, CLASSES), np.frombuffer(r["seen"], np.float32)
            own = slice(r["part"] * _PART, (r["part"] + 1) * _PART)
            weights[own] = np.where(seen[:, None] > 0, w / np.maximum(seen, 1)[:, None], weights[own])
    return weights


def _summed(part: int, lane: int, weights: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([lane], pa.int32()), pa.array([weights.astype(np.float32).tobytes()], pa.binary()),
         pa.array([seen.astype(np.float32).tobytes()], pa.binary())], ["part", "lane", "weights", "seen"])


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of ``docs``.

    NULL, empty and blank texts are the end token alone. Rows repeated count as often as they occur. With no training document
    every token is unseen: base_score and score are 0.
    """
    table, counts = coded(docs, id_col, text_col)
    if not counts.total:
        return table.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(0).cast("long").alias("train_tokens"), "base_score", F.lit(0.0).alias("score"))
    model = table.sparkSession.sparkContext.broadcast((train(table, counts, rounds), counts.bias()))

    def scored(batches):
        weights, bias = model.value
        for batch in batches:
            found = []
            for rows, classes, ends in _batches_of(batch, 6, False):
                log_p = np.empty(len(classes), np.float64)
                for at in range(0, len(classes), BATCH):
                    own = slice(at, at + BATCH)
                    log_p[own] = _logits(weights, bias, rows[:, own], classes[own])
                found.append(np.add.reduceat(log_p, ends - np.diff(ends, prepend=0)))
            outside = np.concatenate(found) / math.log(10) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(outside + batch.column(5).to_numpy())],
                ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return table.mapInArrow(scored, kinds).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.total).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_docs(spark, sf_dir))
