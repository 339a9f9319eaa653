"""Operator 9, quality classifier: ordinal cumulative-link regression on graded ratings.

Grades come from the labels: 0 for poor text, 1 for text that is well formed but toxic, 2 for good text. A document is a set of
hashed text features (words, their stems, runs of symbols, and a few measures of form in steps); one weight per feature is shared by all grades,
and ordered thresholds cut the score into grades: P(grade > k) = sigmoid(score - threshold k). The expected grade and the tail
probability P(grade >= 2) come from the same score, and the tail decides.

The model is fitted on at most ``SAMPLE`` labelled documents, those whose hashed ids are smallest (a documented bound; all labels
where there are fewer). Their features are made on the executors; the driver gets features, never texts. Scoring covers every row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import read_docs
from plumbline.llm.shingles import slices

#: labelled documents the model is fitted on, at most
SAMPLE = 12_000
#: hashed features
WIDTH = 1 << 22
#: a feature gets a weight if it is in so many labelled documents, and at some threshold so many standard errors more common on one side
LEAST, SIGNIFICANT = 5, 7.0
GRADES = 3
#: P(grade 2) from which a document stays
KEEP = 0.7
_UPPER = re.compile(r"[A-Z]")
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]+|[\d_]+")
_REMEMBERED = 300_000


def _number(feature: str) -> int:
    return zlib.crc32(feature.encode()) % WIDTH


def _steps(share: float, name: str) -> str:
    return f"{name}{min(10, int(share * 10))}"


class Features(dict):
    """Feature numbers of a text. As a dict: of a token, its own and its stem's (its first four characters), remembered until there
    are too many; only those in ``wanted`` if that is given."""

    def __init__(self, wanted: frozenset | None = None):
        super().__init__()
        self.wanted = wanted

    def __missing__(self, token: str) -> tuple:
        if len(self) > _REMEMBERED:
            self.clear()
        found = (_number(token), _number("\x00" + token[:4])) if len(token) > 4 else (_number(token),)
        self[token] = found = found if self.wanted is None else tuple(n for n in found if n in self.wanted)
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct numbers."""
        text = text or ""
        tokens = _TOKEN.findall(text.lower())
        counts = Counter(tokens)
        found = set()
        symbols = 0
        for token, n in counts.items():
            found.update(self[token])
            if not (token[0].isalnum() or token[0] == "_"):
                symbols += n
        upper, size = len(_UPPER.findall(text)), max(1, len(tokens))
        blank = text.count(" ") + text.count("\n")
        found.update(_number(f) for f in (
            _steps(len(counts) / size, "\x00distinct"), _steps(upper / max(1, len(text) - blank), "\x00upper"),
            _steps(symbols / size, "\x00symbols"), f"\x00size{len(tokens).bit_length()}"))
        return np.array(sorted(found), np.int64)


@dataclass
class Ordinal:
    """Weights of the features that have one, and ordered thresholds."""

    features: np.ndarray  # sorted numbers
    weights: np.ndarray
    thresholds: np.ndarray  # GRADES - 1, rising

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the model is made of; plain arrays travel without the class."""
        return self.features, self.weights, self.thresholds

    def score(self, found: np.ndarray) -> float:
        if not len(self.features) or not len(found):
            return 0.0
        at = np.minimum(np.searchsorted(self.features, found), len(self.features) - 1)
        return float(self.weights[at][self.features[at] == found].sum())

    def tails(self, score: float) -> np.ndarray:
        """P(grade > k) for each k."""
        return 1.0 / (1.0 + np.exp(np.clip(self.thresholds - score, -60, 60)))


def _telling(rows: list[np.ndarray], grades: np.ndarray) -> np.ndarray:
    """Numbers of the features that tell grades apart; chance differences of rare words would add up in long texts."""
    n = len(rows)
    numbers, df = np.unique(np.concatenate(rows), return_counts=True)
    often = df >= min(LEAST, max(1, n // 20))
    numbers, df = numbers[often], df[often]
    telling = np.zeros(len(numbers), bool)
    for k in range(GRADES - 1):
        above = int((grades > k).sum())
        if 0 < above < n:
            found, counts = np.unique(np.concatenate([r for r, g in zip(rows, grades) if g > k]), return_counts=True)
            at = np.minimum(np.searchsorted(found, numbers), len(found) - 1)
            high = np.where(found[at] == numbers, counts[at], 0)
            p = df / n
            error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / above + 1 / (n - above)))
            telling |= np.abs(high / above - (df - high) / (n - above)) >= min(SIGNIFICANT, n / 8) * error
    return numbers[telling]


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = 400, rate: float = 0.15, ridge: float = 1e-5) -> Ordinal:
    """Maximise the ordinal log-likelihood (less ``ridge`` times the squared weights) by full gradients with adaptive moments.

    With no labels or one grade only, every text gets that grade (2 without labels).
    """
    if not len(grades) or len(np.unique(grades)) < 2:
        only = int(grades[0]) if len(grades) else GRADES - 1
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.array([-30.0 if only > k else 30.0 for k in range(GRADES - 1)]))
    used = _telling(rows, grades)
    data = [np.searchsorted(used, r[np.isin(r, used, assume_unique=True)]) for r in rows]
    n, cuts = len(data), GRADES - 1
    flat = np.concatenate(data)
    doc = np.repeat(np.arange(n), [len(d) for d in data])
    share = np.array([(grades > k).mean() for k in range(cuts)]).clip(1e-3, 1 - 1e-3)
    x = np.concatenate([np.zeros(len(used)), np.log((1 - share) / share)])  # weights, then thresholds
    mean, spread = np.zeros_like(x), np.zeros_like(x)
    at = np.arange(n)
    for step in range(1, steps + 1):
        w, theta = x[:len(used)], x[len(used):]
        score = np.bincount(doc, w[flat], n)
        above = 1 / (1 + np.exp(np.clip(theta[None] - score[:, None], -60, 60)))
        above = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        high, low = above[at, grades], above[at, grades + 1]
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        slope = np.empty_like(x)
        slope[:len(used)] = np.bincount(flat, (d_high - d_low)[doc], len(used)) / n - ridge * w
        for k in range(cuts):
            slope[len(used) + k] = (d_low[grades == k].sum() - d_high[grades == k + 1].sum()) / n
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope ** 2
        x = x + rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-7)
        x[len(used):] = np.sort(x[len(used):])
    return Ordinal(used, x[:len(used)], x[len(used):])


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 poor, 1 well formed but toxic, 2 good. Rows with a NULL are left out; of several labels of one document
    the lowest grade counts."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    whole = F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    return labels.where(whole).select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """The model fitted on the labelled documents with the ``sample`` smallest hashed ids."""
    chosen = graded(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def made(batches):
        known = Features()
        for batch in batches:
            found = [known.of(t).astype("<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["grade", "features"])

    made_rows = pairs.select("grade", "text").mapInArrow(made, "grade int, features binary")
    rows = [(r["features"], r["grade"]) for r in made_rows.collect()]  # at most ``sample`` rows
    # one row for each set of features and grade: copies of one document would make its chance words look telling
    once = sorted({(bytes(f), g) for f, g in rows})
    del rows
    return fit([np.frombuffer(f, "<i4") for f, _ in once], np.array([g for _, g in once], np.int64))


def scored(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, expected_grade (0 to 2), tail (P of grade 2), kept (tail of ``KEEP`` or more) for each row of ``docs``.

    NULL and empty texts are scored by their form alone, texts of any length whole. Rows repeated have one score each, the same; a tail of
    exactly ``KEEP`` is kept. NULL ids stay, an empty table gives no rows, other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())  # as large as the sample's features

    def rows(batches):
        own = Ordinal(*shared.value)
        known = Features(frozenset(own.features.tolist()))
        for batch in batches:
            scores = [own.score(known.of(t)) for t in batch.column(1).to_pylist()]
            tails = [own.tails(s) for s in scores]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(scores, pa.float64()), pa.array([float(t.sum()) for t in tails], pa.float64()),
                pa.array([float(t[-1]) for t in tails], pa.float64())], ["doc_id", "score", "expected_grade", "tail"])

    out = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(rows, "doc_id long, score double, expected_grade double, tail double")
    return out.withColumn("kept", F.col("tail") >= KEEP)


def kept_documents(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model keeps, all columns, whatever their names; each row is judged where it is read, so nothing is
    shuffled. NULL and empty texts are judged by their form, rows repeated alike, and an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    at = docs.columns.index(text_col)

    def rows(batches):
        own = Ordinal(*shared.value)
        known = Features(frozenset(own.features.tolist()))
        for batch in slices(batches, at):
            keep = [bool(own.tails(own.score(known.of(t)))[-1] >= KEEP) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir)
    return scored(docs, train(docs, read_docs(spark, sf_dir, "labels")))
