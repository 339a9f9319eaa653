"""Operator 12, embedding whitening: principal components of all vectors, to double precision, and each vector in their units.

Entries become whole numbers (``floor(64 * c) + 1000000``), so counts, sums and centred products are exact whatever the order tasks
end in: a first pass gives the sums, a second one the products of the vectors less their rounded mean, and what rounding the mean
left is taken off exactly. Only d x d sums meet, by entry; no vector is shuffled.

The eigenvectors start in float32 and are corrected by matrix products in extended precision, after Ogita and Aishima: the errors of
orthogonality and of diagonality give the next correction, each round doubles the right digits. Eigenvalues that lie closer
together than the present error cannot be told apart by that formula; such a cluster is solved by itself, on its own small shifted
matrix, whose relative gaps are wide again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, read_docs, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: 64 * |entry| must stay below this
LARGEST = 2.0 ** 61
#: rows multiplied at once; with entries below 2 ** 20 their products are exact in double precision
_ROWS = 4096
_LONG = np.longdouble
#: eigenvalues this close (the largest entry is 1) are a cluster in any case: rounding in the products, over so small a gap, would count
_CLOSE = 1e-6
_PARTS = "dims int, n long, sums array<decimal(38,0)>"
_PRODUCTS = "i int, sums array<decimal(38,0)>"
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def _whole(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, floor(64 * c) as a matrix) of the vectors that are neither NULL nor hold a NULL or non-finite entry."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)  # NULL entries are NaN
    lengths = np.maximum(sizes, 0)
    starts = np.cumsum(lengths) - lengths
    odd = np.bincount(np.repeat(np.arange(len(sizes)), lengths), ~np.isfinite(flat), len(sizes)) > 0
    for dims in np.unique(sizes[(sizes >= 0) & ~odd]).tolist():
        rows = np.flatnonzero((sizes == dims) & ~odd)
        x = np.floor(flat[starts[rows][:, None] + np.arange(dims)] * SCALE)
        if x.size and np.abs(x).max() >= LARGEST:
            raise ValueError("an entry is too large to become a long")
        yield dims, rows, x.astype(np.int64)


def _most(values: np.ndarray) -> int:
    return int(np.abs(values).max()) if values.size else 0


def _exact_sums(x: np.ndarray) -> list[int]:
    if _most(x) * max(1, len(x)) < 1 << 62:
        return x.sum(0).tolist()
    return x.astype(object).sum(0).tolist()


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y.T @ y as Python's whole numbers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), _ROWS):
        part = y[at:at + _ROWS]
        if _most(part) < 1 << 20:
            part = part.astype(np.float64)
            total = total + (part.T @ part).astype(np.int64).astype(object)
        else:
            part = part.astype(object)
            total = total + part.T @ part
    return total


def _decimals(values: list[int]) -> list:
    from decimal import Decimal

    return [Decimal(int(v)) for v in values]


@dataclass
class Whitening:
    """What the fit found. ``sums`` are those of the vectors less ``centre``; columns of ``vectors`` are components by falling eigenvalue."""

    n: int
    centre: list[int]
    sums: list[int]
    values: np.ndarray  # eigenvalues
    vectors: np.ndarray
    trace: float
    rank: int  # eigenvalues that are not zero
    identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n of the rows of floor(64 * c)."""
        return (x - np.array(self.centre, np.int64)) - np.array([s / self.n for s in self.sums])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        used = min(self.rank, len(self.values))
        return self.centred(x) @ (self.vectors[:, :used] / np.sqrt(self.values[:used]))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact; None where a long cannot hold it."""
        y = x - np.array(self.centre, np.int64)
        most = _most(y) * self.n + max((abs(s) for s in self.sums), default=0)
        if most ** 2 * max(1, y.shape[1]) < 1 << 62:
            return ((y * self.n - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        found = ((y.astype(object) * self.n - np.array(self.sums, object)) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in found]


# ---------------------------------------------------------------- eigenvectors
def _extended(value: int) -> np.longdouble:
    """A whole number rounded to extended precision."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    cut = max(0, value.bit_length() - 100)
    top = value >> cut
    return sign * np.ldexp(_LONG(float(top >> 50)) * _LONG(2.0 ** 50) + _LONG(float(top & (1 << 50) - 1)), cut)


def _clusters(values: np.ndarray, width) -> list[np.ndarray]:
    """Groups of two or more whose sorted values follow each other within ``width``."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def eigenvectors(matrix: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix, in extended precision."""
    d = len(matrix)
    scale = np.abs(matrix).max() if d else _LONG(0)
    if not scale:
        return np.zeros(d, _LONG), np.eye(d, dtype=_LONG)
    a = matrix.astype(_LONG) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(_LONG)
    one, tiny, last = np.eye(d, dtype=_LONG), _LONG(np.finfo(_LONG).eps), _LONG(np.inf)
    for _ in range(rounds):
        r, s = one - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        error = 2 * (np.sqrt((off ** 2).sum()) + np.sqrt((r ** 2).sum()) * np.abs(values).max())
        width = max(error, _CLOSE)
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= width
        groups = _clusters(values, width)
        for group in groups:
            near[np.ix_(group, group)] = True
        step = np.where(near, r / 2, (s + r * values[None, :]) / np.where(near, _LONG(1), gap))
        x = x + x @ step
        for group in groups:
            own = x[:, group]
            own = own + own @ (np.eye(len(group), dtype=_LONG) - own.T @ own) / 2
            middle = values[group].mean()
            small = own.T @ (a @ own - middle * own)
            small = (small + small.T) / 2
            size = np.abs(small).max()
            if size > d * tiny:  # else the values are equal, and any basis will do
                own = own @ eigenvectors(small)[1]
            x[:, group] = own
        # clusters count as settled where their own matrix is diagonal to the last digit
        left = max(np.abs(step).max(), *(np.abs(off[np.ix_(g, g)]).max() for g in groups), tiny)
        if left < 4 * tiny or left < 1e-9 and left * 2 > last:
            break
        last = left
    values = np.diag(x.T @ (a @ x)) / (x * x).sum(0)
    x = x / np.sqrt((x * x).sum(0))
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order] * scale
    return values, x * np.where(x[np.abs(x).argmax(0), np.arange(d)] < 0, _LONG(-1), _LONG(1))


# ---------------------------------------------------------------- fit
def _added(parts: DataFrame, *keys: str) -> DataFrame:
    """Sums by place of the rows' arrays, for each value of ``keys``."""
    return parts.select(*keys, F.posexplode("sums").alias("j", "v")).groupBy(*keys, "j").agg(F.sum("v").alias("v"))


def fit(vectors: DataFrame, vector_col: str = "embedding") -> Whitening | None:
    """The components of all vectors; None where no vector remains.

    Vectors that are NULL or hold NULL or non-finite entries take no part, nor do vectors of another length than the commonest (of
    equally common ones, the longest). Repeated vectors count as often as they occur. d * d sums go through the driver.
    """
    column = vectors.select(F.col(f"`{vector_col}`").alias("v"))

    def summed(batches):
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for dims, rows, x in _whole(batch.column(0)):
                n, sums = found.get(dims, (0, [0] * dims))
                found[dims] = n + len(rows), [a + b for a, b in zip(sums, _exact_sums(x))]
        if found:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()),
                pa.array([_decimals(s) for _, s in found.values()], pa.list_(pa.decimal128(38, 0)))], ["dims", "n", "sums"])

    parts = written(column.mapInArrow(summed, _PARTS), "op12-sums")
    top = parts.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if top is None:
        dropped(parts)
        return None
    d, n = top["dims"], top["n"]
    sums = [0] * d
    for row in _added(parts.where(F.col("dims") == d)).collect():
        sums[row["j"]] = int(row["v"])
    dropped(parts)
    centre = [(2 * s + n) // (2 * n) for s in sums]  # the mean, rounded
    rest = [s - n * c for s, c in zip(sums, centre)]

    def multiplied(batches):
        middle, total = np.array(centre, np.int64), np.zeros((d, d), object)
        for batch in batches:
            for dims, _, x in _whole(batch.column(0)):
                if dims == d:
                    total = total + _exact_products(x - middle)
        yield pa.RecordBatch.from_arrays([
            pa.array(range(d), pa.int32()), pa.array([_decimals(row) for row in total.tolist()], pa.list_(pa.decimal128(38, 0)))], ["i", "sums"])

    products = np.zeros((d, d), object)
    for row in _added(column.mapInArrow(multiplied, _PRODUCTS), "i").collect():
        products[row["i"], row["j"]] = int(row["v"])
    # n * n times the covariance, without rounding
    exact = products * n - np.outer(np.array(rest, object), np.array(rest, object)) if d else products
    square = _extended(n) * _extended(n)
    cov = np.array([[_extended(int(v)) / square for v in row] for row in exact], _LONG).reshape(d, d)
    values, found = eigenvectors(cov)
    floor = 16 * d * np.finfo(_LONG).eps * (np.abs(cov).max() if d else 0)
    trace = sum(int(exact[i, i]) for i in range(d))
    return Whitening(n, centre, rest, values.astype(np.float64), found.astype(np.float64), float(_extended(trace) / square), int((values > floor).sum()))


def identity_error(vectors: DataFrame, model: Whitening, components: int = COMPONENTS, vector_col: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened vectors' covariance (measured on them, divisor n) less the identity."""
    d, k = len(model.values), min(components, model.rank)
    if not k:
        return None

    def multiplied(batches):
        total = np.zeros((k, k + 1))
        for batch in batches:
            for dims, _, x in _whole(batch.column(0)):
                if dims == d:
                    w = model.whitened(x)[:, :k]
                    total[:, :k] += w.T @ w
                    total[:, k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "sums"])

    total = np.zeros((k, k + 1))
    found = vectors.select(F.col(f"`{vector_col}`").alias("v")).mapInArrow(multiplied, "i int, sums array<double>")
    for row in _added(found, "i").collect():
        total[row["i"], row["j"]] = row["v"]
    mean = total[:, k] / model.n
    return float(np.abs(total[:, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, model: Whitening | None, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector that remains (see ``fit``) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    NULL ids and repeated rows stay as they are. A component along which no vector varies has whitened NULL and explained 0 (NULL if
    nothing varies at all); ``identity_error`` is over the others. ``deviation`` is NULL where a long cannot hold it. Nothing
    remains of an empty table. Other columns are not read, whatever their names.
    """
    columns = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v"))
    if model is None:
        return columns.where("false").mapInArrow(lambda batches: iter(()), _OUT).withColumn("identity_error", F.lit(None).cast("double"))
    d, k = len(model.values), min(components, len(model.values))
    used = min(k, model.rank)
    explained = [v / model.trace if i < model.rank else 0.0 for i, v in enumerate(model.values[:k].tolist())] if model.trace else [None] * k

    def rows(batches):
        for batch in batches:
            for dims, at, x in _whole(batch.column(1)):
                if dims != d or not k:
                    continue
                w = np.full((len(at), k), np.nan)
                w[:, :used] = model.whitened(x)[:, :used]
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                dev = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, model.n)), dev,
                    pa.array(w.ravel(), from_pandas=True), pa.array(explained, pa.float64()).take(pa.array(np.tile(np.arange(k), len(at))))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return columns.mapInArrow(rows, _OUT).withColumn("identity_error", F.lit(model.identity_error).cast("double"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_docs(spark, sf_dir, "embeddings")
    model = fit(vectors)
    if model is not None:
        model.identity_error = identity_error(vectors, model)
    return whitened(vectors, model)
