import math
import random

import numpy as np
import pytest

from plumbline.llm import whitening as W

CLASHING = ["v", "i", "j", "n", "sums", "dims", "component", "whitened", "deviation", "explained"]


def frame(spark, rows, parts=3):
    schema = "vec_id long, embedding array<float>, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, v, *["x"] * len(CLASHING)) for i, v in rows], schema).repartition(parts)


def fine(v, d):
    return v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)


def floats(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def reference(rows, d):
    """Exact sums and deviations, and the components of numpy in double precision."""
    kept = [(i, [math.floor(64 * x) + 1_000_000 for x in v]) for i, v in rows if fine(v, d)]
    n = len(kept)
    s = [sum(x[j] for _, x in kept) for j in range(d)]
    centred = np.array([[x[j] - s[j] / n for j in range(d)] for _, x in kept])
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    return kept, n, [sum((n * x[j] - s[j]) ** 2 for j in range(d)) for _, x in kept], e, centred @ q


def whitened(df):
    model = W.fit(df)
    if model is not None:
        model.identity_error = W.identity_error(df, model)
    return W.whitened(df, model).collect()


def cloud(n, d, seed=1):
    rng = np.random.default_rng(seed)
    return floats([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, d)) * np.linspace(1, 3, d) + 0.3)])


def test_whitening_against_numpy(spark):
    odd = floats([(None, None), (901, [1.0, None] + [0.0] * 4), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, []), (905, [1.0] * 3), (None, [0.5] * 6)])
    rows = cloud(300, 6) + odd
    rows += [rows[5]] * 100  # a hot vector
    kept, n, dev, e, proj = reference(rows, 6)
    got = whitened(frame(spark, rows))
    assert len(got) == 6 * n and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 7))
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(by_id, key=str) == sorted({i for i, _ in kept}, key=str)
    signs = {}
    for (i, _), want_dev, p in zip(kept, dev, proj):
        for c in range(1, 7):
            r = by_id[i][c]
            assert r.deviation == want_dev and abs(r.explained - e[c - 1] / e.sum()) < 1e-12
            w = p[c - 1] / math.sqrt(e[c - 1])
            signs.setdefault(c, math.copysign(1, w) * math.copysign(1, r.whitened))
            assert abs(r.whitened * signs[c] - w) < 1e-9


def test_more_dimensions_than_components(spark):
    got = whitened(frame(spark, cloud(200, 40)))
    assert len(got) == 200 * 32 and {r.component for r in got} == set(range(1, 33))
    assert sum({r.component: r.explained for r in got}.values()) < 1 and got[0].identity_error < 1e-9


def test_components_without_spread(spark):
    rows = floats([(i, [i % 7, 2 * (i % 7), 5.0]) for i in range(70)])
    got = whitened(frame(spark, rows))
    assert len(got) == 210
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert {(r.component, r.explained) for r in got if r.component > 1} == {(2, 0.0), (3, 0.0)} and got[0].identity_error < 1e-12


@pytest.mark.parametrize("rows, want", [([], 0), ([(1, None)], 0), ([(1, [])], 0), ([(1, [2.0, 3.0])], 2)])
def test_small_tables(spark, rows, want):
    got = whitened(frame(spark, floats(rows)))
    assert len(got) == want and all(r.whitened is None and r.deviation == 0 and r.identity_error is None for r in got)


def test_large_entries_stay_exact(spark):
    rng = random.Random(3)
    rows = floats([(i, [rng.uniform(-1, 1) * 1e9, rng.uniform(0, 1)]) for i in range(50)])
    _, n, dev, _, _ = reference(rows, 2)
    model = W.fit(frame(spark, rows))
    got = W.whitened(frame(spark, rows), model).collect()
    want = {i: v if v < 1 << 63 else None for (i, _), v in zip(rows, dev)}
    assert {r.vec_id: r.deviation for r in got} == want and None in want.values()
    with pytest.raises(Exception, match="too large"):
        W.fit(frame(spark, [(1, [1e30])]))


@pytest.mark.parametrize("values", [
    [5, 3, 2, 1, 0.5, 0.1], [4, 4, 4, 1, 1, 0], [1 + 1e-9, 1 + 2e-9, 1, 0.5, 0.5 + 1e-11, 1e-6], [1, 1 - 1e-7, 1 - 1e-12, 1 - 2e-12, 1e-8, 1e-8 + 1e-13], [0] * 6])
def test_eigenvectors_of_clusters(values):
    """A matrix whose eigenvectors are known: reflections of the axes, in extended precision."""
    rng = np.random.default_rng(7)
    q = np.eye(6, dtype=np.longdouble)
    for _ in range(3):
        v = rng.normal(size=6).astype(np.longdouble)
        q = q - 2 * np.outer(q @ v, v) / (v @ v)
    values = np.array(values, np.longdouble)
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = W.eigenvectors(a)
    want = np.sort(values)[::-1]
    assert np.abs(found - want).max() < 1e-17
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-17 and np.abs(a @ x - x * found).max() < 1e-17
    for i, v in enumerate(want):
        others = np.abs(want - v)[np.arange(6) != i].min()
        if others > 1e-13:  # a vector of its own: the known one, to the error that this gap allows
            own = q[:, np.argsort(-values)[i]]
            assert min(np.abs(x[:, i] - own).max(), np.abs(x[:, i] + own).max()) < max(1e-17, 2e-18 / others)


def test_eigenvectors_beat_double_precision():
    rng = np.random.default_rng(2)
    y = rng.integers(-200, 200, (300, 64))
    a = (y.T @ y).astype(np.longdouble) / 300
    found, x = W.eigenvectors(a)
    scale = np.abs(a).max()
    assert np.abs(a @ x - x * found).max() < 1e-16 * scale and np.abs(x.T @ x - np.eye(64)).max() < 1e-17
    plain = np.linalg.eigh(a.astype(np.float64))[1][:, ::-1]
    assert np.abs(np.abs((plain * x).sum(0)) - 1).max() < 1e-12


def test_registered_whitening(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    d = len(rows[0][1])
    kept, n, dev, e, proj = reference(rows, d)
    got = {(r.vec_id, r.component): r for r in W.op12_embedding_whitening(spark, sf_dir).collect()}
    assert len(got) == n * min(32, d)
    for c in range(1, min(32, d) + 1):
        w = proj[:, c - 1] / math.sqrt(e[c - 1])
        own = np.array([got[i, c].whitened for i, _ in kept])
        assert min(np.abs(w - own).max(), np.abs(w + own).max()) < 1e-8
    assert all(got[i, 1].deviation == v for (i, _), v in zip(kept, dev)) and got[kept[0][0], 1].identity_error < 1e-10
