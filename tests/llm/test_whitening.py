import math
from fractions import Fraction

import numpy as np
import pytest

from pointloom.llm import whitening as W


def brute(rows, dimension):
    """{row: (n, deviation, {component: (|whitened|, explained)})} from exact sums of the distinct vectors."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and len(v) == dimension and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(dimension)]
    centred = [[Fraction(n * x[j] - sums[j], n) for j in range(dimension)] for x in fit]
    cov = np.array([[float(sum(c[a] * c[b] for c in centred) / n) for b in range(dimension)] for a in range(dimension)])
    values, vectors = np.linalg.eigh(cov)
    out = []
    for i, x in kept:
        y = np.array([float(Fraction(n * x[j] - sums[j], n)) for j in range(dimension)])
        dev = sum((n * x[j] - sums[j]) ** 2 for j in range(dimension))
        for k in range(min(16, dimension)):
            v, e = vectors[:, -1 - k], values[-1 - k]
            out.append((i, k + 1, n, dev, abs(float(y @ v)) / math.sqrt(e), e / np.trace(cov)))
    return sorted(out, key=lambda r: (str(r[0]), *r[1:4], round(r[4], 6)))


def got(df):
    return sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in df.collect()), key=lambda r: (str(r[0]), *r[1:4], round(r[4], 6)))


SCHEMA = "vec_id long, embedding array<float>, x string, n int, component int"


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(300, 5)) * [3, 2, 1, 0.5, 0.25]).round(3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(i, rows[0][1]) for i in range(400, 440)]  # copies count once in the fit, and have a result each
    rows += [(7, rows[8][1]), (7, rows[7][1]), (None, rows[1][1]), (900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0]), (903, [math.nan] * 5), (904, [math.inf] + [0.0] * 4), (905, [1.0] * 4)]
    frame = spark.createDataFrame([(i, v, "w", 1, 2) for i, v in rows], SCHEMA).repartition(7)
    found, want = got(W.whitened_embeddings(frame)), brute(rows, 5)
    assert [f[:4] for f in found] == [w[:4] for w in want]
    assert np.allclose([f[4:] for f in found], [w[4:] for w in want], rtol=1e-6, atol=1e-7)
    errors = {r.identity_error for r in W.whitened_embeddings(frame).collect()}
    assert len(errors) == 1 and 0 <= errors.pop() < 1e-9


def test_all_embeddings(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()][:]
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    out = W.whitened_embeddings(table).collect()
    assert len(out) == 16 * len(rows) and {r.n for r in out} == {len(fit)} and {r.identity_error < 1e-10 for r in out} == {True}
    values = np.sort(np.linalg.eigvalsh(np.cov(fit.T, bias=True)))[::-1]
    for k in range(16):
        assert abs(next(r.explained for r in out if r.component == k + 1) - values[k] / values.sum()) < 1e-9
    # components are uncorrelated over all rows' distinct vectors, one sign for all of them
    first = {tuple(v): i for v, (i, _) in zip(x.tolist(), rows)}
    w = {(r.vec_id, r.component): r.whitened for r in out}
    m = np.array([[w[i, k] for k in range(1, 17)] for i in first.values()])
    assert np.abs(np.cov(m.T, bias=True) - np.eye(16)).max() < 1e-9


def test_without_variance_and_empty(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, "w", 1, 2) for i, v in rows], SCHEMA)
    assert W.whitened_embeddings(frame([])).collect() == [] and W.whitened_embeddings(frame([(1, None), (2, [])])).collect() == []
    one = W.whitened_embeddings(frame([(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)] * 2
    line = W.whitened_embeddings(frame([(i, [float(i), float(2 * i)]) for i in range(10)])).collect()
    assert {r.component: r.whitened is None for r in line} == {1: False, 2: True} and line[0].identity_error < 1e-12


def test_large_entries_stay_exact(spark):
    """Deviations beyond numpy's longs are summed in whole numbers, and null where a long cannot hold them."""
    model = W.Whitening(10**6, (5 * 10**6 + 3,) * 2, np.zeros((2, 0)), np.zeros(0), 1.0)
    x = np.array([[5, 5], [3005, 5], [10**9, 0]])
    assert model.deviations(x) == [18, (3000 * 10**6 - 3) ** 2 + 9, None]
    huge = spark.createDataFrame([(1, [1e30], "w", 1, 2), (2, [1.0], "w", 1, 2), (3, [2.0], "w", 1, 2)], SCHEMA)
    assert {r.vec_id for r in W.whitened_embeddings(huge).collect()} == {2, 3}


@pytest.mark.parametrize("n", (1, 3, 9))
def test_partitions_change_nothing(spark, n):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v], "w", 1, 2) for i, v in enumerate(rng.normal(size=(50, 3)))]
    a, b = (got(W.whitened_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(k))) for k in (2, n))
    assert [r[:4] for r in a] == [r[:4] for r in b] and np.allclose([r[4:] for r in a], [r[4:] for r in b], atol=1e-9)
