import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import dominance, indicators


def frame(spark, x, groups=None):
    rows = [(i, [float(v) for v in p], (groups[i] if groups is not None else 0), 7) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "point_id long, coords array<double>, g long, side int").repartition(3)


@pytest.mark.parametrize("dimension,slab", [(1, 16), (2, 16), (2, 4096), (3, 32)])
def test_sums_equal_all_pairs(spark, dimension, slab, monkeypatch):
    monkeypatch.setattr(dominance, "SLAB", slab)
    rng = np.random.default_rng(dimension)
    x = np.concatenate([rng.random((300, dimension)), np.round(rng.random((100, dimension)), 1), np.full((40, dimension), 0.5), np.zeros((3, dimension)), np.ones((3, dimension))])
    (row,) = dominance.dominance_sums(frame(spark, x), dimension).collect()
    assert np.isclose(row.pairs, dominance.pair_sum(x), rtol=1e-12)


def test_groups_are_apart(spark, monkeypatch):
    monkeypatch.setattr(dominance, "SLAB", 16)
    rng = np.random.default_rng(9)
    x, g = rng.random((400, 2)), np.where(rng.random(400) < 0.6, 0, rng.integers(1, 40, 400)).tolist()
    got = {r.by: r.pairs for r in dominance.dominance_sums(frame(spark, x, g), 2, "g").collect()}
    for k in set(g):
        assert np.isclose(got.get(k, 0.0), dominance.pair_sum(x[np.array(g) == k]), rtol=1e-12)


@pytest.mark.parametrize("dimension", (1, 2, 3, 4))
def test_discrepancy_equals_its_definition(spark, dimension, monkeypatch):
    monkeypatch.setattr(dominance, "SLAB", 16)
    rng = np.random.default_rng(dimension)
    x, g = rng.random((120, dimension)), (np.arange(120) % 3 + (np.arange(120) == 7) * 5).tolist()

    def plain(x):
        n, d = x.shape
        pairs = dominance._products(x, x).sum()
        return np.sqrt(pairs / n**2 - 2.0 ** (1 - d) / n * (x * (1 - x)).prod(1).sum() + 12.0**-d)

    points = frame(spark, x, g)
    assert np.isclose(indicators.unanchored_l2_discrepancy(points, dimension).first()[0], plain(x))
    got = {r.g: r.value for r in indicators.unanchored_l2_discrepancy(points, dimension, "g").collect()}
    assert set(got) == set(g) and all(np.isclose(v, plain(x[np.array(g) == k])) for k, v in got.items())
    assert indicators.unanchored_l2_discrepancy(points.limit(0), dimension).first()[0] == 0
