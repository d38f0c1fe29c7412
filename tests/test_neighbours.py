import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions.metrics import EUCLIDEAN, MANHATTAN, Metric
from pointloom.operators import indicators, neighbours

POINTS = "point_id long, coords array<double>, dist double, n int, lane int"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in p], 0.5, 3, 1) for i, p in enumerate(x)], POINTS).repartition(3)


def brute(metric, x, y=None):
    d = metric.matrix(x, x if y is None else y)
    if y is None:
        np.fill_diagonal(d, np.inf)
    return d.min(1)


METRICS = [EUCLIDEAN, Metric(1.0), Metric(math.inf), Metric(3.5), Metric(1.0, (1.0, 1.0)), Metric(2.0, (1.0, 1.0))]


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(4)
    near = np.concatenate([rng.random((350, 2)), 0.3 + rng.normal(size=(250, 2)) * 0.01])
    return np.clip(near, 0, 1), rng.random((300, 2))


@pytest.mark.parametrize("metric", METRICS, ids=str)
def test_distances_equal_all_pairs(spark, clouds, metric, monkeypatch):
    """Also where a lane holds few targets, so that cells are parted and points go to many groups."""
    x, y = clouds
    monkeypatch.setattr(neighbours, "LANE", 60)
    monkeypatch.setattr(neighbours, "SMALL", 30)
    got = {r.point_id: r.dist for r in neighbours.nearest_places(frame(spark, x), None, metric).collect()}
    assert np.allclose([got[i] for i in range(len(x))], brute(metric, x), atol=1e-12)
    got = {r.point_id: r.dist for r in neighbours.nearest_places(frame(spark, x), frame(spark, y, 5000), metric).collect()}
    assert np.allclose([got[i] for i in range(len(x))], brute(metric, x, y), atol=1e-12)
    least = neighbours.nearest_places(frame(spark, x), None, metric, closest_only=True).agg(F.min("dist")).first()[0]
    assert abs(least - brute(metric, x).min()) < 1e-12


def test_a_hot_place_is_one(spark, clouds):
    """A third of all points at one place are one row; ids come back for each."""
    x = np.concatenate([clouds[0], np.full((300, 2), 0.25), [[0.9, 0.9]] * 2])
    rows = neighbours.nearest_places(frame(spark, x)).collect()
    assert len(rows) == len(clouds[0]) + 2 and sum(r.n for r in rows) == len(x)
    assert {r.dist for r in rows if r.n > 1} == {0.0}


def test_few_pairs_are_compared(spark):
    x = np.random.default_rng(1).random((20_000, 2))
    rows = neighbours.nearest_places(frame(spark, x)).agg(F.sum("compared").alias("c"), F.sum("dist").alias("s")).first()
    assert rows.c < 0.05 * len(x) ** 2
    total = 0.0
    for i in range(0, len(x), 500):
        d = EUCLIDEAN.matrix(x[i : i + 500], x)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        total += d.min(1).sum()
    assert abs(rows.s - total) < 1e-6


def test_edges(spark):
    one = frame(spark, [[0.5, 0.5]])
    none = one.limit(0)
    assert [r.dist for r in neighbours.nearest_places(one).collect()] == [math.inf] and neighbours.nearest_places(none).collect() == []
    assert [r.dist for r in neighbours.nearest_places(one, none).collect()] == [math.inf] and neighbours.nearest_places(none, one).collect() == []
    with pytest.raises(ValueError):
        neighbours.nearest_places(one, None, Metric(0.5))


def test_measures_agree_with_all_pairs(spark, clouds, monkeypatch):
    x, y = (np.concatenate([c, c[:7]]) for c in clouds)
    a, b = frame(spark, x), frame(spark, y, 5000)
    measures = [
        lambda: indicators.separation_dist(a.where("point_id < 600")), lambda: indicators.separation_dist(a), lambda: indicators.sum_of_nn_dists(a), lambda: indicators.hausdorff_dist(a, b),
        lambda: indicators.averaged_hausdorff_dist(a, b, 2), lambda: indicators.covering_radius_lower_bound(a, b), lambda: indicators.nearest(a).agg(F.sum("dist"), F.count("*")), lambda: indicators.nearest(b, a).agg(F.sum("dist"), F.count("*")),
    ]
    plain = [tuple(m().first()) for m in measures]
    monkeypatch.setattr(indicators, "FEW", 10)
    for m, want in zip(measures, plain):
        assert np.allclose(tuple(m().first()), want, atol=1e-12)


def test_bounds_are_left_where_they_leave_nothing_out(spark, monkeypatch):
    """In many dimensions all places are compared at once, copies counted; the measures are the same."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(500, 32)), rng.normal(size=(300, 32))
    x[400:450] = x[:50]
    a, b = frame(spark, x), frame(spark, y, 5000)
    assert neighbours.bounds_help(frame(spark, rng.random((3000, 2)))) and not neighbours.bounds_help(a) and not neighbours.bounds_help(a, b)
    monkeypatch.setattr(indicators, "FEW", 10)
    monkeypatch.setattr(indicators, "nearest_places", None)
    own, to, fro = brute(EUCLIDEAN, x), brute(EUCLIDEAN, x, y), brute(EUCLIDEAN, y, x)
    got = [m.first()[0] for m in (indicators.sum_of_nn_dists(a), indicators.separation_dist(a.where("point_id < 400")), indicators.hausdorff_dist(a, b), indicators.averaged_hausdorff_dist(a, b, 2))]
    want = [own.sum(), brute(EUCLIDEAN, x[:400]).min(), max(to.max(), fro.max()), max((to**2).sum() / 500**0.5, (fro**2).sum() / 300**0.5)]
    assert np.allclose(got, want, rtol=1e-10)
    assert {r.point_id: r.dist for r in indicators.nearest(a).collect()} == pytest.approx(dict(enumerate(own)), abs=1e-9)


def test_groups_are_searched_by_bounds(spark, monkeypatch):
    """Groups in two dimensions: as from all pairs, with ids that repeat, copies, groups of one and a group that one side lacks."""
    rng = np.random.default_rng(3)
    n = 900
    group, x = rng.integers(0, 6, n), np.round(rng.random((n, 2)) * [3.0, 0.5], 2)
    group[:2] = 50, 51
    rows = lambda at: spark.createDataFrame([(f"g{group[i]}", int((group[at[:k]] == group[i]).sum()), x[i].tolist()) for k, i in enumerate(at)], "g string, point_id long, coords array<double>")
    points, probes = rows(np.arange(0, 500)), rows(np.append(np.arange(500, n), 1))
    every = points.groupBy("g", "coords").agg(F.min("point_id").alias("point_id"))
    plain = lambda df: sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.collect())
    ask = lambda: [plain(f) for f in (
        indicators.covering_radius_lower_bound(points, probes, by="g"),
        indicators.hausdorff_dist(points, probes, by="g"),
        indicators.sum_of_nn_dists(every, by="g"),
        indicators.separation_dist(every, MANHATTAN, by="g"),
    )]
    want = ask()
    monkeypatch.setattr(indicators, "FEW", 10)
    monkeypatch.setattr(indicators, "_nearest_of_all", None)
    monkeypatch.setattr(indicators, "pair_partials", None)
    assert ask() == want and [g for g, _ in want[0]] == ["g0", "g1", "g2", "g3", "g4", "g5", "g51"]
