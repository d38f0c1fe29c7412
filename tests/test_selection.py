import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions.metrics import EUCLIDEAN, MANHATTAN, Metric
from pointloom.operators import selection

POINTS = "point_id long, coords array<double>, crit double, cluster_id int"


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p], 1.0, 5) for i, p in enumerate(x)], POINTS).repartition(3)


def plain(kind, x, k, start, metric, e=3.0):
    """Picks one after another, each from all points."""
    gap = (lambda d: np.where(d == 0, np.inf, -np.log(np.maximum(d, 1e-300)) if e == 0 else 1 / np.maximum(d, 1e-300) ** e)) if kind == "energy" else (lambda d: d)
    g = gap(metric.matrix(x, np.array([start])))[:, 0]
    crit, largest, mask, picks = g, kind != "energy", kind != "maximin", []
    out = -np.inf if largest else np.inf
    for _ in range(k):
        i = int(np.argmax(crit) if largest else np.argmin(crit))
        picks.append(i)
        g = gap(metric.matrix(x, x[i][None]))[:, 0]
        crit = np.minimum(crit, g) if kind == "maximin" else crit + g
        if mask:
            crit[picks] = out
    return picks


SETS = {"cloud": lambda r: r.random((700, 2)), "grid": lambda r: np.array([(i // 20 / 20, i % 20 / 20) for i in range(400)]), "copies": lambda r: np.repeat(r.random((60, 3)), 4, axis=0), "few": lambda r: r.random((5, 1))}


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("kind", ("maximin", "maxisum", "energy"))
def test_picks_equal_a_plain_search(spark, kind, name, monkeypatch):
    x = SETS[name](np.random.default_rng(2))
    monkeypatch.setattr(selection, "CELLS", 16)
    monkeypatch.setattr(selection, "PICKS", 7)
    monkeypatch.setattr(selection, "CANDIDATES", 3)
    k, d = min(25, len(x) // (4 if name == "copies" else 1)), x.shape[1]
    origin = spark.createDataFrame([(-1, [0.0] * d)], "point_id long, coords array<double>")
    f = {"maximin": selection.select_greedy_maximin, "maxisum": selection.select_greedy_maxisum, "energy": lambda *a: selection.select_greedy_energy(a[0], a[1], d, a[2], 3.0)}[kind]
    got = [r.point_id for r in f(frame(spark, x), k, origin).orderBy("pos").collect()]
    assert got == plain(kind, x, k, [0.0] * d, EUCLIDEAN)


@pytest.mark.parametrize("metric", [MANHATTAN, Metric(math.inf), Metric(2.0, (1.0, 1.0))], ids=str)
def test_other_metrics(spark, metric):
    x = np.random.default_rng(3).random((500, 2))
    origin = spark.createDataFrame([(-1, [0.0, 0.0])], "point_id long, coords array<double>")
    got = [r.point_id for r in selection.select_greedy_maximin(frame(spark, x), 30, origin, metric).orderBy("pos").collect()]
    assert got == plain("maximin", x, 30, [0.0, 0.0], metric)
    got = [r.point_id for r in selection.select_greedy_energy(frame(spark, x), 20, 2, origin, 0, metric).orderBy("pos").collect()]
    assert got == plain("energy", x, 20, [0.0, 0.0], metric, 0)


def test_few_passes_for_many_picks(spark, monkeypatch):
    x, passes, real = np.random.default_rng(4).random((4000, 2)), [], selection.gathered
    monkeypatch.setattr(selection, "gathered", lambda *a: passes.append(1) or real(*a))
    seen = []
    picks = selection.select_greedy_maximin(frame(spark, x), 200, observer=lambda *a: seen.append(a))
    assert len(passes) <= 50 and [s[:2] for s in seen] == [(r.pos, r.point_id) for r in picks.orderBy("pos").collect()]
    assert all(a[2] >= b[2] for a, b in zip(seen, seen[1:]))


def greedy_halves(x, k):
    """Clusters by splitting the widest one, again and again."""
    cluster = np.zeros(len(x), int)
    for new in range(1, k):
        extents = [np.ptp(x[cluster == c], axis=0) for c in range(new)]
        c = max(range(new), key=lambda c: (extents[c].max(), -c))
        j = int(extents[c].argmax())
        own = np.flatnonzero(cluster == c)
        middle = (x[own, j].min() + x[own, j].max()) / 2
        cluster[own[x[own, j] >= middle]] = new
    return cluster


@pytest.mark.parametrize("x,k", [(np.random.default_rng(5).random((500, 3)), 60), (SETS["grid"](None), 33), (np.exp(-np.arange(40.0))[:, None], 25), (np.zeros((5, 2)), 1)], ids=["cloud", "grid", "uneven", "same"])
def test_clusters_equal_splits_one_by_one(spark, x, k):
    got = {r.point_id: r.cluster_id for r in selection.psa_partition(frame(spark, x), k, x.shape[1]).collect()}
    assert [got[i] for i in range(len(x))] == greedy_halves(x, k).tolist()


def test_a_thousand_clusters_in_twenty_jobs(spark):
    points = frame(spark, np.random.default_rng(6).random((5000, 2)))
    spark.sparkContext.setJobGroup("bisection", "")
    n = selection.psa_partition(points, 1000, 2).select(F.count_distinct("cluster_id")).first()[0]
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("bisection"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert n == 1000 and jobs <= 20


def test_refusals(spark):
    same = frame(spark, np.zeros((3, 2)))
    for bad in (lambda: selection.psa_partition(same, 2, 2), lambda: selection.psa_partition(same.limit(0), 1, 2), lambda: selection.psa_partition(same, 0, 2), lambda: selection.select_greedy_maximin(same, 4), lambda: selection.select_greedy_maximin(same, 0)):
        with pytest.raises(ValueError):
            bad()
    assert [r.point_id for r in selection.select_greedy_maximin(same, 3).orderBy("pos").collect()] == [0, 0, 0]


def test_points_equally_far_from_a_mean_are_ties(spark):
    """On a full grid two points are next to the mean, whose last digits are noise: the smaller id is taken for any order of the rows."""
    ids = np.random.default_rng(7).permutation(25 * 250)
    cells = [(int(i), 7, [k // 250 / 49, ((900 + k % 250 / 10) - 900) / 100]) for k, i in enumerate(ids)]
    want = min(int(ids[12 * 250 + k]) for k in (124, 125))
    for seed in range(4):
        order = np.random.default_rng(seed).permutation(len(cells))
        clusters = spark.createDataFrame([cells[k] for k in order], "point_id long, cluster_id int, coords array<double>").repartition(seed + 1)
        assert [r.point_id for r in selection.representatives(clusters, 2, "center_of_mass").collect()] == [want]
