"""Cells against half planes of all points, and the covering radius against the search by boxes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import indicators, tessellation

POINTS = "point_id long, coords array<double>"


def areas_by_all_points(x):
    """The area of each cell, the square being cut by each other point in turn."""
    out = []
    for i, p in enumerate(x):
        cell = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
        for j, q in enumerate(x):
            if i == j:
                continue
            side = [(v[0] - (p[0] + q[0]) / 2) * (q[0] - p[0]) + (v[1] - (p[1] + q[1]) / 2) * (q[1] - p[1]) for v in cell]
            kept = []
            for k, v in enumerate(cell):
                w, s, t = cell[(k + 1) % len(cell)], side[k], side[(k + 1) % len(cell)]
                if s <= 0:
                    kept.append(v)
                if (s <= 0) != (t <= 0):
                    kept.append((v[0] + s / (s - t) * (w[0] - v[0]), v[1] + s / (s - t) * (w[1] - v[1])))
            cell = kept
        out.append(abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(cell, cell[1:] + cell[:1]))) / 2)
    return out


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], POINTS)


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(tessellation, "LEAF", 16)
    monkeypatch.setattr(tessellation, "ASKERS", 8)


def clusters(rng):
    """Dense corners with an empty middle, whose circles meet many leaves."""
    return np.concatenate([rng.random((60, 2)) * 0.05, 1 - rng.random((60, 2)) * 0.05, [[0.5, 0.02]]])


def lattice(_):
    return np.array([(i / 11, j / 11) for i in range(12) for j in range(12)])


def one_column(rng):
    return np.column_stack([np.where(np.arange(120) % 3 == 0, 0.25, rng.random(120)), rng.random(120)])


def outside(rng):
    return np.concatenate([rng.random((60, 2)), [[-1.0, 0.5], [1.2, 1.2], [0.5, 1.001]]])


@pytest.mark.parametrize("made", [lambda r: r.random((150, 2)), clusters, lattice, one_column, outside, lambda r: r.random((1, 2))])
def test_cells_equal_half_planes_of_all_points(spark, small_leaves, made):
    x = made(np.random.default_rng(5))
    got = {r.point_id: r.area for r in tessellation.areas_of(tessellation.voronoi_cells(frame(spark, x))).collect()}
    assert np.allclose([got[i] for i in range(len(x))], areas_by_all_points(x.tolist()), atol=1e-9)
    assert math.isclose(sum(got.values()), 1.0, abs_tol=1e-9)


def test_radius_equals_the_search_by_boxes(spark, small_leaves):
    points = frame(spark, np.random.default_rng(8).random((130, 2)))
    corner = tessellation.vertices_of(tessellation.voronoi_cells(points)).agg(F.max(F.struct("dist", "coords")).alias("m")).first()["m"]
    found = indicators.covering_radius_by_boxes(points, 2).first()
    assert abs(corner["dist"] - found["value"]) < 2e-7 and np.allclose(corner["coords"], found["place"], atol=1e-3)
    assert indicators.covering_radius(points, 2).first()["value"] == corner["dist"]


def test_corners_have_empty_circles(spark, small_leaves):
    x = clusters(np.random.default_rng(2))
    rows = tessellation.vertices_of(tessellation.voronoi_cells(frame(spark, x))).collect()
    for r in rows:
        assert abs(np.hypot(*(x - r["coords"]).T).min() - r["dist"]) < 1e-9
    assert {r["corner"] for r in rows if r["point_id"] == 0} == set(range(sum(r["point_id"] == 0 for r in rows)))


def test_repeated_places_and_refusals(spark):
    twice = frame(spark, [(0.2, 0.2), (0.2, 0.2), (0.8, 0.2)])
    assert {r.point_id: round(r.area, 9) for r in tessellation.areas_of(tessellation.voronoi_cells(twice)).collect()} == {0: 0.5, 2: 0.5}
    assert tessellation.voronoi_cells(frame(spark, [(0.5, 0.5)]).where("false")).count() == 0
    for bad in ([0.5], [0.5, None], [0.5, float("nan")], None):
        with pytest.raises(ValueError):
            tessellation.voronoi_cells(spark.createDataFrame([(1, bad)], POINTS))
