"""Distances of all pairs of two point sets, and to the faces of a box."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.metrics import EUCLIDEAN, STRIPE, Metric, boundary_distance
from pointloom.operators.pairs import ROWS, pair_partials
from pointloom.schema import unitcube, vector


#: Points of a block on either side, whose pairs come sorted by distance.
SORTED = 4000


def distance_matrix(points: DataFrame, others: DataFrame, metric: Metric = EUCLIDEAN) -> DataFrame:
    """(a, b, dist) for every point and every other: as many rows as the definition asks for, made cell by cell.

    The pairs of two blocks come by distance: files of columns then hold equal distances, once they are rounded, as runs.
    """

    def kernel(ids, x, other, y, _):
        d = np.empty((len(x), len(y)))
        for lo in range(0, len(x), STRIPE):
            d[lo : lo + STRIPE] = metric.matrix(x[lo : lo + STRIPE], y)
        d = d.ravel()
        order = d.argsort()
        for lo in range(0, len(order), ROWS):
            at = order[lo : lo + ROWS]
            yield {"a": ids[at // len(other)], "b": other[at % len(other)], "dist": d[at]}

    return pair_partials(points, others, kernel, "a long, b long, dist double", block=SORTED)


def dists_to_boundary(points: DataFrame, dimension: int, cuboid: tuple[list[float], list[float]] | None = None) -> DataFrame:
    lo, hi = cuboid or unitcube(dimension)
    return points.select("point_id", boundary_distance(F.col("coords"), vector(lo), vector(hi)).alias("dist"))
