"""Iterative improvement of point sets.  Steps depend on each other, so what runs in parallel are restarts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.metrics import EUCLIDEAN, Metric, unit_torus
from pointloom.plans.strata import stratified_sampling, stratify_generalized
from pointloom.schema import positive

RESULT = "restart long, point_id long, coords array<double>"


#: Called in the task of a restart after every step, as (restart, step, points so far).
Observer = Callable[[int, int, np.ndarray], None]


def default_start(spark: SparkSession, n: int, dimension: int, seed: int) -> DataFrame:
    """The start that refinements begin from where none is given: a random point in each of n generalized strata."""
    return stratified_sampling(stratify_generalized(spark, n, dimension, seed), seed).select("point_id", "coords")


def _by_restart(initial: DataFrame, restarts: int, improve: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """``improve(points, restart)`` for copies of a point set whose size fits a task (a design is thousands of points)."""
    positive(restarts=restarts)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("point_id")
        restart = int(rows["restart"].iloc[0])
        points = improve(np.array(rows["coords"].tolist(), float), restart)
        return pd.DataFrame({"restart": restart, "point_id": rows["point_id"].to_numpy(), "coords": points.tolist()})

    copies = initial.select("point_id", "coords", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(restarts - 1).cast("long"))).alias("restart"))
    return copies.groupBy("restart").applyInPandas(run, RESULT)


def random_k_means(initial: DataFrame, seed: int, num_steps: int | None = None, metric: Metric = EUCLIDEAN, restarts: int = 1, near_image: bool = True, observer: Observer | None = None) -> DataFrame:
    """Online k-means: random points of the cube move their nearest centre towards them, by its weight.

    On a torus the point is taken at its image next to the centre (``near_image``), or at 1 - x below one half.
    """

    def improve(centres: np.ndarray, restart: int) -> np.ndarray:
        rng = np.random.default_rng([seed, restart])
        weight = np.ones(len(centres))
        for step in range(100 * len(centres) if num_steps is None else num_steps):
            x = rng.random(centres.shape[1])
            i = int(metric.matrix(x[None], centres)[0].argmin())
            c = centres[i]
            if metric.sizes is not None:
                far = np.abs(c - x) > 0.5
                x = np.where(far & (c < 0.5), x - 1 if near_image else 1 - x, np.where(far, x + 1, x))
            centres[i] = ((weight[i] * c + x) / (weight[i] + 1)) % 1.0
            weight[i] += 1
            if observer is not None:
                observer(restart, step, centres)
        return centres

    return _by_restart(initial, restarts, improve)


def maximin_reconstruction(initial: DataFrame, seed: int, num_steps: int | None = None, existing: list[list[float]] | None = None, reflect: bool = False, metric: Metric | None = None, restarts: int = 1, observer: Observer | None = None) -> DataFrame:
    """Exchange search that never lowers the least distance: a random point takes the place of the most crowded one.

    ``existing`` points keep their places and count; ``reflect`` counts twice the norm of the all-ones vector times
    the distance to the boundary as a distance.  The default metric is L1 on the unit torus.
    """

    def improve(points: np.ndarray, restart: int) -> np.ndarray:
        rng = np.random.default_rng([seed, restart])
        n, d = points.shape
        m = metric or unit_torus(d)
        fixed = np.array(existing, float).reshape(-1, d) if existing else np.zeros((0, d))
        scale = 2 * 2 * m.matrix(np.zeros((1, d)), np.full((1, d), 0.5))[0, 0]

        def room(x: np.ndarray, without: int) -> float:
            gaps = m.matrix(x[None], points)[0]
            gaps[without] = np.inf
            least = [gaps.min()]
            if len(fixed):
                least.append(m.matrix(x[None], fixed).min())
            if reflect:
                least.append(scale * min(x.min(), (1 - x).min()))
            return float(min(least))

        queue = list(rng.permutation(n))
        weakest = int(queue.pop())
        current = room(points[weakest], weakest)
        for step in range(100 * n if num_steps is None else num_steps):
            x = rng.random(d)
            gained = room(x, weakest)
            if gained >= current:
                points[weakest], current = x, gained
                queue = [i for i in rng.permutation(n) if i != weakest]
            elif queue:
                i = int(queue.pop())
                crowded = room(points[i], i)
                if crowded <= current:
                    weakest, current = i, crowded
            if observer is not None:
                observer(restart, step, points)
        return points

    return _by_restart(initial, restarts, improve)
