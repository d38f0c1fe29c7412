"""Space-filling designs: grids, Latin hypercubes, and the greedy design of large gaps."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.metrics import Metric, unit_torus
from pointloom.functions.rng import permuted
from pointloom.schema import positive


def whole_root(n: int, d: int) -> int:
    """The integer whose d-th power is n."""
    positive(n=n, dimension=d)
    p = round(n ** (1 / d))
    for q in (p - 1, p, p + 1):
        if q >= 1 and q**d == n:
            return q
    raise ValueError(f"{n} is no {d}-th power of an integer")


def _digits(p: int, d: int) -> list:
    """Digits of point_id in base p, the last dimension fastest."""
    return [F.pmod(F.floor(F.col("point_id") / F.lit(p ** (d - 1 - j))), F.lit(p)).cast("double") for j in range(d)]


def grid(spark: SparkSession, n: int, dimension: int) -> DataFrame:
    """Full factorial design with the boundary; needs two points for each axis at least."""
    p = whole_root(n, dimension)
    if p < 2:
        raise ValueError("a grid with its boundary needs two points for each axis")
    return spark.range(n).withColumnRenamed("id", "point_id").select("point_id", F.array(*[x / (p - 1) for x in _digits(p, dimension)]).alias("coords"))


def sukharev_grid(spark: SparkSession, n: int, dimension: int) -> DataFrame:
    """Full factorial design of cell centres."""
    p = whole_root(n, dimension)
    return spark.range(n).withColumnRenamed("id", "point_id").select("point_id", F.array(*[(x + 0.5) / p for x in _digits(p, dimension)]).alias("coords"))


def lhd(spark: SparkSession, n: int, dimension: int, seed: int, identity_first: bool = False) -> DataFrame:
    """Random Latin hypercube: a seeded bijection of the rows for each column, without a shuffle."""
    positive(n=n, dimension=dimension)
    columns = [F.col("id") if identity_first and j == 0 else permuted(F.col("id"), n, F.xxhash64(F.lit(seed), F.lit(j))) for j in range(dimension)]
    return spark.range(n).select(F.col("id").alias("point_id"), F.array(*[c.cast("int") for c in columns]).alias("bins"))


def sudoku(spark: SparkSession, dimension: int, boxes: int, per_box: int, seed: int) -> DataFrame:
    """Latin hypercube with ``per_box`` points in each of boxes**dimension sub-boxes.

    Row r is point j = r mod boxes**dimension of round t; the digits of j in
    base ``boxes`` are its box, and the points that share a digit take the
    places of that digit's permutation in turn.
    """
    positive(dimension=dimension, boxes=boxes, per_box=per_box)
    m, cells = per_box * boxes ** (dimension - 1), boxes**dimension
    t, j = F.floor(F.col("id") / F.lit(cells)), F.pmod(F.col("id"), F.lit(cells))
    bins = []
    for d in range(dimension):
        digit = F.pmod(F.floor(j / F.lit(boxes**d)), F.lit(boxes))
        slot = t * F.lit(boxes ** (dimension - 1)) + F.floor(j / F.lit(boxes ** (d + 1))) * F.lit(boxes**d) + F.pmod(j, F.lit(boxes**d))
        bins.append((digit * m + permuted(slot, m, F.xxhash64(F.lit(seed), F.lit(d), digit.cast("long")))).cast("int"))
    return spark.range(boxes * m).select(F.col("id").alias("point_id"), F.array(*bins).alias("bins"))


def improved_lhd(spark: SparkSession, n: int, dimension: int, seed: int, candidates: int = 100, target: float = math.inf, metric: Metric | None = None, restarts: int = 1) -> DataFrame:
    """Greedy Latin hypercubes (restart, point_id, bins): each next point is the best of ``candidates`` from free bins.

    Best is the largest distance to the chosen points, or the one nearest to a finite target.  Quadratic in n
    and inherently sequential: restarts are what runs in parallel.  The default metric is L1 on a torus of n - 1 bins.
    """
    positive(n=n, dimension=dimension, candidates=candidates, restarts=restarts)
    metric = metric or (Metric(1.0, (n - 1.0,) * dimension) if n > 1 else unit_torus(dimension))

    def design(rows: pd.DataFrame) -> pd.DataFrame:
        restart = int(rows["restart"].iloc[0])
        rng = np.random.default_rng([seed, restart])
        free = [list(rng.permutation(n)) for _ in range(dimension)]
        chosen = np.array([[f.pop() for f in free]], float)
        while free[0]:
            left = len(free[0])
            pool = np.stack([np.concatenate([rng.permutation(f) for _ in range(-(-candidates // left))])[:candidates] for f in free], 1).astype(float)
            gaps = metric.matrix(pool, chosen).min(1)
            best = int(np.argmax(gaps)) if math.isinf(target) else int(np.argmin(np.abs(gaps - target)))
            chosen = np.vstack([chosen, pool[best]])
            for f, x in zip(free, pool[best]):
                f.remove(int(x))
        return pd.DataFrame({"restart": restart, "point_id": np.arange(n), "bins": [r.astype("int32").tolist() for r in chosen]})

    return spark.range(restarts).withColumnRenamed("id", "restart").groupBy("restart").applyInPandas(design, "restart long, point_id long, bins array<int>")

