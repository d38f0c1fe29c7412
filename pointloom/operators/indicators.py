"""Measures of diversity, coverage and discrepancy; each gives one row with a column ``value``.

Measures of pairs and of neighbours take ``by``, a column that is never null, and then give a row for each of its values.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.functions.metrics import EUCLIDEAN, Metric, boundary_distance
from pointloom.functions.numbers import binomial
from pointloom.operators.dominance import dominance_sums
from pointloom.operators.neighbours import PIVOT_BYTES, bounds_help, has_triangles, nearest_places, places
from pointloom.operators.pairs import BLOCK, lane_counts, pair_partials
from pointloom.operators.tessellation import vertices_of, voronoi_cells
from pointloom.plans.ranks import ranked, stored
from pointloom.schema import unitcube, vector


def _upper(d: np.ndarray, same: bool) -> np.ndarray:
    """Distances of the pairs that count once."""
    return d[np.triu_indices(len(d), 1)] if same else d.ravel()


def _measured(rows: DataFrame, by: str | None, value: Column) -> DataFrame:
    return rows.groupBy(by).agg(value) if by else rows.agg(value)


def separation_dist(points: DataFrame, metric: Metric = EUCLIDEAN, by: str | None = None) -> DataFrame:
    """Least distance of two points; 0 for fewer than two."""
    least = F.min("dist")
    return _measured(_near(points, None, metric, by, closest_only=True), by, F.when(least < float("inf"), least).otherwise(F.lit(0.0)).alias("value"))


def sum_of_dists(points: DataFrame, metric: Metric = EUCLIDEAN, by: str | None = None) -> DataFrame:
    """Square root of the sum of all distances."""

    def kernel(_, x, __, y, same):
        return {"total": _upper(metric.quick(x, y), same).sum()}

    return _measured(pair_partials(points, None, kernel, "total double", by=by), by, F.sqrt(F.coalesce(F.sum("total"), F.lit(0.0))).alias("value"))


def _sum_of_powers(x: np.ndarray, e: float) -> float:
    """In pieces that stay in a core's cache; small whole powers are products, which take a tenth of the time."""
    return sum(float((reduce(np.multiply, [part] * int(e)) if e in (1, 2, 3, 4) else part**e).sum()) for part in np.array_split(x, -(-len(x) // 32_768)))


def average_inverse_dist(points: DataFrame, dimension: int, exponent: float | None = None, max_dist: float = 1.0, metric: Metric = EUCLIDEAN, by: str | None = None) -> DataFrame:
    """(sum of (max_dist / d)**e)**(1/e) over the number of pairs; infinite if two points agree, 0 for fewer than two."""
    e = dimension + 1.0 if exponent is None else float(exponent)

    def kernel(_, x, __, y, same):
        d = _upper(metric.quick(x, y), same)
        with np.errstate(divide="ignore"):
            return {"total": _sum_of_powers(np.divide(max_dist, d, out=d), e), "pairs": len(d)} if len(d) else {"total": 0.0, "pairs": 0}

    total, pairs = F.coalesce(F.sum("total"), F.lit(0.0)), F.coalesce(F.sum("pairs"), F.lit(0))
    return _measured(pair_partials(points, None, kernel, "total double, pairs long", by=by), by, F.when(pairs > 0, F.pow(total, F.lit(1 / e)) / F.nullif(pairs, F.lit(0))).otherwise(F.lit(0.0)).alias("value"))


#: Points of a set whose nearest neighbours one round over all pairs finds; larger sets are searched by bounds.
FEW = 4096


def _few(points: DataFrame, others: DataFrame | None) -> bool:
    return all(p.limit(FEW + 1).count() <= FEW for p in (points, others) if p is not None)


def _nearest_of_all(points: DataFrame, others: DataFrame | None, metric: Metric, by: str | None) -> DataFrame:
    """(by, point_id, dist) from all pairs, cell by cell."""
    two_sets = others is not None

    def kernel(ids, x, other, y, same):
        d = metric.quick(x, y)
        if same:
            np.fill_diagonal(d, np.inf)
        if two_sets or same:
            return {"point_id": ids, "dist": d.min(1)}
        return {"point_id": np.concatenate([ids, other]), "dist": np.concatenate([d.min(1), d.min(0)])}

    return pair_partials(points, others, kernel, "point_id long, dist double", by=by).groupBy(*([by] if by else []), "point_id").agg(F.min("dist").alias("dist"))


def _of_places(points: DataFrame, others: DataFrame | None, metric: Metric, closest_only: bool = False) -> DataFrame:
    """(point_id, dist, n) for each place: by triangle bounds, or from all pairs of places where bounds leave too few out."""
    if bounds_help(points, others, metric):
        return nearest_places(points, others, metric, closest_only).select("point_id", "dist", "n")
    mine = stored(places(points))
    found = _nearest_of_all(mine, None if others is None else places(others), metric, None).join(mine.select("point_id", "n"), "point_id")
    return found.withColumn("dist", F.when(F.col("n") > 1, 0.0).otherwise(F.col("dist"))) if others is None else found


#: Dimensions up to which points of groups are searched by bounds; in more of them bounds may leave too few pairs out.
FLAT = 3


def _searched_in_groups(points: DataFrame, others: DataFrame | None, metric: Metric) -> bool:
    first = points.select(F.size("coords").alias("d")).first()
    return has_triangles(metric) and metric.sizes is None and first is not None and first["d"] <= FLAT and not _few(points, others)


def _nearest_in_groups(points: DataFrame, others: DataFrame | None, metric: Metric, by: str) -> DataFrame:
    """(by, coords, point_id, dist, n) for each place of a group, by triangle bounds over all groups at once.

    A further coordinate sets groups farther apart than points of one group can lie, so that the nearest place is one
    of the same group, at the distance that it has without the coordinate.
    """
    sets = [p.groupBy(by, "coords").agg(F.min("point_id").alias("point_id"), F.count("*").alias("n")) for p in (points, others) if p is not None]
    if others is not None:
        # a group that one side lacks has no pairs
        sets = [p.join(other.select(by).distinct(), by, "left_semi") for p, other in zip(sets, (others, points))]
    groups = stored(ranked(sets[0].select(by).distinct(), F.col(by), name="_group"))
    sets = [stored(p.join(groups, by).withColumn("_place", F.monotonically_increasing_id())) for p in sets]
    width = points.select(F.size("coords").alias("d")).first()["d"]
    ends = [f(F.get("coords", j)) for j in range(width) for f in (F.max, F.min)]
    found = reduce(DataFrame.unionAll, [p.select("coords") for p in sets]).agg(*ends).first()
    spread = sum(found[2 * j] - found[2 * j + 1] for j in range(width)) if found[0] is not None else 0.0
    # a power of two, so that multiples are exact
    apart = 2.0 ** math.ceil(math.log2(2 * spread)) if spread > 0 else 1.0
    lifted = [p.select(F.col("_place").alias("point_id"), F.concat("coords", F.array(F.col("_group") * apart)).alias("coords")) for p in sets]
    near = nearest_places(lifted[0], lifted[1] if others is not None else None, metric).select(F.col("point_id").alias("_place"), "dist")
    own = F.when(F.col("dist") <= apart / 2, F.col("dist")).otherwise(F.lit(float("inf")))
    dist = own if others is not None else F.when(F.col("n") > 1, 0.0).otherwise(own)
    return sets[0].join(near, "_place").select(by, "coords", "point_id", dist.alias("dist"), "n")


def _near(points: DataFrame, others: DataFrame | None, metric: Metric, by: str | None = None, closest_only: bool = False) -> DataFrame:
    """(by, dist, n): distances to the nearest other point, or the nearest of ``others``, and how many points have each.

    Sets beyond a few points are searched by triangle bounds where the metric has them, groups in few dimensions only.
    """
    if by and _searched_in_groups(points, others, metric):
        return _nearest_in_groups(points, others, metric, by).select(by, "dist", "n")
    if by or not has_triangles(metric) or _few(points, others):
        return _nearest_of_all(points, others, metric, by).withColumn("n", F.lit(1).cast("long"))
    return _of_places(points, others, metric, closest_only).select("dist", "n")


def nearest(points: DataFrame, others: DataFrame | None = None, metric: Metric = EUCLIDEAN, by: str | None = None) -> DataFrame:
    """(point_id, dist): distance of each point to the nearest other one, or to the nearest of ``others``."""
    if by and _searched_in_groups(points, others, metric):
        return points.select(by, "point_id", "coords").join(_nearest_in_groups(points, others, metric, by).select(by, "coords", "dist"), [by, "coords"]).select(by, "point_id", "dist")
    if by or not has_triangles(metric) or _few(points, others):
        return _nearest_of_all(points, others, metric, by)
    found = _of_places(points, others, metric)
    there = places(points).withColumnRenamed("point_id", "_place").join(found.select(F.col("point_id").alias("_place"), "dist"), "_place").select("coords", "dist")
    return points.select("point_id", "coords").join(there, "coords").select("point_id", "dist")


def sum_of_nn_dists(points: DataFrame, metric: Metric = EUCLIDEAN, by: str | None = None) -> DataFrame:
    """Sum of nearest-neighbour distances; 0 for fewer than two points."""
    finite = F.when(F.col("dist") < float("inf"), F.col("dist") * F.col("n"))
    return _measured(_near(points, None, metric, by), by, F.coalesce(F.sum(finite), F.lit(0.0)).alias("value"))


def _nearest_of_both(points: DataFrame, others: DataFrame, metric: Metric, by: str | None = None) -> DataFrame:
    """(by, side, dist, n): distances of the points of either set to the nearest of the other."""
    searched = not by and has_triangles(metric) and not _few(points, others)
    if (searched and bounds_help(points, others, metric)) or (by and _searched_in_groups(points, others, metric)):
        return _near(points, others, metric, by).withColumn("side", F.lit(0)).unionByName(_near(others, points, metric, by).withColumn("side", F.lit(1)))

    def kernel(ids, x, other, y, _):
        d = metric.quick(x, y)
        return {"side": np.repeat([0, 1], [len(ids), len(other)]), "point_id": np.concatenate([ids, other]), "dist": np.concatenate([d.min(1), d.min(0)])}

    counts = None
    if searched:
        points, others = stored(places(points)), stored(places(others))
        counts = points.select(F.lit(0).alias("side"), "point_id", "n").unionAll(others.select(F.lit(1).alias("side"), "point_id", "n"))
    met = pair_partials(points, others, kernel, "side int, point_id long, dist double", by=by)
    least = met.groupBy(*([by] if by else []), "side", "point_id").agg(F.min("dist").alias("dist"))
    return least.join(counts, ["side", "point_id"]) if searched else least.withColumn("n", F.lit(1).cast("long"))


def hausdorff_dist(points: DataFrame, others: DataFrame, metric: Metric = EUCLIDEAN, by: str | None = None) -> DataFrame:
    """Largest distance of a point of either set to the nearest of the other; with ``by`` for each group that both sets have."""
    return _measured(_nearest_of_both(points, others, metric, by), by, F.max("dist").alias("value"))


def averaged_hausdorff_dist(points: DataFrame, others: DataFrame, exponent: float = 1, metric: Metric = EUCLIDEAN, by: str | None = None) -> DataFrame:
    """The larger of both directions' sum of nearest distances to the power e, over the size to the power 1/e."""
    if math.isinf(exponent):
        return hausdorff_dist(points, others, metric, by)
    if exponent <= 0:
        raise ValueError("the exponent must be positive")
    side = (F.sum(F.pow("dist", F.lit(float(exponent))) * F.col("n")) / F.pow(F.sum("n"), F.lit(1 / exponent))).alias("value")
    return _measured(_nearest_of_both(points, others, metric, by).groupBy(*([by] if by else []), "side").agg(side), by, F.max("value").alias("value"))


def covering_radius_lower_bound(points: DataFrame, probes: DataFrame, metric: Metric = EUCLIDEAN, by: str | None = None) -> DataFrame:
    """Largest distance of a probe to its nearest point; infinite without points.  With ``by`` for each group that both sets have."""
    return _measured(_near(probes, points, metric, by), by, F.coalesce(F.max("dist"), F.lit(float("inf"))).alias("value"))


def covering_radius_upper_bound(points: DataFrame, strata: DataFrame, metric: Metric = EUCLIDEAN, by: str | None = None) -> DataFrame:
    """Largest distance of a point to the farthest corner of its own stratum; infinite without points.  ``by`` is a column of the points."""
    joined = points.join(strata.select(F.col("stratum_id").alias("point_id"), "lo", "hi"), "point_id")
    corner = F.transform(F.arrays_zip("coords", "lo", "hi"), lambda s: F.when(s["coords"] - s["lo"] > s["hi"] - s["coords"], s["lo"]).otherwise(s["hi"]))
    return _measured(joined, by, F.coalesce(F.max(metric.column(F.col("coords"), corner)), F.lit(float("inf"))).alias("value"))


def covering_radius_1d(points: DataFrame) -> DataFrame:
    """Exact covering radius of points of [0, 1]: half the widest gap, or a gap to an end.

    Ranges of points give their bounds and widest gap; only those few rows come to one task.
    """
    width = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x = points.select(F.get("coords", 0).alias("x")).where("x IS NOT NULL")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, gap = None, None, 0.0
        for batch in batches:
            if len(batch):
                v = batch["x"].to_numpy()
                low, high = (v[0], v[0]) if low is None else (low, high)
                gap, high = np.diff(v, prepend=high).max(initial=gap), v[-1]
        if low is not None:
            yield pa.RecordBatch.from_pydict({"low": [float(low)], "high": [float(high)], "gap": [float(gap)]})

    ranges = x.repartitionByRange(width, "x").sortWithinPartitions("x").mapInArrow(bounds, "low double, high double, gap double")
    gaps = ranges.withColumn("between", F.col("low") - F.lag("high").over(Window.orderBy("low")))  # one row for each range
    widest = F.greatest(F.max("gap"), F.max("between")) / 2
    return gaps.agg(F.coalesce(F.greatest(widest, F.min("low"), 1 - F.max("high")), F.lit(float("inf"))).alias("value"))


#: Points for which measures without a decomposable form are computed, at most.
EXACT_POINTS = {"covering_radius": 40, "solow_polasky": 5000, "weitzman": 16}


#: Points of the small sets that one call in a task takes, about, and entries of a stack of their matrices.
TOGETHER, STACK = 8192, 1 << 20


def _whole(points: DataFrame, name: str, measure: Callable[[np.ndarray], np.ndarray], by: str | None = None) -> DataFrame:
    """A measure of whole sets of bounded size; larger ones are refused. ``measure`` takes stacks (sets, points, dimensions) of sets of one size.

    Sets are dealt by hash to parts of about ``TOGETHER`` points, so that a call in a task serves thousands of small sets.
    """
    most = EXACT_POINTS[name]
    few = points.select("point_id", "coords", *([by] if by else [F.lit(0).alias("whole")]))
    if not by:
        few = few.orderBy("point_id").limit(most + 1)
    key = by or "whole"
    parts = max(1, math.ceil(points.count() / TOGETHER)) if by else 1
    fields = T.StructType([T.StructField(key, few.schema[key].dataType), T.StructField("value", T.DoubleType())])

    def run(_: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        sets = rows[key].combine_chunks().dictionary_encode()
        own, size = sets.indices.to_numpy(zero_copy_only=False), np.bincount(sets.indices.to_numpy(zero_copy_only=False))
        if size.max() > most:
            raise ValueError(f"{name} takes {most} points at most")
        order = np.lexsort([rows["point_id"].to_numpy(), own])
        x = np.asarray(rows["coords"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), -1)[order]
        first, value = np.cumsum(size) - size, np.empty(len(size))
        for n in np.unique(size):
            alike = np.flatnonzero(size == n)
            step = max(1, STACK // (n * max(n, x.shape[1])))
            for lo in range(0, len(alike), step):
                at = alike[lo : lo + step]
                value[at] = measure(x[first[at][:, None] + np.arange(n)])
        return pa.table([sets.dictionary, pa.array(value)], schema=to_arrow_schema(fields))

    out = few.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("_part")).applyInArrow(run, fields)
    return out if by else out.select("value")


#: Points around a box, at most, for its search to be ended in one task; live pieces of boxes that a task divides at once.
AROUND, PIECES = 256, 16_384


def _ended_in_tasks(boxes: DataFrame, points: DataFrame, dimension: int, half: float, best: tuple, tolerance: float) -> tuple[tuple, DataFrame]:
    """The best place, now also among boxes with few points around, whose searches tasks end on their own; and the other boxes.

    No middle lies farther from the points than ``best``, so all points that can be nearest to a place of a box lie
    within ``reach`` of the cells of a grid that the box's middle meets.
    """
    reach = (best[0] + 2 * half * math.sqrt(dimension)) * (1 + 1e-9)
    cell = F.transform("coords", lambda x: F.floor(x / reach))
    around = points.select("coords").distinct().select("coords", cell.alias("cell"))
    for j in range(dimension):
        moved = F.array(*[F.get("cell", k) + F.col("_step") if k == j else F.get("cell", k) for k in range(dimension)])
        around = around.withColumn("_step", F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))).select("coords", moved.alias("cell"))
    met = boxes.withColumn("cell", cell)
    around = around.join(met.select("cell").distinct(), "cell", "left_semi")
    few = around.groupBy("cell").count().where(F.col("count") <= AROUND).select("cell")
    lists = around.join(few, "cell").groupBy("cell").agg(F.flatten(F.collect_list("coords")).alias("near"))
    met = stored(met.join(lists, "cell", "left"), estimated=False)
    signs = np.array(np.meshgrid(*[[-1.0, 1.0]] * dimension)).reshape(dimension, -1).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, place = best
        for batch in batches:
            for k in range(len(batch)):
                x = batch["near"][k].values.to_numpy().reshape(-1, dimension)
                stack = [(batch["coords"][k].values.to_numpy()[None], half)]
                while stack:
                    middles, size = stack.pop()
                    size, middles = size / 2, (middles[:, None] + signs * (size / 2)).reshape(-1, dimension)
                    dist = EUCLIDEAN.matrix(middles, x).min(1)
                    if dist.max() > value:
                        value, place = float(dist.max()), middles[dist.argmax()].tolist()
                    live = middles[dist + size * math.sqrt(dimension) > value + tolerance]
                    if size * math.sqrt(dimension) > tolerance:
                        stack += [(live[lo : lo + PIECES], size) for lo in range(0, len(live), PIECES)]
        yield pa.RecordBatch.from_pydict({"value": pa.array([value]), "place": pa.array([place], pa.list_(pa.float64()))})

    found = met.where("near IS NOT NULL").select("coords", "near").mapInArrow(run, "value double, place array<double>").agg(F.max(F.struct("value", "place")).alias("best")).first()["best"]
    if found is not None:
        best = max(best, (found["value"], list(found["place"])))
    return best, met.where("near IS NULL").select("coords", "dist")


def covering_radius_by_boxes(points: DataFrame, dimension: int, tolerance: float = 1e-7) -> DataFrame:
    """(value, place): covering radius in the unit cube of any number of points, to a tolerance, and where it is reached.

    The distance to the nearest point changes no faster than the place, so a box is done with when its middle's
    distance and half its diagonal stay below the largest distance of a middle; other boxes are divided.
    Boxes stay rows, and the driver holds the best place and the size of a box. In up to three dimensions boxes that
    have few points around are divided to the end in tasks, beside those points.
    """
    parts = {1: 16, 2: 8, 3: 4}.get(dimension, 2)
    spark, half, best = points.sparkSession, 0.5, (0.0, [0.5] * dimension)
    boxes = spark.createDataFrame([(0, [0.5] * dimension)], "point_id long, coords array<double>")
    if points.isEmpty():
        return spark.createDataFrame([(math.inf, None)], "value double, place array<double>")
    while True:
        half /= parts
        steps = F.array(*[F.lit((2 * k + 1 - parts) * half) for k in range(parts)])
        for j in range(dimension):
            moved = F.array(*[F.get("coords", k) + F.col("_step") if k == j else F.get("coords", k) for k in range(dimension)])
            boxes = boxes.withColumn("_step", F.explode(steps)).select(moved.alias("coords"))
        boxes = stored(boxes.select(F.monotonically_increasing_id().alias("point_id"), "coords"))
        measured = stored(boxes.join(nearest(boxes, points), "point_id"))
        row = measured.agg(F.max(F.struct("dist", "coords")).alias("best")).first()["best"]
        best = max(best, (row["dist"], list(row["coords"])))
        reach = half * math.sqrt(dimension)
        boxes = measured.where(F.col("dist") + reach > best[0] + tolerance).select("coords", "dist")
        if dimension <= 3 and tolerance < reach <= 2 * best[0]:
            best, boxes = _ended_in_tasks(boxes, points, dimension, half, best, tolerance)
            boxes = boxes.where(F.col("dist") + reach > best[0] + tolerance)
        if reach <= tolerance or boxes.isEmpty():
            return spark.createDataFrame([best], "value double, place array<double>")


def covering_radius(points: DataFrame, dimension: int, margin: float = 1e-8, tolerance: float = 1e-7) -> DataFrame:
    """Covering radius in the unit cube: exact in one or two dimensions and for few points, otherwise by boxes, to a tolerance.

    In two dimensions it is the farthest corner of the cells of ``tessellation``.

    For few points the farthest place is a corner of the cells of points and their mirror images: each set of
    dimension + 1 of them gives a centre of equal distance, which counts where it lies in the cube.
    """
    if dimension == 1:
        return covering_radius_1d(points)
    most = EXACT_POINTS["covering_radius"]
    if points.limit(most + 1).count() > most:
        if dimension == 2:
            return vertices_of(voronoi_cells(points)).agg(F.max("dist").alias("value"))
        return covering_radius_by_boxes(points, dimension, tolerance).select("value")

    def measure(x: np.ndarray) -> float:
        images = [x] + [np.where(np.arange(dimension) == j, side - x, x) for j in range(dimension) for side in (0.0, 2.0)]
        every = np.unique(np.concatenate(images), axis=0)
        best = 0.0
        sets = combinations(range(len(every)), dimension + 1)
        while chunk := [s for _, s in zip(range(50_000), sets)]:
            p = every[np.array(chunk)]
            a = 2 * (p[:, 1:] - p[:, :1])
            b = (p[:, 1:] ** 2).sum(2) - (p[:, :1] ** 2).sum(2)
            solid = np.abs(np.linalg.det(a)) > 1e-12
            centre = np.linalg.solve(a[solid], b[solid][..., None])[..., 0]
            centre = centre[((centre > -margin) & (centre < 1 + margin)).all(1)]
            centre = np.clip(centre, 0, 1)
            if len(centre):
                best = max(best, EUCLIDEAN.matrix(centre, x).min(1).max())
        return best

    return _whole(points, "covering_radius", lambda sets: np.array([measure(x) for x in sets]))


def solow_polasky_diversity(points: DataFrame, activity: float = 1.0, metric: Metric = EUCLIDEAN, by: str | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Sum of the pseudo-inverse of exp(-activity * distance).

    Sets of few points are inverted whole, one to a task; where a set is larger, the sum of the solution of
    A x = 1 is found by conjugate gradients, whose products run over cells of pairs, until the residual is
    below ``tolerance`` of the right side. Points at one place are one, as in the pseudo-inverse.
    """
    most = EXACT_POINTS["solow_polasky"]
    sizes = points.groupBy(by).count().where(F.col("count") > most) if by else points.limit(most + 1).groupBy().count().where(F.col("count") > most)
    if sizes.isEmpty():
        return _whole(points, "solow_polasky", lambda x: np.linalg.pinv(np.exp(-activity * metric.matrix(x, x)), hermitian=True).sum((1, 2)), by)
    return _solow_polasky_by_products(points, activity, metric, by, tolerance)


#: Places of the sample of a set, about, that preconditions its products, and rows of a strip of their matrix.
NET, STRIP = 1024, 128


def _solow_polasky_by_products(points: DataFrame, activity: float, metric: Metric, by: str | None, tolerance: float, most_steps: int = 1000) -> DataFrame:
    """Preconditioned conjugate gradients of all groups at once.

    Places are packed into lanes and the pairs of lanes into cells once; a step sends the cells one vector, a row for each
    lane, and gives one row of sums for each group, from which step, next residual and turn follow. The residual
    that ends the search is summed anew, and a group that is settled is left out of the products.

    A = exp(-activity * distance) is preconditioned by ``mu + C W^-1 C'``, where W is A among a sample of about ``NET`` places and C is A
    between all and those, so that its large eigenvalues take no steps. Its inverse is ``(1 - C M C') / mu`` with the small
    ``M = (mu W + C' C)^-1``; C is made again in the tasks of the lanes, a vector of the sample's length is what they share.
    """
    own = points.groupBy((F.col(by) if by else F.lit(0)).alias("group"), "coords").agg(F.min("point_id").alias("point_id"))
    own = stored(own.select("group", "point_id", "coords"))
    key = T.StructField("set", own.schema["group"].dataType)
    placed = own.join(F.broadcast(lane_counts(own, "lanes")) if not by else lane_counts(own, "lanes"), "group")
    dealt = placed.select(F.col("group").alias("set"), F.pmod(F.xxhash64("point_id"), "lanes").cast("int").alias("lane"), "lanes", "point_id", "coords")
    numbers = T.ArrayType(T.DoubleType())
    field = lambda name, kind: T.StructField(name, kind)
    typed = lambda rows, fields: pa.table(rows, schema=to_arrow_schema(fields))

    lane_fields = T.StructType([key, field("lane", T.IntegerType()), field("lanes", T.IntegerType()), field("n", T.IntegerType()), field("coords", numbers)])

    def packed(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("point_id")
        return typed([rows["set"][:1], rows["lane"][:1], rows["lanes"][:1], [len(rows)], [rows["coords"].combine_chunks().flatten()]], lane_fields)

    lanes = stored(dealt.groupBy("set", "lane").applyInArrow(packed, lane_fields), estimated=False)
    partner = lanes.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)))
    sides = partner.select("set", F.least("lane", "partner").alias("one"), F.greatest("lane", "partner").alias("two"), (F.col("lane") > F.col("partner")).alias("second"), "coords")
    first, second = (F.max(F.when(F.col("second") == side, F.col("coords"))) for side in (False, True))
    # cells lie still while a vector is small enough to be broadcast; tasks keep all cores busy and hold few cells, as each has its cost in every step
    cores = points.sparkSession.sparkContext.defaultParallelism
    most = lanes.agg(F.count("*").alias("lanes"), F.coalesce(F.sum((F.col("lanes") + 1) / 2), F.lit(0)).alias("cells")).first()
    width, lane_width = max(4 * cores, math.ceil(most["cells"] / 8)), max(cores, math.ceil(most["lanes"] / 8))
    cells = stored(sides.groupBy("set", "one", "two").agg(first.alias("left"), second.alias("right")).repartition(width))
    small = 8 * own.count() <= PIVOT_BYTES
    sent = F.broadcast if small else lambda rows: rows
    whole = lambda batch, c, k: batch[c][k].values.to_numpy(zero_copy_only=False)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a = metric.quick(x, y)
        a *= -activity
        return np.exp(a, out=a)

    def blocks(x: np.ndarray) -> Iterator[slice]:
        return (slice(lo, lo + BLOCK) for lo in range(0, len(x), BLOCK))

    # the sample by a hash; small groups are all in it
    sizes = own.groupBy("group").agg(F.count("*").alias("size"))
    share = F.greatest(F.least(F.lit(NET), F.floor(F.col("size") / 8)), F.lit(64))
    picked = own.join(F.broadcast(sizes) if not by else sizes, "group").where(F.pmod(F.xxhash64("point_id", F.lit(1)), F.col("size")) < share)
    picked = picked.select(F.col("group").alias("set"), F.lit(0).alias("lane"), F.lit(0).alias("lanes"), "point_id", "coords")
    net = stored(picked.groupBy("set").applyInArrow(packed, lane_fields).select("set", F.col("n").alias("m"), F.col("coords").alias("net")), estimated=False)
    known = stored(lanes.select("set", "lane", "n", "coords").join(net, "set").repartition(lane_width), estimated=False)

    strip_fields = T.StructType([key, field("strip", T.IntegerType()), field("n", T.LongType()), field("part", numbers)])

    def squared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                n, m = batch["n"][k].as_py(), batch["m"][k].as_py()
                x, at, total = whole(batch, "coords", k).reshape(n, -1), whole(batch, "net", k).reshape(m, -1), np.zeros((m, m))
                for part in blocks(x):
                    c = near(x[part], at)
                    total += c.T @ c
                for strip in range(math.ceil(m / STRIP)):
                    yield from typed([batch["set"].take(pa.array([k])), [strip], [n], [total[strip * STRIP : (strip + 1) * STRIP].ravel()]], strip_fields).to_batches()

    def summed(name: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        parts = rows["part"].combine_chunks()
        return typed([rows["set"][:1], rows["strip"][:1], [sum(rows["n"].to_pylist())], [parts.flatten().to_numpy().reshape(len(rows), -1).sum(0)]], strip_fields)

    inverse_fields = T.StructType([key, field("mu", T.DoubleType()), field("inverse", numbers)])

    def inverted(name: tuple[pa.Scalar, ...], strips: pa.Table, rows: pa.Table) -> pa.Table:
        m, n = rows["m"][0].as_py(), strips["n"][0].as_py()
        total = strips.sort_by("strip")["part"].combine_chunks().flatten().to_numpy().reshape(m, m)
        at = rows["net"].combine_chunks().flatten().to_numpy().reshape(m, -1)
        values, vectors = np.linalg.eigh(near(at, at))
        values = np.maximum(values, 1e-6)
        mu = min(1.0, max(0.01, 1 - float(np.einsum("ij,ij,j->", vectors, total @ vectors, 1 / values)) / n))
        inverse = np.linalg.inv(mu * (vectors * values) @ vectors.T + total)
        return typed([rows["set"], [mu], [((inverse + inverse.T) / 2).ravel()]], inverse_fields)

    strips = known.mapInArrow(squared, strip_fields).groupBy("set", "strip").applyInArrow(summed, strip_fields)
    inverse = stored(strips.groupBy("set").cogroup(net.groupBy("set")).applyInArrow(inverted, inverse_fields), estimated=False)

    y_fields = T.StructType([key, field("strip", T.IntegerType()), field("n", T.LongType()), field("part", numbers)])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """C' r of a lane for its next residual r, and r' r."""
        for batch in batches:
            for k in range(len(batch)):
                r, m = whole(batch, "r", k) - batch["step"][k].as_py() * whole(batch, "q", k), batch["m"][k].as_py()
                x, at = whole(batch, "coords", k).reshape(len(r), -1), whole(batch, "net", k).reshape(m, -1)
                y = sum((r[part] @ near(x[part], at) for part in blocks(x)), np.zeros(m))
                yield from typed([batch["set"].take(pa.array([k])), [0], [len(r)], [np.append(y, r @ r)]], y_fields).to_batches()

    u_fields = T.StructType([key, field("mu", T.DoubleType()), field("u", numbers), field("left", T.DoubleType())])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """u = M y of a set, and what is left of its residual by the inverse."""
        for batch in batches:
            for k in range(len(batch)):
                y, rr, mu = whole(batch, "part", k)[:-1], whole(batch, "part", k)[-1], batch["mu"][k].as_py()
                u = whole(batch, "inverse", k).reshape(len(y), -1) @ y
                yield from typed([batch["set"].take(pa.array([k])), [mu], [u], [max(0.0, float(rr - y @ u) / mu)]], u_fields).to_batches()

    state_fields = T.StructType([key, field("lane", T.IntegerType()), *[field(c, numbers) for c in ("x", "r", "z", "p")], field("rr", T.DoubleType())])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The next vectors of a lane."""
        for batch in batches:
            for k in range(len(batch)):
                x, r, p, q, u = (whole(batch, c, k) for c in ("x", "r", "p", "q", "u"))
                mu, step, rz, left = (batch[c][k].as_py() for c in ("mu", "step", "rz", "left"))
                places, at = whole(batch, "coords", k).reshape(len(q), -1), whole(batch, "net", k).reshape(len(u), -1)
                x, r = x + step * p, r - step * q
                # anew from the residual: a sum of steps would keep the rounding of the first one
                z = (r - np.concatenate([near(places[part], at) @ u for part in blocks(places)])) / mu
                turn = left / rz if rz > 0 and step else 0.0
                yield from typed([*[batch[c].take(pa.array([k])) for c in ("set", "lane")], [x], [r], [z], [z + turn * p], [r @ r]], state_fields).to_batches()

    def advanced(met: DataFrame) -> DataFrame:
        """The state after a step, from its products."""
        y = known.join(sent(met.select("set", "lane", "q", "r", "step")), ["set", "lane"]).mapInArrow(projected, y_fields).groupBy("set").applyInArrow(summed, y_fields)
        turns = inverse.join(sent(y.select("set", "part")), "set").mapInArrow(turned, u_fields)
        return stored(known.join(sent(met.join(sent(turns), "set")), ["set", "lane"]).mapInArrow(moved, state_fields), estimated=False)

    q_fields = T.StructType([key, field("lane", T.IntegerType()), field("q", numbers)])

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                same = not batch["right"][k].is_valid
                p1, p2 = whole(batch, "p1", k), whole(batch, "p2", k)
                x = whole(batch, "left", k).reshape(len(p1), -1)
                y = x if same else whole(batch, "right", k).reshape(len(p2), -1)
                q1, q2 = np.zeros(len(p1)), np.zeros(len(p2))
                for i in range(0, len(x), BLOCK):
                    for j in range(i if same else 0, len(y), BLOCK):
                        one, two = slice(i, i + BLOCK), slice(j, j + BLOCK)
                        a = near(x[one], y[two])
                        q1[one] += a @ p2[two]
                        if not (same and i == j):
                            q2[two] += p1[one] @ a
                made = [("one", q1 + q2)] if same else [("one", q1), ("two", q2)]
                yield from typed([batch["set"].take(pa.array([k] * len(made))), [batch[lane][k].as_py() for lane, _ in made], [q for _, q in made]], q_fields).to_batches()

    sums = ("rz", "pq")
    met_fields = T.StructType([*q_fields, *[field(c, numbers) for c in ("x", "r", "p")], *[field(c, T.DoubleType()) for c in sums]])

    def met_with(name: tuple[pa.Scalar, ...], parts: pa.Table, rows: pa.Table) -> pa.Table:
        x, r, z, p = (rows[c].combine_chunks().flatten().to_numpy() for c in ("x", "r", "z", "p"))
        q = parts["q"].combine_chunks().flatten().to_numpy().reshape(-1, len(p)).sum(0)
        return typed([rows["set"], rows["lane"], [q], [x], [r], [p], [r @ z], [p @ q]], met_fields)

    # a step of -1 from nothing, with q = 1, gives the right side, its preconditioned one and the first direction
    constant = lambda v, name: F.array_repeat(F.lit(v), F.col("n")).alias(name)
    nothing = lanes.select("set", "lane", constant(1.0, "q"), *[constant(0.0, c) for c in ("x", "r", "p")], F.lit(-1.0).alias("step"), F.lit(0.0).alias("rz"))
    state = advanced(nothing)
    for _ in range(most_steps):
        total = state.groupBy("set").agg(F.sum("rr").alias("rr"), F.sum(F.size("r")).alias("n"))
        unsettled = total.where(F.col("rr") > tolerance**2 * F.col("n")).select("set")
        if unsettled.isEmpty():
            value = state.groupBy("set").agg(F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v)).alias("value"))
            return value.withColumnRenamed("set", by) if by else value.select("value")
        moving = state.join(sent(unsettled), "set", "left_semi") if by else state
        one, two = (moving.select("set", F.col("lane").alias(lane), F.col("p").alias(p)) for lane, p in (("one", "p1"), ("two", "p2")))
        parts = cells.join(sent(one), ["set", "one"]).join(sent(two), ["set", "two"])
        parts = (parts if small else parts.repartition(width)).mapInArrow(product, q_fields)
        met = stored(parts.groupBy("set", "lane").cogroup(state.groupBy("set", "lane")).applyInArrow(met_with, met_fields), estimated=False)
        scalars = met.groupBy("set").agg(*[F.sum(c).alias(c) for c in sums])
        steps = scalars.select("set", "rz", F.when(F.col("pq") > 0, F.col("rz") / F.col("pq")).otherwise(F.lit(0.0)).alias("step"))
        state = advanced(met.drop(*sums).join(sent(steps), "set"))
    raise ValueError("the conjugate gradients have not settled")


def weitzman_diversity(points: DataFrame, metric: Metric = EUCLIDEAN, by: str | None = None) -> DataFrame:
    """Best order of taking away one end of the closest pair, plus its distance; 1 for a single point."""

    def measure(d: np.ndarray) -> float:
        known: dict[frozenset[int], float] = {}

        def of(left: frozenset[int]) -> float:
            if len(left) == 1:
                return 1.0
            if left not in known:
                gap, i, j = min((d[i, j], i, j) for i, j in combinations(sorted(left), 2))
                known[left] = gap + max(of(left - {i}), of(left - {j}))
            return known[left]

        return of(frozenset(range(len(d))))

    return _whole(points, "weitzman", lambda sets: np.array([measure(d) for d in metric.matrix(sets, sets)]), by)


#: Dimensions up to which pairs are summed by dominance; in more of them the levels outgrow the pairs.
DOMINANCE_DIMENSIONS = 3


def unanchored_l2_discrepancy(points: DataFrame, dimension: int, by: str | None = None) -> DataFrame:
    """Unanchored L2 discrepancy in the unit cube; 0 for no points."""

    def kernel(_, x, __, y, same):
        product = np.ones((len(x), len(y)))
        for j in range(dimension):
            product *= (1 - np.maximum(x[:, j, None], y[None, :, j])) * np.minimum(x[:, j, None], y[None, :, j])
        return {"pairs": np.triu(product, 1).sum() if same else product.sum()}

    if dimension <= DOMINANCE_DIMENSIONS:
        pairs = dominance_sums(points, dimension, by)
    else:
        made = pair_partials(points, None, kernel, "pairs double", by=by)
        pairs = made.groupBy(F.col(by) if by else F.lit(0).alias("by")).agg(F.sum("pairs").alias("pairs")).withColumnRenamed(by or "by", "by")
    single = F.aggregate("coords", F.lit(1.0), lambda p, v: p * v * (1 - v))
    sums = F.sum(single).alias("singles"), F.count("*").cast("double").alias("n")
    singles = points.groupBy(F.col(by).alias("by")).agg(*sums) if by else points.agg(*sums).withColumn("by", F.lit(0))
    total = 2 * F.coalesce("pairs", F.lit(0.0)) + F.col("singles")
    inner = total / (F.col("n") * F.col("n")) - F.col("singles") * 2.0 ** (1 - dimension) / F.col("n") + 12.0**-dimension
    value = F.when(F.col("n") > 0, F.sqrt(inner)).otherwise(F.lit(0.0)).alias("value")
    return singles.join(pairs, "by", "left").select(*([F.col("by").alias(by)] if by else []), value)


def expected_unanchored_l2_discrepancy(spark: SparkSession, n: int, dimension: int) -> DataFrame:
    return spark.range(1).select(F.lit(math.sqrt(6.0**-dimension * (1 - 2.0**-dimension) / n)).alias("value"))


def mean_dist_to_boundary(points: DataFrame, dimension: int) -> DataFrame:
    lo, hi = unitcube(dimension)
    return points.agg(F.coalesce(F.avg(boundary_distance(F.col("coords"), vector(lo), vector(hi))), F.lit(0.0)).alias("value"))


def expected_dist_to_boundary(spark: SparkSession, dimension: int) -> DataFrame:
    return spark.range(1).select(F.lit(0.5 / (1 + dimension)).alias("value"))


def _series(l: int, p: float, d: int) -> float:
    """Coefficient of the distribution of the distance of two uniform points."""
    return (-1) ** (l - d) * binomial(d, l - d) * (2 / p) ** d * math.gamma(1 / p) ** (2 * d - l) * math.gamma(2 / p) ** (l - d) / math.gamma(l / p + 1)


def _distance_cdf(t: float, p: float, d: int) -> float:
    if math.isinf(p):
        return (2 * t - t * t) ** d if t <= 1 else 1.0
    return math.fsum(_series(l, p, d) * t**l for l in range(d, 2 * d + 1))


WMH_APPROXIMATIONS = ("polynomials", "gauss", "gumbel", "weibull")


def wmh_values(sep_dist: float, p: float, n: int, d: int, approximations: tuple[str, ...] = WMH_APPROXIMATIONS) -> list[float]:
    """log10 of the probability that random points keep a larger distance, by each approximation.

    "gauss", "gumbel" and "weibull" need a finite exponent; "gumbel" needs three points.
    """
    if sep_dist < 0 or p <= 0 or n < 0 or d < 1:
        raise ValueError("distance, exponent, number of points or dimension out of range")
    pairs = float(binomial(n, 2))
    moment = lambda q: 2 / ((q + 1) * (q + 2))
    out = []
    for name in approximations:
        if name not in WMH_APPROXIMATIONS:
            raise ValueError(f"unknown approximation {name}")
        if name != "polynomials" and math.isinf(p):
            raise ValueError(f"{name} needs a finite exponent")
        # logarithms are multiplied: the probabilities themselves fall below any number that is held
        if name == "polynomials":
            cdf = _distance_cdf(sep_dist, p, d) if sep_dist <= 1 else 1.0
            value = pairs * (math.log1p(-cdf) / math.log(10)) if cdf < 1 else -math.inf
        elif name == "weibull":
            value = -_series(d, p, d) * pairs * sep_dist**d / math.log(10)
        else:
            score = (sep_dist**p - d * moment(p)) / math.sqrt(d * (moment(2 * p) - moment(p) ** 2))
            if name == "gauss":
                z = score / math.sqrt(2)
                tail = math.erfc(z) / 2 if score > 0 else 1 - (1 + math.erf(z)) / 2
                value = pairs * math.log10(tail) if tail > 0 else -math.inf
            else:
                if n < 3:
                    raise ValueError("gumbel needs three points")
                alpha = math.sqrt(2 * math.log(pairs))
                beta = (math.log(math.log(pairs)) + math.log(4 * math.pi)) / (2 * alpha) - alpha
                reach = alpha * (score - beta)
                value = -math.exp(reach) / math.log(10) if reach < 709 else -math.inf
        out.append(value)
    return out


def wmh_index(spark: SparkSession, sep_dist: float, p: float, n: int, d: int, approximations: tuple[str, ...] = WMH_APPROXIMATIONS) -> DataFrame:
    """(approximation, value) for each approximation, and the largest under the name "max"; 0 for fewer than two points."""
    if n < 2:
        return spark.createDataFrame([("max", 0.0)], "approximation string, value double")
    values = wmh_values(sep_dist, p, n, d, approximations)
    return spark.createDataFrame([*zip(approximations, values), ("max", max(values))], "approximation string, value double")
