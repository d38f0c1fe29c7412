"""Selecting points: recursive bisection into clusters, their representatives, and greedy picks.

Points stay distributed.  A pass over them is one job that brings a bounded summary
to the driver: boxes of the nodes of a tree, or the best points of each of some
cells and bounds of the others; many splits or picks are made from one summary.
Ties go to the smaller point_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pointloom.functions.metrics import EUCLIDEAN, Metric, boundary_distance
from pointloom.functions.rng import uniform
from pointloom.operators.boxtree import BoxTree, gathered, leaf_boxes, vectors
from pointloom.operators.pairs import pair_partials
from pointloom.plans.ranks import stored
from pointloom.schema import vector

#: Cells that points fall into, candidates of a cell, points that the cells are laid by, and picks between checkpoints.
CELLS, CANDIDATES, LAID_BY, PICKS = 1024, 4, 8192, 64

Observer = Callable[[int, int, float], None]


@dataclass
class Criterion:
    """What a greedy search picks by: ``start`` of distances to a block of existing points, put together by ``total``.

    A pick moves a criterion to ``step(criterion, gap(distance))``; as ``gap`` only falls or only grows with the
    distance, in the sense of ``largest``, the farthest place of a cell bounds what its points can come to.
    """

    start: Callable[[np.ndarray], np.ndarray]
    total: Callable
    step: Callable[[np.ndarray, np.ndarray], np.ndarray]
    gap: Callable[[np.ndarray], np.ndarray]
    largest: bool
    mask: bool

    @property
    def out(self) -> float:
        return -np.inf if self.largest else np.inf

    def rank(self, crit: np.ndarray) -> np.ndarray:
        """Criteria so that less is better."""
        return -crit if self.largest else crit

    def moved(self, crit: np.ndarray, ids: np.ndarray, d: np.ndarray, pick: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            new = self.step(crit, self.gap(d))
        return np.where((ids == pick) | (crit == self.out), self.out, new) if self.mask else new


@dataclass
class Seen:
    """Of each cell its best candidates, and of the others in it the best criterion and the bounds."""

    cell: np.ndarray
    ids: np.ndarray
    crit: np.ndarray
    x: np.ndarray
    rest: np.ndarray  # by cell, ranked
    lo: np.ndarray
    hi: np.ndarray

    def merged(self, other: Seen, rank: Callable[[np.ndarray], np.ndarray]) -> Seen:
        cell, ids, crit, x = (np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("cell", "ids", "crit", "x"))
        order = np.lexsort((ids, rank(crit), cell))
        cell, ids, crit, x = cell[order], ids[order], crit[order], x[order]
        place = np.arange(len(cell)) - np.searchsorted(cell, cell)
        rest = np.minimum(self.rest, other.rest)
        np.minimum.at(rest, cell[place >= CANDIDATES], rank(crit[place >= CANDIDATES]))
        kept = place < CANDIDATES
        return Seen(cell[kept], ids[kept], crit[kept], x[kept], rest, np.minimum(self.lo, other.lo), np.maximum(self.hi, other.hi))


def _cells(points: DataFrame) -> BoxTree:
    """A tree of cells that hold about as many points each, laid by a bounded sample; any tree gives the same picks."""
    rows = points.select("coords").orderBy(F.xxhash64("point_id", F.lit(7)), "point_id").limit(LAID_BY).collect()
    x = np.array([list(r["coords"]) for r in rows], float).reshape(len(rows), -1)
    tree, heap = BoxTree(), [(-len(x), 0, np.arange(len(x)))]
    while heap and len(tree) < 2 * CELLS - 1:
        _, node, own = heapq.heappop(heap)
        if len(own) < 2 or not (extents := np.ptp(x[own], axis=0)).any():
            continue
        side = int(extents.argmax())
        v = np.sort(x[own, side])
        middle = v[len(v) // 2] if v[len(v) // 2] > v[0] else v[np.searchsorted(v, v[0], side="right")]
        left, right = tree.split(node, side, float(middle))
        for part, inside in ((left, x[own, side] < middle), (right, x[own, side] >= middle)):
            heapq.heappush(heap, (-int(inside.sum()), part, own[inside]))
    return tree


def _farthest(metric: Metric, lo: np.ndarray, hi: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """What no point of a box is farther from a place than."""
    with np.errstate(invalid="ignore"):
        gaps = np.maximum(np.abs(pick - lo), np.abs(hi - pick))
    if metric.sizes is not None:
        gaps = np.minimum(gaps, np.array(metric.sizes) / 2)
    return Metric(metric.exponent).matrix(gaps, np.zeros((1, gaps.shape[1])))[:, 0] * (1 + 1e-12)


def _greedy(points: DataFrame, k: int, existing: DataFrame | None, seed: int, metric: Metric, by: Criterion, observer: Observer | None) -> DataFrame:
    """(pos, point_id, coords): picks by the largest or smallest running criterion over all points.

    A pass over the points, one job, brings the driver the best candidates of each cell and bounds of the others.
    It picks from them, with exact criteria, for as long as no other point can be better; then comes another pass.
    """
    if k < 1:
        raise ValueError("at least one point is to be selected")
    if points.limit(k).count() < k:
        raise ValueError("fewer points than are to be selected")
    spark = points.sparkSession
    base = points.select("point_id", "coords")
    if existing is None or not existing.limit(1).count():
        # a random point, which is not itself selected, stands in
        existing = base.orderBy(uniform(seed, F.col("point_id")), "point_id").limit(1)

    def begin(ids: np.ndarray, x: np.ndarray, _: np.ndarray, y: np.ndarray, __: bool) -> dict:
        return {"point_id": ids, "crit": by.start(metric.matrix(x, y))}

    started = pair_partials(base, existing.select("point_id", "coords"), begin, "point_id long, crit double").groupBy("point_id").agg(by.total("crit").alias("crit"))
    state = stored(base.join(started, "point_id"))
    tree = _cells(base)
    dimension = len(state.first()["coords"])
    pending: list[tuple[int, np.ndarray]] = []

    def current(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, ids, crit = vectors(batch), batch["point_id"].to_numpy(), batch["crit"].to_numpy()
        for pick, place in pending:
            crit = by.moved(crit, ids, metric.matrix(x, place[None])[:, 0], pick)
        return ids, x, crit

    def none(cell: np.ndarray, ids: np.ndarray, crit: np.ndarray, x: np.ndarray) -> Seen:
        seen = Seen(cell, ids, crit, x, np.full(len(tree), np.inf), np.full((len(tree), dimension), np.inf), np.full((len(tree), dimension), -np.inf))
        np.minimum.at(seen.lo, cell, x)
        np.maximum.at(seen.hi, cell, x)
        return seen

    def of(batch: pa.RecordBatch) -> Seen:
        ids, x, crit = current(batch)
        empty = none(np.zeros(0, np.int64), ids[:0], crit[:0], x[:0])
        return none(tree.leaves_of(x), ids, crit, x).merged(empty, by.rank)

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["point_id"], batch["coords"], pa.array(current(batch)[2])], ["point_id", "coords", "crit"])

    picks: list[tuple[int, int, list[float]]] = []
    while True:
        if len(pending) >= PICKS:
            state, pending = stored(state.mapInArrow(moved, "point_id long, coords array<double>, crit double")), []
        seen = gathered(state, of, lambda a, b: a.merged(b, by.rank))
        crit, first = seen.crit, True
        rest = by.rank(seen.rest)  # criteria of the others at best; none where a cell has no others
        others = np.isfinite(seen.lo[:, 0]) & (seen.rest < np.inf)
        while True:
            rank = by.rank(crit)
            at = np.flatnonzero(rank == rank.min())
            i = int(at[seen.ids[at].argmin()])
            if not first and not rank[i] < by.rank(rest[others]).min(initial=np.inf):
                break
            pick, place = int(seen.ids[i]), seen.x[i]
            picks.append((len(picks), pick, place.tolist()))
            if observer is not None:
                observer(len(picks) - 1, pick, float(crit[i]))
            if len(picks) == k:
                return spark.createDataFrame(picks, "pos long, point_id long, coords array<double>")
            pending.append((pick, place))
            crit = by.moved(crit, seen.ids, metric.matrix(seen.x, place[None])[:, 0], pick)
            with np.errstate(divide="ignore", invalid="ignore"):
                rest[others] = by.step(rest[others], by.gap(_farthest(metric, seen.lo[others], seen.hi[others], place)))
            first = False


def select_greedy_maximin(points: DataFrame, k: int, existing: DataFrame | None = None, metric: Metric = EUCLIDEAN, seed: int = 0, observer: Observer | None = None) -> DataFrame:
    """Farthest first: each pick has the largest distance to the existing points and earlier picks.

    Picks are not taken out: where all points coincide with picks, the first point comes again.
    """
    return _greedy(points, k, existing, seed, metric, Criterion(lambda d: d.min(1), F.min, np.minimum, lambda d: d, True, False), observer)


def select_greedy_maxisum(points: DataFrame, k: int, existing: DataFrame | None = None, metric: Metric = EUCLIDEAN, seed: int = 0, observer: Observer | None = None) -> DataFrame:
    """Each pick has the largest sum of distances to the existing points and earlier picks."""
    return _greedy(points, k, existing, seed, metric, Criterion(lambda d: d.sum(1), F.sum, np.add, lambda d: d, True, True), observer)


def select_greedy_energy(points: DataFrame, k: int, dimension: int, existing: DataFrame | None = None, exponent: float | None = None, metric: Metric = EUCLIDEAN, seed: int = 0, observer: Observer | None = None) -> DataFrame:
    """Each pick has the least energy, the sum of 1 / d**e (e = 0: of log(1 / d)), with the existing points and earlier picks."""
    e = dimension + 1.0 if exponent is None else float(exponent)

    def energy(d: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return -np.log(d) if e == 0 else 1 / d**e

    return _greedy(points, k, existing, seed, metric, Criterion(lambda d: energy(d).sum(1), F.sum, np.add, energy, False, True), observer)


def bounding_boxes(clusters: DataFrame, dimension: int) -> DataFrame:
    """(cluster_id, n, lo, hi, split_dim, extent) of clusters (cluster_id, point_id, coords); the first widest side splits."""
    sides = [f(F.get("coords", j)).alias(f"{f.__name__}{j}") for j in range(dimension) for f in (F.min, F.max)]
    lo, hi = (F.array(*[F.col(f"{f}{j}") for j in range(dimension)]) for f in ("min", "max"))
    widest = F.array_max(F.transform(F.zip_with(hi, lo, lambda h, l: h - l), lambda e, j: F.struct(e.alias("e"), (-j).alias("j"))))
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("n"), *sides).select("cluster_id", "n", lo.alias("lo"), hi.alias("hi"), (-widest["j"]).alias("split_dim"), widest["e"].alias("extent"))


def psa_partition(points: DataFrame, k: int, dimension: int) -> DataFrame:
    """(cluster_id, point_id, coords): k clusters by halving the widest side of the widest cluster.

    Of clusters with the same extent the one of the smaller id is split.  A part is never wider than the
    whole, so the k - 1 clusters that are split are the widest nodes of the tree of all halvings: a round splits
    every leaf that is as wide as the (k - 1)th widest node known, in one job, and the order of splits, which
    gives the ids, is replayed over the boxes.  Rounds follow the depth of the tree; the driver holds a box for a node.
    """
    if k < 1:
        raise ValueError("at least one cluster is asked for")
    base = stored(points.select("point_id", "coords"))
    tree, boxes, fresh = BoxTree(), {}, {0}
    while True:
        found = leaf_boxes(base, tree, fresh)
        if found is None:
            raise ValueError("there are no points")
        extents = found.hi - found.lo
        for i, node in enumerate(found.node.tolist()):
            side = int(extents[i].argmax())
            boxes[node] = (float(extents[i, side]), side, float((found.lo[i, side] + found.hi[i, side]) / 2))
        # replay: clusters by width, then id; the left part keeps the id
        heap, clusters, short = [(-boxes[0][0], 0, 0)], 1, False
        while clusters < k and not short:
            width, name, node = heap[0]
            if width == 0:
                raise ValueError("fewer distinct points than clusters")
            if short := tree.left[node] < 0:
                break
            heapq.heappop(heap)
            heapq.heappush(heap, (-boxes[tree.left[node]][0], name, tree.left[node]))
            heapq.heappush(heap, (-boxes[tree.right[node]][0], clusters, tree.right[node]))
            clusters += 1
        if not short:
            break
        widths = sorted((b[0] for b in boxes.values()), reverse=True)
        least = widths[k - 2] if len(widths) >= k - 1 else 0.0
        fresh = {part for node, (width, side, middle) in list(boxes.items()) if tree.left[node] < 0 and width > 0 and width >= least for part in tree.split(node, side, middle)}
    names = np.full(len(tree), -1)
    for _, name, node in heap:
        names[node] = name

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = tree.leaves_of(vectors(batch), names >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(names[node], pa.int64()), batch["point_id"], batch["coords"]], ["cluster_id", "point_id", "coords"])

    return base.mapInArrow(named, "cluster_id long, point_id long, coords array<double>")


TARGETS = ("random_uniform", "center_of_mass", "centroid_of_hypercube", "max_dist_from_boundary")


def representatives(clusters: DataFrame, dimension: int, target: str = "centroid_of_hypercube", tournament_size: int = 0, metric: Metric = EUCLIDEAN, seed: int = 0) -> DataFrame:
    """(cluster_id, point_id, coords) of one point of each cluster: the one nearest to the target, or farthest from the box's faces.

    A tournament leaves ``tournament_size`` random members of a cluster to choose from.
    """
    if target not in TARGETS:
        raise ValueError(f"unknown target {target}")
    boxes = bounding_boxes(clusters, dimension)
    if target == "center_of_mass":
        means = clusters.groupBy("cluster_id").agg(F.array(*[F.avg(F.get("coords", j)) for j in range(dimension)]).alias("target"))
        boxes = boxes.join(means, "cluster_id")
    elif target == "random_uniform":
        boxes = boxes.withColumn("target", F.transform(F.arrays_zip("lo", "hi"), lambda s, j: s["lo"] + (s["hi"] - s["lo"]) * uniform(seed, F.col("cluster_id"), j)))
    else:
        boxes = boxes.withColumn("target", F.zip_with("lo", "hi", lambda l, h: (l + h) * 0.5))
    members = clusters
    if tournament_size > 0:
        by_chance = Window.partitionBy("cluster_id").orderBy(uniform(seed, F.col("point_id"), F.lit("tournament")), "point_id")
        members = members.withColumn("_turn", F.row_number().over(by_chance)).where(F.col("_turn") <= tournament_size).drop("_turn")
    joined = members.join(boxes.select("cluster_id", "lo", "hi", "extent", "target"), "cluster_id")
    score = -boundary_distance(F.col("coords"), F.col("lo"), F.col("hi")) if target == "max_dist_from_boundary" else metric.column(F.col("coords"), F.col("target"))
    if target == "center_of_mass":
        # a mean's last digits depend on the order of its sum, which must not part points that are equally far
        score = F.when(F.col("extent") > 0, F.round(score / F.col("extent"), 12)).otherwise(score)
    best = joined.groupBy("cluster_id").agg(F.min(F.struct(score.alias("score"), "point_id", "coords")).alias("best"))
    return best.select("cluster_id", "best.point_id", "best.coords")


def psa_select(points: DataFrame, k: int, dimension: int, target: str = "centroid_of_hypercube", tournament_size: int = 0, metric: Metric = EUCLIDEAN, seed: int = 0) -> DataFrame:
    """k points, one for each cluster of ``psa_partition``."""
    return representatives(psa_partition(points, k, dimension), dimension, target, tournament_size, metric, seed)


def closest_point(points: DataFrame, sought: list[float], metric: Metric = EUCLIDEAN) -> DataFrame:
    """One row: the point nearest to a place."""
    d = metric.column(F.col("coords"), vector(sought))
    return points.agg(F.min(F.struct(d.alias("dist"), "point_id", "coords")).alias("best")).select("best.point_id", "best.coords", "best.dist")

