"""Nearest neighbours by pivots: triangle bounds leave out most pairs, and what is left is compared in bounded cells.

Some targets are pivots, about as many as the root of their number; each point
belongs to the pivot next to it.  Cells (the targets of a pivot) lie together
in lanes of neighbouring pivots, as many as the cluster can work on.  In the
first round a point meets the lane of its own pivot and gets a bound on its
distance; in the second it goes only to lanes with a cell that may hold
something nearer, by the triangle inequality: no target of a cell lies nearer
than the pivot's distance less the cell's radius, nor, being nearer to its own
pivot, than half the difference of the two pivots' distances.

Points at the same place are one place with a count, so that many of them load
no task.  A cell of more targets than a lane holds is several lanes, a lane that
many points meet is several groups, and the pivots' size is bounded, as they
are broadcast.  No step holds more than ``LANE`` targets and points at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.functions.metrics import EUCLIDEAN, Metric
from pointloom.operators.pairs import BLOCK, LANE, SMALL
from pointloom.plans.ranks import stored

#: Bytes of the pivots that are broadcast, at most.
PIVOT_BYTES = 8 << 20
#: Bounds are rounded: a cell is left out only where it lies farther by more than this share.
SLACK = 1e-9
#: What rounding takes from a distance to a pivot, at most: where pivots lie far off, it is more than that share of a bound.
ROUNDING = 1e-11


def has_triangles(metric: Metric) -> bool:
    """Whether the triangle inequality holds, which bounds need."""
    return metric.exponent >= 1


def places(points: DataFrame) -> DataFrame:
    """(point_id, coords, n): each place once, under its smallest id, with the number of points there."""
    return points.groupBy("coords").agg(F.min("point_id").alias("point_id"), F.count("*").alias("n")).select("point_id", "coords", "n")


def _vectors(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = batch["coords"]
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


@dataclass
class Pivots:
    """Pivots, and lanes of their cells: cell j has the lanes from first[j] on, parts[j] of them."""

    metric: Metric
    ids: np.ndarray
    coords: np.ndarray
    radius: np.ndarray | None = None
    first: np.ndarray | None = None
    parts: np.ndarray | None = None

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """What no target of a cell is nearer than, from distances (points, pivots) to all pivots."""
        own = d.min(1, keepdims=True)
        return np.maximum(d - self.radius, (d - own) / 2) * (1 - SLACK) - ROUNDING * d


def _parted(coords: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """A group for each pivot: halves along the widest side until there are so many, of about the same weight."""
    out = np.zeros(len(coords), np.int64)
    stack = [(np.arange(len(coords)), groups, 0)]
    while stack:
        own, n, base = stack.pop()
        if n <= 1 or len(own) <= 1:
            out[own] = base
            continue
        side = int(np.argmax(np.ptp(coords[own], axis=0)))
        own = own[np.argsort(coords[own, side], kind="stable")]
        left = n // 2
        cut = int(np.searchsorted(np.cumsum(weight[own]), weight[own].sum() * left / n)) + 1
        cut = min(max(cut, 1), len(own) - 1)
        stack += [(own[:cut], left, base), (own[cut:], n - left, base + left)]
    return out


def _choose(targets: DataFrame, metric: Metric, n: int) -> Pivots:
    """Pivots in a fixed pseudo-random order of the targets."""
    first = targets.select(F.size("coords").alias("d")).first()
    most = max(1, min(math.ceil(math.sqrt(n)), PIVOT_BYTES // (8 * max(1, first["d"]))))
    rows = targets.select("point_id", "coords").orderBy(F.xxhash64("point_id", F.lit(5)), "point_id").limit(most).collect()  # bounded in bytes
    return Pivots(metric, np.array([r["point_id"] for r in rows], np.int64), np.array([list(r["coords"]) for r in rows], float).reshape(len(rows), -1))


#: Places of a sample that tells whether bounds are worth their rounds.
SAMPLE = 4096


def _sampled(points: DataFrame) -> np.ndarray:
    """Different places of some points in a fixed pseudo-random order, bounded in number and bytes."""
    first = points.select(F.size("coords").alias("d")).first()
    most = max(64, min(SAMPLE, PIVOT_BYTES // (8 * max(1, first["d"])))) if first else 0
    rows = points.select("coords").orderBy(F.xxhash64("point_id", F.lit(6)), "point_id").limit(most).collect()
    x = np.array([list(r["coords"]) for r in rows], float).reshape(len(rows), -1)
    return np.random.default_rng(0).permutation(np.unique(x, axis=0)) if len(x) else x


def bounds_help(points: DataFrame, others: DataFrame | None = None, metric: Metric = EUCLIDEAN) -> bool:
    """Whether bounds would leave out half of the pairs of a sample; distances are the same either way, but not the time."""
    y = _sampled(points if others is None else others)
    x = y if others is None else _sampled(points)
    if not len(x) or not len(y):
        return True
    pivots = Pivots(metric, np.arange(k := math.isqrt(len(y))), y[:k], np.zeros(k))
    to = metric.quick(y, pivots.coords)
    np.maximum.at(pivots.radius, cell := to.argmin(1), to.min(1))
    x = x[:BLOCK]
    d = metric.quick(x, y)
    if others is None:
        d[np.arange(len(x)), np.arange(len(x))] = np.inf
    kept = (pivots.bounds(metric.quick(x, pivots.coords)) < d.min(1)[:, None]) @ np.bincount(cell, minlength=k)
    return bool(kept.mean() < len(y) / 2)


ASSIGNED = "point_id long, coords array<double>, n long, cell int, gap double, bound double"


def _assigned(points: DataFrame, pivots: Pivots, itself: bool) -> DataFrame:
    """Points with their nearest pivot, its distance, and that of the nearest pivot that is another point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                part = batch.slice(lo, BLOCK)
                d = pivots.metric.quick(_vectors(part), pivots.coords)
                cell = d.argmin(1)
                gap = d[np.arange(len(d)), cell]
                if itself:
                    d = np.where(part["point_id"].to_numpy()[:, None] == pivots.ids, np.inf, d)
                yield pa.RecordBatch.from_arrays([part["point_id"], part["coords"], part["n"], pa.array(cell, pa.int32()), pa.array(gap), pa.array(d.min(1))], ["point_id", "coords", "n", "cell", "gap", "bound"])

    return stored(points.select("point_id", "coords", "n").mapInArrow(run, ASSIGNED))


def _with_lanes(pivots: Pivots, targets: DataFrame, n: int) -> Pivots:
    """Radius of each cell, and its lanes; the driver gets a row for each pivot."""
    radius, count = np.zeros(len(pivots.ids)), np.zeros(len(pivots.ids), np.int64)
    for r in targets.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect():
        radius[r["cell"]], count[r["cell"]] = r["gap"], r["n"]
    enough = math.ceil(math.sqrt(2 * int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    groups = min(len(pivots.ids), max(math.ceil(2 * n / LANE), min(math.ceil(n / SMALL), enough), 1))
    group = _parted(pivots.coords, np.maximum(count, 1), groups)
    # a cell beyond a lane has lanes of its own
    parts = np.maximum(1, -(-count // LANE))
    group = np.where(parts > 1, groups + np.arange(len(group)), group)
    names, place = np.unique(group, return_inverse=True)
    width = np.ones(len(names), np.int64)
    np.maximum.at(width, place, parts)
    start = np.cumsum(width) - width
    return Pivots(pivots.metric, pivots.ids, pivots.coords, radius, start[place], parts)


MET = "point_id long, coords array<double>, n long, lane int, dist double, compared long"


def _compared(targets: DataFrame, points: DataFrame, pivots: Pivots, itself: bool) -> DataFrame:
    """(point_id, coords, n, lane, dist, compared) of points (.., lane, bound) that meet the targets of their lane."""
    points = points.withColumn("lane", F.col("lane").cast("int"))
    # a row for each lane that has points: how many groups of them meet its targets
    shares = points.groupBy("lane").agg(F.ceil(F.count("*") / LANE).cast("int").alias("shares"))
    known = F.broadcast(shares)
    columns = ("side", "lane", "share", "point_id", "coords", "n", "cell", "bound")
    one = points.join(known, "lane").withColumns({"side": F.lit(0), "share": F.pmod(F.xxhash64("point_id"), F.col("shares")).cast("int")}).select(*columns)
    lane_of = F.get(F.lit(pivots.first.tolist()), F.col("cell")) + F.pmod(F.xxhash64("point_id", F.lit(3)), F.get(F.lit(pivots.parts.tolist()), F.col("cell")))
    other = targets.withColumn("lane", lane_of.cast("int")).join(known, "lane").withColumns({"side": F.lit(1), "share": F.explode(F.sequence(F.lit(0), F.col("shares") - 1))}).select(*columns)

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        side = rows["side"].to_numpy()
        mine, theirs = rows.filter(pa.array(side == 0)), rows.filter(pa.array(side == 1))
        cells = theirs["cell"].to_numpy()
        order = np.argsort(cells, kind="stable")
        y, other_ids = _vectors(theirs)[order], theirs["point_id"].to_numpy()[order]
        names, begin = np.unique(cells[order], return_index=True)
        end = np.append(begin[1:], len(order))
        x, ids, own, best = _vectors(mine), mine["point_id"].to_numpy(), mine["cell"].to_numpy(), mine["bound"].to_numpy().copy()
        compared = np.zeros(len(x), np.int64)

        def meet(at: np.ndarray, k: int) -> None:
            for lo in range(0, len(at), BLOCK):
                for to in range(begin[k], end[k], BLOCK):
                    a, b = at[lo : lo + BLOCK], slice(to, min(to + BLOCK, end[k]))
                    d = pivots.metric.quick(x[a], y[b])
                    if itself:
                        d[ids[a][:, None] == other_ids[b]] = np.inf
                    best[a] = np.minimum(best[a], d.min(1))
                    compared[a] += d.shape[1]

        place = np.searchsorted(names, own)
        here = (place < len(names)) & (names[np.minimum(place, len(names) - 1)] == own)
        for k in np.unique(place[here]):
            meet(np.flatnonzero(here & (place == k)), k)
        for lo in range(0, len(x), BLOCK):
            part = np.arange(lo, min(lo + BLOCK, len(x)))
            d = pivots.metric.quick(x[part], pivots.coords)
            compared[part] += d.shape[1]
            low = pivots.bounds(d)[:, names]
            for k in np.argsort(low.min(0), kind="stable"):
                near = part[(low[:, k] < best[part]) & ~(here[part] & (place[part] == k))]
                if len(near):
                    meet(near, k)
        return pa.table([mine["point_id"], mine["coords"], mine["n"], mine["lane"], pa.array(best), pa.array(compared)], names=["point_id", "coords", "n", "lane", "dist", "compared"])

    return one.unionAll(other).groupBy("lane", "share").applyInArrow(run, MET)


def _spread(met: DataFrame, pivots: Pivots, bound: float | None) -> DataFrame:
    """A row for each point and further lane with a cell that may hold something nearer."""
    lanes = int((pivots.first + pivots.parts).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                part = batch.slice(lo, BLOCK)
                d = pivots.metric.quick(_vectors(part), pivots.coords)
                best = part["dist"].to_numpy()
                near = pivots.bounds(d) < (best if bound is None else np.minimum(best, bound))[:, None]
                wanted = np.zeros((len(part), lanes), bool)
                for k in range(int(pivots.parts.max())):
                    rows, cells = np.nonzero(near & (pivots.parts > k))
                    wanted[rows, pivots.first[cells] + k] = True
                wanted[np.arange(len(part)), part["lane"].to_numpy()] = False
                rows, lane = np.nonzero(wanted)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([part["point_id"].take(take), part["coords"].take(take), part["n"].take(take), pa.array(d.argmin(1)[rows], pa.int32()), pa.array(lane, pa.int32()), pa.array(best[rows])], ["point_id", "coords", "n", "cell", "lane", "bound"])

    return stored(met.mapInArrow(run, "point_id long, coords array<double>, n long, cell int, lane int, bound double"))


def nearest_places(points: DataFrame, others: DataFrame | None = None, metric: Metric = EUCLIDEAN, closest_only: bool = False) -> DataFrame:
    """(point_id, n, dist, compared): for each place of points the distance to the nearest of ``others``, or to the nearest other point.

    Without ``others``, a place with several points has distance 0, and infinity stands for no other point.
    ``compared`` counts the distances taken for a place, those to pivots among them.  With ``closest_only``
    distances above the least of all may be too large; the least is right.
    """
    if not has_triangles(metric):
        raise ValueError("bounds need an exponent of at least 1")
    itself = others is None
    mine = places(points)
    theirs = mine if itself else places(others)
    if itself:
        mine = theirs = stored(mine)
    n = theirs.count()
    spark = points.sparkSession
    if not n:
        return mine.select("point_id", "n", F.lit(float("inf")).alias("dist"), F.lit(0).cast("long").alias("compared"))
    pivots = _choose(theirs, metric, n)
    assigned = _assigned(mine, pivots, itself)
    targets = assigned if itself else _assigned(theirs, pivots, False)
    pivots = _with_lanes(pivots, targets, n)
    home = F.get(F.lit(pivots.first.tolist()), F.col("cell")) + F.pmod(F.xxhash64("point_id", F.lit(3)), F.get(F.lit(pivots.parts.tolist()), F.col("cell")))
    met = stored(_compared(targets, assigned.withColumn("lane", home), pivots, itself))
    least = met.agg(F.min("dist")).first()[0] if closest_only else None
    further = _compared(targets, _spread(met, pivots, least), pivots, itself)
    both = met.unionAll(further).groupBy("point_id").agg(F.first("n").alias("n"), F.min("dist").alias("dist"), (F.sum("compared") + 2 * len(pivots.ids)).alias("compared"))
    dist = F.when(F.col("n") > 1, 0.0).otherwise(F.col("dist")) if itself else F.col("dist")
    return both.select("point_id", "n", dist.alias("dist"), "compared")
