"""Voronoi cells of points in the unit square, exact, as rows.

Points are dealt into leaves: slabs by range of x, and runs of a slab by y. A cell starts as the square cut by
the points of its own leaf. It is proved when the circles around its corners, through its point, hold no other
point; so a cell asks the nearest leaves that such a circle meets, twice as many in each round, and is cut by the
points that they find inside. A leaf that a cell has asked never changes it again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.operators.neighbours import places
from pointloom.plans.ranks import stored

#: Points of a leaf, and leaves at most: their bounds, 40 bytes each, are a broadcast. Leaves of more than 268 million points are larger.
LEAF, LEAVES = 1024, 262_144
#: Cells that ask a leaf in one task.
ASKERS = 20_000
#: A point cuts a cell where it is nearer to a corner than the cell's own by more than this.
NEARER = 1e-11
#: Nearest points of its leaf that cut a cell before its corners are looked at, and distances held at once.
FIRST_CUTS, BLOCK = 12, 4_000_000

_CELL = "point_id long, x double, y double, corners array<double>"


def _cut(corners: np.ndarray, size: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex polygons (n, k, 2) of ``size`` corners, each without what is nearer to ``other`` than to ``own``."""
    n, k, _ = corners.shape
    slot, size = np.arange(k), size[:, None]
    following = np.where(slot + 1 < size, slot + 1, 0)
    side = ((corners - ((own + other) / 2)[:, None]) * (other - own)[:, None]).sum(2)
    after = np.take_along_axis(side, following, 1)
    live = slot < size
    stays, crosses = live & (side <= 0), live & ((side <= 0) != (after <= 0))
    step = np.divide(side, side - after, out=np.zeros_like(side), where=crosses)
    between = corners + step[..., None] * (np.take_along_axis(corners, following[..., None], 1) - corners)
    every = np.stack([corners, between], 2).reshape(n, 2 * k, 2)
    kept = np.stack([stays, crosses], 2).reshape(n, 2 * k)
    size = kept.sum(1)
    order = np.argsort(~kept, axis=1, kind="stable")[:, : max(1, size.max(initial=0))]
    return np.take_along_axis(every, order[..., None], 1), size


def _radii(corners: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Distance of each corner to the cell's own point; minus infinity beyond the last one."""
    r = np.sqrt(((corners - own[:, None]) ** 2).sum(2))
    return np.where(np.arange(corners.shape[1]) < size[:, None], r, -np.inf)


def _fill(into: np.ndarray, rows: np.ndarray, part: np.ndarray) -> np.ndarray:
    """``into`` with some of its polygons replaced, widened where they have more corners."""
    if part.shape[1] > into.shape[1]:
        into = np.pad(into, ((0, 0), (0, part.shape[1] - into.shape[1]), (0, 0)))
    into[rows, : part.shape[1]] = part
    return into


def _cut_by(corners: np.ndarray, size: np.ndarray, own: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Cells cut by ``among`` until none of these is nearer to a corner than the cell's own point; and the cutting points."""
    used: list[list[int]] = [[] for _ in range(len(own))]
    active = np.arange(len(own))
    while len(active):
        cells, sizes, mine = corners[active], size[active], own[active]
        r = _radii(cells, sizes, mine)
        flat = cells.reshape(-1, 2)
        nearest, dist = np.empty(len(flat), np.int64), np.empty(len(flat))
        rows = max(1, BLOCK // max(1, len(among)))
        for lo in range(0, len(flat), rows):
            d = (flat[lo : lo + rows, None, 0] - among[None, :, 0]) ** 2 + (flat[lo : lo + rows, None, 1] - among[None, :, 1]) ** 2
            nearest[lo : lo + rows] = d.argmin(1)
            dist[lo : lo + rows] = np.sqrt(d.min(1))
        nearest, inside = nearest.reshape(r.shape), r - dist.reshape(r.shape) > NEARER
        for j in range(r.shape[1]):
            some = np.flatnonzero(inside[:, j])
            if len(some):
                for i in some:
                    used[active[i]].append(int(nearest[i, j]))
                part, sizes[some] = _cut(cells[some], sizes[some], mine[some], among[nearest[some, j]])
                cells = _fill(cells, some, part)
        corners, size[active] = _fill(corners, active, cells), sizes
        active = active[inside.any(1)]
    return corners, size, used


def _unpacked(flat: list) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(c) // 2 for c in flat], np.int64)
    corners = np.zeros((len(flat), max(1, size.max(initial=0)), 2))
    for i, c in enumerate(flat):
        corners[i, : size[i]] = np.reshape(c, (-1, 2))
    return corners, size


def _packed(corners: np.ndarray, size: np.ndarray) -> list[list[float]]:
    return [c[:n].ravel().tolist() for c, n in zip(corners, size)]


def _dealt(points: DataFrame) -> DataFrame:
    """(leaf, slab, point_id, x, y): distinct places in leaves of a bounded number."""
    found = stored(places(points).select("point_id", F.get("coords", 0).alias("x"), F.get("coords", 1).alias("y")))
    n = found.count()
    leaf = max(LEAF, -(-2 * n // LEAVES))
    slabs = max(1, min(math.isqrt(n // leaf), LEAVES // 2))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            number = (row + np.arange(len(batch))) // leaf + (slab << 32)
            row += len(batch)
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.full(len(batch), slab)), *batch.columns], names=["leaf", "slab", *batch.schema.names])

    # points of one x may lie in several slabs, whose ranges then meet
    return stored(found.repartitionByRange(slabs, "x", "y").sortWithinPartitions("y", "x").mapInArrow(runs, "leaf long, slab long, point_id long, x double, y double"))


class _Directory:
    """Bounds of all leaves, by slab, and the nearest ones that circles of cells meet."""

    def __init__(self, bounds: pd.DataFrame) -> None:
        bounds = bounds.sort_values("leaf")
        self.leaf = bounds["leaf"].to_numpy()
        self.lo, self.hi = bounds[["lx", "ly"]].to_numpy(), bounds[["hx", "hy"]].to_numpy()
        self.slabs = np.split(np.arange(len(bounds)), np.flatnonzero(np.diff(bounds["slab"].to_numpy())) + 1) if len(bounds) else []
        self.width = np.median((self.hi - self.lo).max(1)) + 1e-3 / math.sqrt(max(1, len(bounds))) if len(bounds) else 1.0

    def _in_windows(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, place in the directory) of leaves that meet windows."""
        window, place = [], []
        for rows in self.slabs:
            some = np.flatnonzero((lo[:, 0] <= self.hi[rows, 0].max()) & (hi[:, 0] >= self.lo[rows, 0].min()))
            first = np.searchsorted(self.hi[rows, 1], lo[some, 1], "left")
            n = np.maximum(np.searchsorted(self.lo[rows, 1], hi[some, 1], "right") - first, 0)
            window.append(np.repeat(some, n))
            place.append(rows[0] + np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        return np.concatenate(window), np.concatenate(place)

    def next_leaves(self, corners: np.ndarray, size: np.ndarray, own: np.ndarray, asked: list[set[int]], most: int) -> list[list[int]]:
        """For each cell up to ``most`` leaves, the nearest first, that it has not asked and that a circle of it meets."""
        out: list[list[int]] = [[] for _ in range(len(own))]
        r = _radii(corners, size, own)
        live = np.isfinite(r)
        low = np.where(live[..., None], corners - r[..., None], np.inf).min(1)
        high = np.where(live[..., None], corners + r[..., None], -np.inf).max(1)
        active, reach = np.flatnonzero(size > 0), self.width
        while len(active):
            lo, hi = np.maximum(low[active], own[active] - reach), np.minimum(high[active], own[active] + reach)
            window, place = self._in_windows(lo, hi)
            cell = active[window]
            apart = np.maximum(np.maximum(self.lo[place][:, None] - corners[cell], corners[cell] - self.hi[place][:, None]), 0)
            meets = (r[cell] - np.sqrt((apart**2).sum(2)) > NEARER).any(1)
            cell, place = cell[meets], place[meets]
            away = np.maximum(np.maximum(self.lo[place] - own[cell], own[cell] - self.hi[place]), 0).max(1)
            found: dict[int, list[int]] = {}
            for k in np.lexsort((place, away)):
                if int(self.leaf[place[k]]) not in asked[cell[k]]:
                    found.setdefault(int(cell[k]), []).append(int(self.leaf[place[k]]))
            for i, leaves in found.items():
                out[i] = leaves[:most]
            whole = ((own[active] - reach <= low[active]) & (own[active] + reach >= high[active])).all(1)
            active = active[~whole & np.array([len(out[i]) < most for i in active], bool)]
            reach *= 2
        return out


def _directory(leaves: DataFrame) -> _Directory:
    bounds = leaves.groupBy("leaf", "slab").agg(F.min("x").alias("lx"), F.min("y").alias("ly"), F.max("x").alias("hx"), F.max("y").alias("hy"))
    return _Directory(bounds.toPandas())  # LEAVES rows at most


def _own_cells(leaves: DataFrame) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[["x", "y"]].to_numpy()
        corners, size = np.tile([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]], (len(own), 1, 1)), np.full(len(own), 4)
        first = min(FIRST_CUTS, len(own) - 1)
        if first:
            near = np.empty((len(own), first), np.int64)
            step = max(1, BLOCK // len(own))
            for lo in range(0, len(own), step):
                d = ((own[lo : lo + step, None] - own[None]) ** 2).sum(2)
                d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
                near[lo : lo + step] = np.argpartition(d, first - 1, axis=1)[:, :first]
            for j in range(first):
                corners, size = _cut(corners, size, own, own[near[:, j]])
        corners, size, _ = _cut_by(corners, size, own, own)
        return rows[["point_id", "x", "y"]].assign(corners=_packed(corners, size), asked=[[leaf] for leaf in rows["leaf"]])

    return leaves.groupBy("leaf").applyInPandas(run, f"{_CELL}, asked array<long>")


def _cuts_of(asking: DataFrame, leaves: DataFrame) -> DataFrame:
    """(point_id, cuts): points of asked leaves that cut a cell. A leaf that many cells ask is copied to several tasks."""
    shares = stored(asking.groupBy("leaf").count().select("leaf", (1 + F.floor(F.col("count") / ASKERS)).alias("shares")))
    dealt = asking.join(shares, "leaf").withColumn("share", F.pmod(F.xxhash64("point_id"), F.col("shares")))
    held = leaves.select("leaf", "x", "y").join(shares, "leaf").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))

    def run(cells: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(cells):
            return pd.DataFrame({"point_id": [], "cuts": []})
        among = found[["x", "y"]].to_numpy()
        *_, used = _cut_by(*_unpacked(cells["corners"].tolist()), cells[["x", "y"]].to_numpy(), among)
        return pd.DataFrame({"point_id": cells["point_id"], "cuts": [among[u].ravel().tolist() for u in used]})

    return dealt.groupBy("leaf", "share").cogroup(held.groupBy("leaf", "share")).applyInPandas(run, "point_id long, cuts array<double>")


def voronoi_cells(points: DataFrame) -> DataFrame:
    """(point_id, x, y, corners): the part of the unit square that is nearest to each place, ``corners`` being x and y in turn.

    Points at one place are one, under the smallest id. A place outside the square whose cell does not meet it
    has no corners. Rows with null or other than two coordinates raise. A cell of very many corners is one row.
    """
    bad = points.where("coords IS NULL OR size(coords) != 2 OR exists(coords, v -> v IS NULL OR isnan(v) OR abs(v) = double('infinity'))")
    if not bad.isEmpty():
        raise ValueError("cells need two finite coordinates of each point")
    leaves = _dealt(points)
    directory = points.sparkSession.sparkContext.broadcast(_directory(leaves))
    cells, done, most = stored(_own_cells(leaves)), None, 1

    while True:

        def asked(batches: Iterator[pd.DataFrame], most: int = most) -> Iterator[pd.DataFrame]:
            for rows in batches:
                corners, size = _unpacked(rows["corners"].tolist())
                leaves = directory.value.next_leaves(corners, size, rows[["x", "y"]].to_numpy(), [set(map(int, a)) for a in rows["asked"]], most)
                yield rows.assign(leaves=leaves)

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for rows in batches:
                corners, size = _unpacked(rows["corners"].tolist())
                own, cuts = rows[["x", "y"]].to_numpy(), [np.reshape(c, (-1, 2)) for c in rows["cuts"]]
                for j in range(max((len(c) for c in cuts), default=0)):
                    some = np.array([i for i, c in enumerate(cuts) if j < len(c)])
                    part, size[some] = _cut(corners[some], size[some], own[some], np.array([cuts[i][j] for i in some]))
                    corners = _fill(corners, some, part)
                yield rows[["point_id", "x", "y", "asked"]].assign(corners=_packed(corners, size))

        routed = stored(cells.mapInPandas(asked, f"{_CELL}, asked array<long>, leaves array<long>"))
        proved = routed.where(F.size("leaves") == 0).select("point_id", "x", "y", "corners")
        done = proved if done is None else done.unionByName(proved)
        still = routed.where(F.size("leaves") > 0)
        if still.isEmpty():
            return done
        asking = still.select("point_id", "x", "y", "corners", F.explode("leaves").alias("leaf"))
        cuts = _cuts_of(asking, leaves).groupBy("point_id").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
        told = still.withColumn("asked", F.concat("asked", "leaves")).join(cuts, "point_id")
        cells, most = stored(told.mapInPandas(cut, f"{_CELL}, asked array<long>")), 2 * most


def vertices_of(cells: DataFrame) -> DataFrame:
    """(point_id, corner, coords, dist): the corners of cells in order, and how far each is from the nearest points."""
    corner = F.posexplode(F.sequence(F.lit(0), F.floor(F.size("corners") / 2).cast("int") - 1))
    rows = cells.where(F.size("corners") > 0).select("point_id", "x", "y", "corners", corner.alias("corner", "_k"))
    x, y = F.get("corners", 2 * F.col("corner")), F.get("corners", 2 * F.col("corner") + 1)
    return rows.select("point_id", "corner", F.array(x, y).alias("coords"), F.sqrt((x - F.col("x")) * (x - F.col("x")) + (y - F.col("y")) * (y - F.col("y"))).alias("dist"))


def areas_of(cells: DataFrame) -> DataFrame:
    """(point_id, area): the share of the unit square that each cell is; the shares add up to 1."""

    def areas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            corners, size = _unpacked(rows["corners"].tolist())
            slot = np.arange(corners.shape[1])
            following = np.where(slot + 1 < size[:, None], slot + 1, 0)
            turned = np.take_along_axis(corners, following[..., None], 1)
            cross = corners[..., 0] * turned[..., 1] - corners[..., 1] * turned[..., 0]
            yield pd.DataFrame({"point_id": rows["point_id"], "area": np.where(slot < size[:, None], cross, 0).sum(1) / 2})

    return cells.mapInPandas(areas, "point_id long, area double")
