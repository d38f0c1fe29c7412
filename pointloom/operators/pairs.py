"""All-pairs work in cells: partial results of pairs of lanes, never pairs as rows.

Points are dealt into lanes; a cell is a pair of lanes, one group of Spark and some
numpy kernels, whose small partial results Spark aggregates.  Work grows with the
square of the points, as the measures do by definition.

Without groups a point travels once: points are packed into blocks, a row each, and
Spark's Cartesian product of stored blocks gives the cells, so that nothing of the
square is shuffled.  With groups a point travels once for each lane that its own meets:
there are about as many lanes as the root of twice the number of shuffle partitions, so
that cells fill the cluster, and more only where lanes of ``LANE`` points, the bound on
what a task holds, are not enough.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.plans.ranks import stored

#: Points of one lane, of one kernel, and of a lane that is too small to be parted.
LANE, BLOCK, SMALL = 16_384, 1024, 256
#: Blocks of either side that a task of a product without groups meets, and rows of a batch that it gives.
HELD, ROWS = 4, 1 << 17

Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool], dict | Iterator[dict]]


def _enough(points: DataFrame) -> int:
    return math.ceil(math.sqrt(2 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def lane_counts(points: DataFrame, name: str, lane: int = LANE) -> DataFrame:
    """The number of lanes of each group."""
    n = F.count("*")
    return points.groupBy("group").agg(F.greatest(F.ceil(n / lane), F.least(F.ceil(n / SMALL), F.lit(_enough(points))), F.lit(1)).cast("int").alias(name))


def packed_blocks(points: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, ids, coords): points in blocks of ``size`` at most, their coordinates one after another; stored."""
    n = points.count()
    # a task meets blocks of a larger size one by one, in as few parts as keep all cores busy
    held, enough = (HELD, _enough(points)) if size <= BLOCK else (1, math.ceil(math.sqrt(2 * points.sparkSession.sparkContext.defaultParallelism)))
    parts = max(1, math.ceil(n / (held * size)), min(math.ceil(n / SMALL), enough))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []

        def made(table: pa.Table) -> pa.RecordBatch:
            ids, coords = table["point_id"].combine_chunks(), table["coords"].combine_chunks().flatten()
            whole = [pa.array([0, len(a)], pa.int32()) for a in (ids, coords)]
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(whole[0], ids), pa.ListArray.from_arrays(whole[1], coords)], ["ids", "coords"])

        for batch in batches:
            kept.append(pa.table(batch))
            table = pa.concat_tables(kept)
            full = len(table) // size * size
            for lo in range(0, full, size):
                yield made(table.slice(lo, size))
            kept = [table.slice(full)]
        if kept and len(kept[0]):
            yield made(kept[0])

    rows = points.select(F.col("point_id").cast("long").alias("point_id"), F.col("coords").cast("array<double>").alias("coords"))
    return stored(rows.repartition(parts).mapInArrow(pack, "ids array<long>, coords array<double>").select(F.monotonically_increasing_id().alias("block"), "ids", "coords"))


def _product_partials(points: DataFrame, others: DataFrame | None, kernel: Kernel, fields: T.StructType, size: int) -> DataFrame:
    """The partial results of ``pair_partials`` without groups: tasks read blocks of both sides where they are stored."""
    itself = others is None
    one = packed_blocks(points, size)
    two = one if itself else packed_blocks(others, size)
    left, right = (side.select(*[F.col(c).alias(f"{c}{k}") for c in ("block", "ids", "coords")]) for k, side in ((1, one), (2, two)))
    # the hint keeps Spark from sending one side whole to every task
    met = left.hint("shuffle_replicate_nl").join(right, F.col("block1") <= F.col("block2") if itself else None, "inner" if itself else "cross")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(fields)
        for batch in batches:
            for k in range(len(batch)):
                ids, other, x, y = (batch[c][k].values.to_numpy(zero_copy_only=False) for c in ("ids1", "ids2", "coords1", "coords2"))
                same = itself and batch["block1"][k] == batch["block2"][k]
                made = kernel(ids, x.reshape(len(ids), -1), other, y.reshape(len(other), -1), same)
                for out in [made] if isinstance(made, dict) else made:
                    yield from pa.table([pa.array(np.atleast_1d(out[f.name]), f.type) for f in arrow], schema=arrow).to_batches(ROWS)

    return met.mapInArrow(run, fields)


def pair_partials(points: DataFrame, others: DataFrame | None, kernel: Kernel, schema: str, lane: int = LANE, by: str | None = None, block: int = BLOCK) -> DataFrame:
    """Rows that ``kernel(ids, coords, other ids, other coords, same points)`` gives for all pairs of blocks of points.

    Without ``others`` the pairs are those of points with themselves, each pair of blocks once. With ``by`` only
    points of one group (a column of both sets, never null) are paired, and the group is the first column. Without
    it ``block`` points at most are given to the kernel at once, which may give its rows piece by piece.
    """
    fields = T._parse_datatype_string(schema)
    if not by:
        return _product_partials(points, others, kernel, fields, min(lane, block))
    known = lambda df: df.select(F.col(by).alias("group"), "point_id", "coords")
    own = lambda lanes: F.pmod(F.xxhash64("point_id"), F.col(lanes)).cast("int")
    upto = lambda lanes: F.explode(F.sequence(F.lit(0), F.col(lanes) - 1))
    itself = others is None
    if itself:
        placed = known(points).join(lane_counts(known(points), "lanes", lane), "group").withColumn("own", own("lanes")).withColumn("partner", upto("lanes"))
        cells = placed.select("group", F.least("own", "partner").alias("one"), F.greatest("own", "partner").alias("two"), F.when(F.col("own") > F.col("partner"), 1).otherwise(0).alias("side"), "point_id", "coords")
    else:
        # a group that one side lacks has no pairs
        lanes = lane_counts(known(points), "lanes", lane).join(lane_counts(known(others), "other_lanes", lane), "group")
        left = known(points).join(lanes, "group").select("group", own("lanes").alias("one"), upto("other_lanes").alias("two"), F.lit(0).alias("side"), "point_id", "coords")
        right = known(others).join(lanes, "group").select("group", upto("lanes").alias("one"), own("other_lanes").alias("two"), F.lit(1).alias("side"), "point_id", "coords")
        cells = left.unionAll(right)
    fields = T.StructType([T.StructField(by, cells.schema["group"].dataType), *fields])

    def blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        ids, coords = table["point_id"].to_numpy(), table["coords"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        order = np.argsort(ids, kind="stable")
        for lo in range(0, len(order), BLOCK):
            yield ids[order[lo : lo + BLOCK]], np.asarray(coords[order[lo : lo + BLOCK]], float)

    def run(key: tuple[pa.Scalar, ...], cell: pa.Table) -> pa.Table:
        arrow = to_arrow_schema(fields)
        side = cell["side"].to_numpy()
        left = list(blocks(cell.filter(pa.array(side == 0)))) if (side == 0).any() else []
        right = list(blocks(cell.filter(pa.array(side == 1)))) if (side == 1).any() else []
        inside = itself and key[1] == key[2]
        pairs = ((i, j) for i in range(len(left)) for j in range(i if inside else 0, len(left if inside else right)))
        made = []
        for i, j in pairs:
            out = {n: np.atleast_1d(v) for n, v in kernel(*left[i], *(left if inside else right)[j], inside and i == j).items()}
            out[by] = [key[0].as_py()] * len(next(iter(out.values())))
            made.append(pa.table([pa.array(out[f.name], f.type) for f in arrow], schema=arrow))
        return pa.concat_tables(made) if made else arrow.empty_table()

    return cells.groupBy("group", "one", "two").applyInArrow(run, fields)
