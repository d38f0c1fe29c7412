"""Sums over pairs of a product of (1 - max) * min in each dimension, without the pairs.

In one dimension the factor of a pair is the smaller value times one less the
larger, so where it is known which point is smaller, the sum over pairs of two
sets is a product of two sums.  Points are sorted by range and cut into slabs of
``SLAB``; the slabs' positions are the leaves of a binary tree, and every pair of
points in different slabs is split by exactly one node of it.  A node with its two
halves is a problem of one dimension less, in which points carry the factors of
the dimensions done; two problems, where the sides may lie either way round.
Pairs within a slab are multiplied out, at a cost that is linear in the points.

With n points and L = log2(n / SLAB) levels, d dimensions take d range sorts, the
last over n * L**(d - 1) slim rows; the last dimension needs sums of slabs only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pointloom.plans.ranks import ranked, stored

#: Points of a slab, a power of two, and of one block of its pairs.
SLAB, BLOCK = 4096, 1024
#: Groups (of some tens of bytes each) that are broadcast at most; more are joined by a shuffle.
GROUPS = 100_000


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(y)))
    for j in range(x.shape[1]):
        out *= (1 - np.maximum(x[:, j, None], y[None, :, j])) * np.minimum(x[:, j, None], y[None, :, j])
    return out


def pair_sum(x: np.ndarray) -> float:
    """Sum over pairs of different rows, each pair once."""
    total = 0.0
    for i in range(0, len(x), BLOCK):
        total += np.triu(_products(x[i : i + BLOCK], x[i : i + BLOCK]), 1).sum()
        for j in range(i + BLOCK, len(x), BLOCK):
            total += _products(x[i : i + BLOCK], x[j : j + BLOCK]).sum()
    return float(total)


def cross_sum(x: np.ndarray, v: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum over pairs of a row of x and one of y, with their weights."""
    return float(sum(v[i : i + BLOCK] @ _products(x[i : i + BLOCK], y[j : j + BLOCK]) @ w[j : j + BLOCK] for i in range(0, len(x), BLOCK) for j in range(0, len(y), BLOCK)))


def _within(placed: DataFrame, itself: bool) -> DataFrame:
    """(by, pairs): sums over pairs of the same slab and group."""
    fields = T.StructType([T.StructField("by", placed.schema["by"].dataType), T.StructField("pairs", T.DoubleType())])

    def run(slab: pa.Table) -> pa.Table:
        slab = slab.sort_by("pos")
        group = slab["group"].to_numpy()
        coords = slab["rest"].combine_chunks().flatten().to_numpy().reshape(len(slab), -1)
        side, weight = slab["side"].to_numpy(), slab["weight"].to_numpy()
        cuts = np.flatnonzero(np.diff(group)) + 1
        first, sums = np.append(0, cuts), []
        for a, b in zip(first, np.append(cuts, len(slab))):
            x, s, w = coords[a:b], side[a:b], weight[a:b]
            sums.append(pair_sum(x) if itself else cross_sum(x[s == 0], w[s == 0], x[s == 1], w[s == 1]))
        return pa.table([slab["by"].take(pa.array(first)), pa.array(sums, pa.float64())], schema=to_arrow_schema(fields))

    rows = placed.select("by", F.xxhash64("by", "path").alias("group"), "slab", "pos", "side", "weight", "rest")
    return rows.groupBy("slab").applyInArrow(run, fields)


def _split(rows: DataFrame, dimension: int, itself: bool) -> Iterator[DataFrame]:
    """(by, pairs) from rows (by, path, point_id, side, weight, rest) whose ``rest`` has ``dimension`` coordinates."""
    value = F.get("rest", 0)
    placed = stored(ranked(rows, F.col("by"), F.col("path"), value, F.col("side"), F.col("point_id")).withColumn("slab", F.shiftright("pos", SLAB.bit_length() - 1)))
    yield _within(placed, itself)
    # groups that lie in several slabs are fewer than slabs
    spans = stored(placed.groupBy("by", "path").agg(F.min("slab").alias("low"), F.max("slab").alias("high")).where("low < high"))
    known = spans.count()
    if not known:
        return
    keys = [placed["by"].eqNullSafe(spans["by"]), placed["path"] == spans["path"]]
    wide = placed.join(F.broadcast(spans) if known <= GROUPS else spans, keys).select(placed["*"], F.length(F.bin(F.col("low").bitwiseXOR(F.col("high")))).alias("levels"))
    levels = F.explode(F.sequence(F.lit(1), F.col("levels"))).alias("level")
    half = F.call_function("shiftright", F.col("slab"), F.col("level") - 1).bitwiseAND(F.lit(1))
    node = F.call_function("shiftright", F.col("slab"), F.col("level"))
    if dimension == 1:
        low, high = F.col("weight") * value, F.col("weight") * (1 - value)
        sums = [F.sum(F.when(F.col("side") == s, v)).alias(f"{n}{s}") for s in (0, 1) for n, v in (("low", low), ("high", high))]
        slabs = wide.groupBy("by", "path", "slab", "levels").agg(*sums).select("*", levels).withColumns({"half": half, "node": node})
        at = lambda c, h: F.coalesce(F.sum(F.when(F.col("half") == h, F.col(c))), F.lit(0.0))
        met = at("low0", 0) * at("high0", 1) if itself else at("low0", 0) * at("high1", 1) + at("low1", 0) * at("high0", 1)
        yield slabs.groupBy("by", "path", "level", "node").agg(met.alias("pairs")).select("by", "pairs")
        return
    split = wide.select("*", levels).withColumns({"half": half.cast("int"), "node": node})
    # whether the left side lies below; of a set with itself the lower half is the left side
    turned = F.lit(0) if itself else F.col("half").bitwiseXOR(F.col("side"))
    weight: Column = F.col("weight") * F.when(F.col("half") == 0, value).otherwise(1 - value)
    step = F.array(*[c.cast("long") for c in (F.col("level"), F.col("node"), turned)])
    side = F.col("half") if itself else F.col("side")
    further = split.select("by", F.concat("path", step).alias("path"), "point_id", side.alias("side"), weight.alias("weight"), F.slice("rest", 2, dimension - 1).alias("rest"))
    yield from _split(further, dimension - 1, False)


def dominance_sums(points: DataFrame, dimension: int, by: str | None = None) -> DataFrame:
    """(by, pairs): for each group the sum over pairs of different points of the product of (1 - max) * min, each pair once.

    Groups without a pair may be missing; without ``by`` the group is 0.
    """
    rows = points.select((F.col(by) if by else F.lit(0)).alias("by"), F.array().cast("array<bigint>").alias("path"), "point_id", F.lit(0).alias("side"), F.lit(1.0).alias("weight"), F.col("coords").alias("rest"))
    parts = list(_split(rows, dimension, True))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("by").agg(F.sum("pairs").alias("pairs"))
