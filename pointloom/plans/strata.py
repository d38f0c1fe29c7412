"""Strata: boxes that share out a cuboid, points in them, and boxes around points."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.rng import uniform
from pointloom.operators import matching
from pointloom.plans.designs import _digits, whole_root
from pointloom.plans.ranks import ranked, stored
from pointloom.schema import STRATA, positive, unitcube, vector


def stratify_conventional(spark: SparkSession, n: int, dimension: int) -> DataFrame:
    """Equal cells of a regular grid."""
    p = whole_root(n, dimension)
    cells = spark.range(n).withColumnRenamed("id", "point_id").select(F.col("point_id").alias("stratum_id"), F.array(*[x / p for x in _digits(p, dimension)]).alias("lo"))
    return cells.withColumn("hi", F.transform("lo", lambda x: x + 1.0 / p))


def _coin(seed: int, path: np.ndarray, turn: int) -> np.ndarray:
    """Uniform numbers that all rows on the same path share."""
    with np.errstate(over="ignore"):
        x = path + np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def stratify_generalized(spark: SparkSession, n: int, dimension: int, seed: int, cuboid: tuple[list[float], list[float]] | None = None, detect_special_case: bool = True, avoid_odd_numbers: bool = True) -> DataFrame:
    """n boxes of equal volume for any n: the longest side is split until each box counts one.

    Every row follows its own way down the splits, whose coins it shares with the rows of the same box, so
    that the boxes need neither the driver nor a shuffle.
    """
    positive(n=n, dimension=dimension)
    lower, upper = cuboid or unitcube(dimension)
    if len(lower) != dimension or len(upper) != dimension:
        raise ValueError("the cuboid has another dimension")
    if detect_special_case and (list(lower), list(upper)) == unitcube(dimension):
        try:
            return stratify_conventional(spark, n, dimension)
        except ValueError:
            pass

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            rows = len(ids)
            lo, hi = np.tile(np.array(lower, float), (rows, 1)), np.tile(np.array(upper, float), (rows, 1))
            count, place, path = np.full(rows, n), ids.copy(), np.ones(rows, np.uint64)
            while (count > 1).any():
                live = count > 1
                side = hi - lo
                longest = side == side.max(1, keepdims=True)
                choice = np.floor(_coin(seed, path, 1) * longest.sum(1)).astype(int)
                dim = (np.cumsum(longest, 1) > choice[:, None]).argmax(1)
                first = count // 2
                odd = avoid_odd_numbers & (count >= 6) & (first % 2 != 0) & (count % 2 == 0)
                first = first - odd
                first = np.where(_coin(seed, path, 2) < 0.5, count - first, first)
                at = np.arange(rows)
                cut = lo[at, dim] + side[at, dim] * (first / np.maximum(count, 1))
                left = place < first
                hi[at[live & left], dim[live & left]] = cut[live & left]
                lo[at[live & ~left], dim[live & ~left]] = cut[live & ~left]
                place = np.where(live & ~left, place - first, place)
                count = np.where(live, np.where(left, first, count - first), count)
                with np.errstate(over="ignore"):
                    path = np.where(live, path * np.uint64(0x9FB21C651E98DF25) + np.where(left, np.uint64(1), np.uint64(2)), path)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lo.tolist(), pa.list_(pa.float64())), pa.array(hi.tolist(), pa.list_(pa.float64()))], names=["stratum_id", "lo", "hi"])

    return spark.range(n).mapInArrow(descend, STRATA)


def stratified_sampling(strata: DataFrame, seed: int, bates_param: float = 1, latin: str = "none", matching_init: str = "approx") -> DataFrame:
    """(point_id, coords, error): one point in each stratum, ``point_id`` its stratum.

    ``bates_param`` numbers are averaged (infinity: the middle).  With ``latin`` each dimension's strata
    also take one of n bins: "approx" in the order of their middles, with ``error`` where stratum and bin do not
    meet and the stratum alone counts; "matching" by a perfect matching of strata and the bins they overlap, all
    dimensions at once, begun from the bins of "approx" or greedily ("greedy-det", "greedy-rand").
    """
    if bates_param < 1:
        raise ValueError("bates_param must be 1 at least")
    if latin not in ("none", "approx", "matching"):
        raise ValueError(f"unknown latin option {latin}")
    sides = strata.select("stratum_id", F.posexplode(F.arrays_zip("lo", "hi")).alias("dim", "side")).select("stratum_id", "dim", F.col("side.lo").alias("lo"), F.col("side.hi").alias("hi"))
    if latin == "none":
        placed = sides.withColumn("error", F.lit(False))
    else:
        n = strata.agg(F.count("*").alias("n"))
        # every dimension has n rows, so the place in its own order is the place in the order of all modulo n
        tie = uniform(seed, F.col("stratum_id"), F.col("dim"), F.lit("tie"))
        binned = ranked(sides, F.col("dim"), F.col("lo") + F.col("hi"), tie, F.col("stratum_id"), name="bin")
        if latin == "matching":
            binned = _matched(sides, binned.crossJoin(F.broadcast(n)).withColumn("bin", F.pmod("bin", "n")), n, seed, matching_init)
        binned = binned.crossJoin(F.broadcast(n))  # one row
        binned = binned.withColumn("bin", F.pmod("bin", "n"))
        low, high = F.greatest("lo", F.col("bin") * (1.0 / F.col("n"))), F.least("hi", (F.col("bin") + 1) * (1.0 / F.col("n")))
        placed = binned.select("stratum_id", "dim", F.when(high >= low, low).otherwise(F.col("lo")).alias("lo"), F.when(high >= low, high).otherwise(F.col("hi")).alias("hi"), (~(high >= low)).alias("error"))
    if math.isinf(bates_param):
        share = F.lit(0.5)
    else:
        k = int(bates_param)
        share = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, i: s + uniform(seed, F.col("stratum_id"), F.col("dim"), i)) / k
    value = (F.col("lo") + F.col("hi")) * 0.5 if math.isinf(bates_param) else F.col("lo") + (F.col("hi") - F.col("lo")) * share
    rows = placed.withColumn("x", value).groupBy(F.col("stratum_id").alias("point_id")).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("sorted"), F.bool_or("error").alias("error"))
    return rows.select("point_id", F.col("sorted.x").alias("coords"), "error")


def _matched(sides: DataFrame, ordered: DataFrame, n: DataFrame, seed: int, matching_init: str) -> DataFrame:
    """(stratum_id, dim, lo, hi, bin) by a perfect matching of strata and the bins they overlap, all dimensions at once."""
    if matching_init not in ("approx", *matching.STARTS):
        raise ValueError(f"unknown start of the matching {matching_init}")
    sized = sides.crossJoin(F.broadcast(n))  # one row
    first, last = F.floor(F.col("lo") * F.col("n") + 1e-9), F.ceil(F.col("hi") * F.col("n") - 1e-9) - 1
    edges = stored(sized.where(last >= first).select(F.col("dim").alias("group"), F.col("stratum_id").alias("left"), F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.col("n") - 1))).alias("right")), estimated=False)
    start: DataFrame | str = matching_init
    if matching_init == "approx":
        start = ordered.select(F.col("dim").alias("group"), F.col("stratum_id").alias("left"), F.col("bin").alias("right")).join(edges, ["group", "left", "right"], "left_semi")
    found = matching.bipartite_match(edges, start, seed)
    if found.size < sides.count():
        raise ValueError("no perfect matching of strata and bins")
    pairs = found.pairs.select(F.col("group").alias("dim"), F.col("left").alias("stratum_id"), F.col("right").alias("bin"))
    return sides.join(pairs, ["dim", "stratum_id"]).select("stratum_id", "dim", "lo", "hi", "bin")


def reconstruct_strata_from_points(points: DataFrame, dimension: int, seed: int, cuboid: tuple[list[float], list[float]] | None = None) -> DataFrame:
    """(stratum_id, lo, hi): a box around each point, from splits between points near the mean of the longest side.

    A level of splits is one round: means and bounds by box, the neighbours of the mean by box, new boxes.
    Sides on which all points of a box agree are not split; equal points cannot be told apart and are refused.
    """
    lower, upper = cuboid or unitcube(dimension)
    outside = F.exists(F.zip_with("coords", vector(lower), lambda x, l: x < l), lambda b: b) | F.exists(F.zip_with("coords", vector(upper), lambda x, h: x > h), lambda b: b)
    start = points.select("point_id", F.when(outside, F.raise_error(F.lit("a point lies outside the cuboid")).cast("array<double>")).otherwise(F.col("coords")).alias("coords"))
    live = stored(start.select("point_id", "coords", F.lit(1).cast("long").alias("box"), vector(lower).alias("lo"), vector(upper).alias("hi")))
    done = []
    while True:
        stats = live.groupBy("box").agg(F.count("*").alias("n"), F.first("lo").alias("blo"), F.first("hi").alias("bhi"), *[f(F.get("coords", j)).alias(f"{f.__name__}{j}") for j in range(dimension) for f in (F.min, F.max, F.avg)])
        extents = F.array(*[F.when(F.col(f"max{j}") > F.col(f"min{j}"), F.get("bhi", j) - F.get("blo", j)).otherwise(F.lit(0.0)) for j in range(dimension)])
        scored = F.transform(extents, lambda e, j: F.struct(e.alias("e"), uniform(seed, F.col("box"), j).alias("tie"), j.alias("j")))
        stats = stats.select("box", "n", F.array_max(scored)["j"].alias("dim"), F.array_max(extents).alias("extent"), F.array(*[F.col(f"avg{j}") for j in range(dimension)]).alias("means"), F.array(*[F.col(f"min{j}") for j in range(dimension)]).alias("mins"), F.array(*[F.col(f"max{j}") for j in range(dimension)]).alias("maxs"))
        mean, low, high = F.get("means", F.col("dim")), F.get("mins", F.col("dim")), F.get("maxs", F.col("dim"))
        # rounding may put the mean of near-equal numbers on a bound: the largest then parts them
        border = F.when((mean > low) & (mean <= high), mean).otherwise(high)
        joined = live.join(stats.select("box", "n", "dim", "extent", border.alias("border")), "box")
        alone = joined.where("n = 1").select(F.col("point_id").alias("stratum_id"), "lo", "hi")
        done.append(stored(alone))  # a level's boxes are written once
        rest = joined.where("n > 1")
        if not rest.limit(1).count():
            return reduce(DataFrame.unionAll, done)
        x = F.get("coords", F.col("dim"))
        rest = stored(rest.withColumn("x", F.when(F.col("extent") > 0, x).otherwise(F.raise_error(F.lit("equal points have no strata of their own")).cast("double"))).withColumn("left", F.col("x") < F.col("border")))
        cuts = rest.groupBy("box").agg(((F.max(F.when(F.col("left"), F.col("x"))) + F.min(F.when(~F.col("left"), F.col("x")))) * 0.5).alias("cut"))
        moved = rest.join(cuts, "box")
        put = lambda c, when: F.transform(c, lambda v, j: F.when((j == F.col("dim")) & when, F.col("cut")).otherwise(v))
        live = stored(moved.select("point_id", "coords", F.xxhash64("box", "left").alias("box"), put("lo", ~F.col("left")).alias("lo"), put("hi", F.col("left")).alias("hi")))
