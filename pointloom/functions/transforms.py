"""Maps of points and designs: scaling, cells, shifts, the Latin hypercube test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.functions.rng import uniform
from pointloom.schema import vector

Cuboid = tuple[list[float], list[float]]


def scaled(points: DataFrame, source: Cuboid, target: Cuboid) -> DataFrame:
    """Linear map of one box onto another; a source side without extent is refused."""
    for lo, hi in zip(*source):
        if not hi > lo:
            raise ValueError("each side of the source box needs an extent")
    for lo, hi in zip(*target):
        if hi < lo:
            raise ValueError("the target box is upside down")
    lo, width = vector(source[0]), vector([h - l for l, h in zip(*source)])
    to, factor = vector(target[0]), vector([h - l for l, h in zip(*target)])
    unit = F.zip_with(F.zip_with("coords", lo, lambda x, l: x - l), width, lambda x, w: x / w)
    return points.withColumn("coords", F.zip_with(F.zip_with(unit, factor, lambda x, f: x * f), to, lambda x, t: x + t))


def _cells(design: DataFrame, num_points: int | None, cell: callable) -> DataFrame:
    n = F.lit(float(num_points)) if num_points is not None else F.col("_n")
    # the number of rows is one value: a broadcast of one row, unless it is known
    source = design if num_points is not None else design.crossJoin(F.broadcast(design.agg(F.count("*").cast("double").alias("_n"))))
    return source.select("point_id", F.transform("bins", lambda x, j: cell(x.cast("double"), n, j)).alias("coords"))


def perturbed(design: DataFrame, seed: int, num_points: int | None = None) -> DataFrame:
    """A random place in each point's cell."""
    return _cells(design, num_points, lambda x, n, j: (x + uniform(seed, F.col("point_id"), j)) / n)


def cell_centered(design: DataFrame, num_points: int | None = None) -> DataFrame:
    return _cells(design, num_points, lambda x, n, j: (x + 0.5) / n)


def spread_out(design: DataFrame, num_points: int | None = None) -> DataFrame:
    """Bins over the whole interval, ends included; one point only is refused."""
    return _cells(design, num_points, lambda x, n, j: x / F.when(n > 1, n - 1).otherwise(F.raise_error(F.lit("spread_out needs two points")).cast("double")))


def anchored(design: DataFrame, num_points: int | None = None) -> DataFrame:
    return _cells(design, num_points, lambda x, n, j: x / n)


def shifted(points: DataFrame, shift: list[float]) -> DataFrame:
    """All points moved by one vector, modulo 1."""
    return points.withColumn("coords", F.zip_with("coords", vector(shift), lambda x, s: F.pmod(x + s, F.lit(1.0))))


def shifted_randomly(points: DataFrame, seed: int, dimension: int) -> DataFrame:
    move = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda j: uniform(seed, j))
    return points.withColumn("coords", F.zip_with("coords", move, lambda x, s: F.pmod(x + s, F.lit(1.0))))


def has_lhd_property(design: DataFrame) -> DataFrame:
    """One row: whether every column of the design is a permutation of 0 .. n - 1; an empty design is not one."""
    n = design.agg(F.count("*").alias("n"))
    by_dim = design.select(F.posexplode("bins").alias("dim", "bin")).groupBy("dim").agg(F.count_distinct("bin").alias("values"), F.min("bin").alias("low"), F.max("bin").alias("high"))
    ok: Column = (F.col("values") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)
    return by_dim.crossJoin(F.broadcast(n)).agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("is_lhd"))
