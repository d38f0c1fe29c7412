"""Generators as table functions of SQL, for lateral joins with given tables.

``register`` names them in a session:

- ``halton_points(first, n, dimension)``, ``sobol_points(first, n, dimension)``
- ``lattice_points(first, n, size, generator)``: rank-1 lattice of ``size`` points
- ``sukharev_points(first, n, side, dimension)``: centres of the cells of a grid
- ``conventional_strata(first, n, side, dimension)``: those cells as boxes

Each gives the rows of indices first to first + n - 1, with a column for each
coordinate (``x0``, ``x1``, ...; boxes have ``lo0``, ..., ``hi0``, ...).  The
columns follow from the arguments, so dimension and generator are constants;
all others may come from the table that the function is joined with.

A call is a row's work in one task, whatever its n.  ``generated`` joins a table
of sizes block by block, so that a group of a third of all rows is as many
pieces of work as it has blocks.

Defined cases: a null argument or n of zero or less gives no rows; a negative
first index, a side or size below one, a lattice of more than three billion points and a
dimension that a sequence lacks raise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from pointloom.plans.sequences import halton_kernel, sobol_kernel
from pointloom.schema import positive

#: Rows that one call makes where a table of sizes is joined.
BLOCK = 1 << 16
#: Rows that a call holds at once.
CHUNK = 1 << 13
#: The largest lattice: products of two numbers below its size fit a long.
LARGEST = math.isqrt((1 << 63) - 1)


def _constant(argument: AnalyzeArgument, name: str):
    if argument.value is None:
        raise ValueError(f"{name} must be a constant that is not null")
    return argument.value


def _shape(key: str, *columns: str) -> AnalyzeResult:
    schema = StructType().add(key, LongType())
    for c in columns:
        schema = schema.add(c, DoubleType())
    return AnalyzeResult(schema)


def _coordinates(dimension: int, *names: str) -> list[str]:
    positive(dimension=dimension)
    return [f"{name}{j}" for name in names for j in range(dimension)]


def _rows(first: int | None, n: int | None, kernel: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple]:
    if first is None or n is None:
        return
    if first < 0:
        raise ValueError("the first index must not be negative")
    for lo in range(first, first + n, CHUNK):
        index = np.arange(lo, min(lo + CHUNK, first + n))
        yield from zip(index.tolist(), *kernel(index).T.tolist())


def _cells(index: np.ndarray, side: int, dimension: int) -> np.ndarray:
    """Places of the cells of a grid along each axis; the last axis runs fastest."""
    positive(side=side)
    return np.stack([index // side ** (dimension - 1 - j) % side for j in range(dimension)], axis=1)


class HaltonPoints:
    @staticmethod
    def analyze(first: AnalyzeArgument, n: AnalyzeArgument, dimension: AnalyzeArgument) -> AnalyzeResult:
        return _shape("point_id", *_coordinates(_constant(dimension, "dimension"), "x"))

    def eval(self, first, n, dimension):
        yield from _rows(first, n, halton_kernel(dimension))


class SobolPoints:
    @staticmethod
    def analyze(first: AnalyzeArgument, n: AnalyzeArgument, dimension: AnalyzeArgument) -> AnalyzeResult:
        return _shape("point_id", *_coordinates(_constant(dimension, "dimension"), "x"))

    def eval(self, first, n, dimension):
        yield from _rows(first, n, sobol_kernel(dimension, (first or 0) + max(n or 0, 0)))


class LatticePoints:
    @staticmethod
    def analyze(first: AnalyzeArgument, n: AnalyzeArgument, size: AnalyzeArgument, generator: AnalyzeArgument) -> AnalyzeResult:
        return _shape("point_id", *_coordinates(len(_constant(generator, "generator")), "x"))

    def eval(self, first, n, size, generator):
        if size is None:
            return
        positive(size=size)
        if size > LARGEST:
            raise ValueError(f"the size must be {LARGEST} at most")
        steps = np.array([g % size for g in generator], np.int64)
        yield from _rows(first, n, lambda index: (index % size)[:, None] * steps % size / size)


class SukharevPoints:
    @staticmethod
    def analyze(first: AnalyzeArgument, n: AnalyzeArgument, side: AnalyzeArgument, dimension: AnalyzeArgument) -> AnalyzeResult:
        return _shape("point_id", *_coordinates(_constant(dimension, "dimension"), "x"))

    def eval(self, first, n, side, dimension):
        if side is not None:
            yield from _rows(first, n, lambda index: (_cells(index, side, dimension) + 0.5) / side)


class ConventionalStrata:
    @staticmethod
    def analyze(first: AnalyzeArgument, n: AnalyzeArgument, side: AnalyzeArgument, dimension: AnalyzeArgument) -> AnalyzeResult:
        return _shape("stratum_id", *_coordinates(_constant(dimension, "dimension"), "lo", "hi"))

    def eval(self, first, n, side, dimension):
        if side is not None:
            yield from _rows(first, n, lambda index: np.hstack([(cells := _cells(index, side, dimension)) / side, (cells + 1) / side]))


FUNCTIONS = {
    "halton_points": HaltonPoints,
    "sobol_points": SobolPoints,
    "lattice_points": LatticePoints,
    "sukharev_points": SukharevPoints,
    "conventional_strata": ConventionalStrata,
}


def register(spark: SparkSession) -> None:
    """Name the table functions in the session's SQL."""
    for name, handler in FUNCTIONS.items():
        spark.udtf.register(name, F.udtf(handler, useArrow=True))


def generated(sizes: DataFrame, call: str, start: int = 0) -> DataFrame:
    """The columns of ``sizes`` with the rows of a table function, for ``n`` indices from ``start`` on of each row.

    ``call`` is the function in SQL over the columns of ``sizes``, with ``{first}``
    and ``{n}`` where those go: ``"sobol_points({first}, {n}, 3)"``.
    """
    register(sizes.sparkSession)
    blocks = F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1, F.lit(BLOCK).cast("long")))
    # the rows of sizes lie where an aggregate left them: few partitions, or one
    width = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = sizes.withColumn("_skip", F.explode(blocks)).repartition(width)
    called = call.format(first=f"_skip + {int(start)}", n=f"least({BLOCK}, n - _skip)")
    return sizes.sparkSession.sql(f"SELECT * FROM {{pieces}}, LATERAL {called}", pieces=pieces).drop("_skip")
