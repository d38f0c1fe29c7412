"""Row-generating plans: low-discrepancy sequences and lattices, each row by itself."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.numbers import MODULUS, first_primes, lcg_next, lcg_scaled
from pointloom.functions.rng import uniform
from pointloom.schema import positive

BITS = 30
#: Primitive polynomials of the 40 dimensions, as bit patterns.
POLYNOMIALS = (
    1, 3, 7, 11, 13, 19, 25, 37, 59, 47,
    61, 55, 41, 67, 97, 91, 109, 103, 115, 131,
    193, 137, 145, 143, 241, 157, 185, 167, 229, 171,
    213, 191, 253, 203, 211, 239, 247, 285, 369, 299,
)
#: First direction numbers; entry k is (first dimension that has a k-th, values from there to dimension 40).
DIRECTIONS = (
    (1, (1,) * 40),
    (3, (1, 3, 1, 3, 1, 3, 3, 1, 3, 1, 3, 1, 3, 1, 1, 3, 1, 3, 1, 3, 1, 3, 3, 1, 3, 1, 3, 1, 3, 1, 1, 3, 1, 3, 1, 3, 1, 3)),
    (4, (7, 5, 1, 3, 3, 7, 5, 5, 7, 7, 1, 3, 3, 7, 5, 1, 1, 5, 3, 3, 1, 7, 5, 1, 3, 3, 7, 5, 1, 1, 5, 7, 7, 5, 1, 3, 3)),
    (6, (1, 7, 9, 13, 11, 1, 3, 7, 9, 5, 13, 13, 11, 3, 15, 5, 3, 15, 7, 9, 13, 9, 1, 11, 7, 5, 15, 1, 15, 11, 5, 3, 1, 7, 9)),
    (8, (9, 3, 27, 15, 29, 21, 23, 19, 11, 25, 7, 13, 17, 1, 25, 29, 3, 31, 11, 5, 23, 27, 19, 21, 5, 1, 17, 13, 7, 15, 9, 31, 9)),
    (14, (37, 33, 7, 5, 11, 39, 63, 27, 17, 15, 23, 29, 3, 21, 13, 31, 25, 9, 49, 33, 19, 29, 11, 19, 27, 15, 25)),
    (20, (13, 33, 115, 41, 79, 17, 29, 119, 75, 73, 105, 7, 59, 65, 21, 3, 113, 61, 89, 45, 107)),
    (38, (7, 23, 39)),
)


def direction_numbers(dimension: int) -> list[int]:
    """The 30 direction numbers of a dimension (from 1), as integers over 2**30: the recurrence of its polynomial."""
    if dimension == 1:
        return [1 << (BITS - 1 - k) for k in range(BITS)]
    polynomial = POLYNOMIALS[dimension - 1]
    degree = polynomial.bit_length() - 1
    numbers = [values[dimension - first] for first, values in DIRECTIONS[:degree] if dimension >= first]
    while len(numbers) < BITS:
        new = numbers[-degree] ^ (numbers[-degree] << degree)
        for k in range(1, degree):
            if polynomial >> (degree - k) & 1:
                new ^= numbers[-k] << k
        numbers.append(new)
    return [v << (BITS - 1 - k) for k, v in enumerate(numbers)]


def _indices(spark: SparkSession, n: int, skip: int) -> DataFrame:
    if n < 0 or skip < 0:
        raise ValueError("number and index of points must not be negative")
    return spark.range(skip, skip + n).withColumnRenamed("id", "point_id")


def _points(spark: SparkSession, n: int, skip: int, dimension: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(point_id, coords) of n indices from ``skip`` on; ``kernel`` gives rows of coordinates of an array of indices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = kernel(batch["point_id"].to_numpy())
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dimension)
            yield pa.RecordBatch.from_arrays([batch["point_id"], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["point_id", "coords"])

    return _indices(spark, n, skip).mapInArrow(run, "point_id long, coords array<double>")


def sobol_kernel(dimension: int, end: int) -> Callable[[np.ndarray], np.ndarray]:
    """Rows of Sobol coordinates of indices below ``end``."""
    if not 1 <= dimension <= len(POLYNOMIALS):
        raise ValueError(f"the dimension must be 1 to {len(POLYNOMIALS)}")
    if end > (1 << BITS) - 1:
        raise ValueError("indices must stay below 2**30 - 1")
    numbers = np.array([direction_numbers(d) for d in range(1, dimension + 1)], np.int64)

    def kernel(index: np.ndarray) -> np.ndarray:
        gray, x = index ^ (index >> 1), np.zeros((len(index), dimension), np.int64)
        for k in range(end.bit_length()):
            x ^= -((gray >> k) & 1)[:, None] & numbers[:, k]
        return x / float(1 << BITS)

    return kernel


def sobol(spark: SparkSession, dimension: int, n: int, skip: int = 1) -> DataFrame:
    """n Sobol points from index ``skip`` on: direction numbers of the set bits of the Gray code of an index, combined."""
    return _points(spark, n, skip, dimension, sobol_kernel(dimension, skip + n))


def sobol_normal(spark: SparkSession, dimension: int, n: int, skip: int = 1) -> DataFrame:
    """Sobol points through the inverse of the normal distribution; 0 gives minus infinity."""

    @F.pandas_udf("array<double>")
    def inverse(coords: pd.Series) -> pd.Series:
        normal = NormalDist()
        return coords.map(lambda c: [normal.inv_cdf(x) if x > 0 else float("-inf") for x in c])

    return sobol(spark, dimension, n, skip).withColumn("coords", inverse("coords"))


def normal_shares(points: DataFrame) -> DataFrame:
    """The way back from ``sobol_normal``: shares of the normal distribution below each coordinate."""

    @F.pandas_udf("array<double>")
    def share(coords: pd.Series) -> pd.Series:
        normal = NormalDist()
        return coords.map(lambda c: [normal.cdf(x) for x in c])

    return points.withColumn("coords", share("coords"))


def radical_inverse(index: np.ndarray, base: int) -> np.ndarray:
    """Digits of the indices mirrored at the point, added from the first digit on."""
    out, share = np.zeros(len(index)), 1.0
    while index.any():
        share /= base
        index, digit = np.divmod(index, base)
        out += share * digit
    return out


def halton_kernel(dimension: int) -> Callable[[np.ndarray], np.ndarray]:
    """Rows of Halton coordinates of indices."""
    positive(dimension=dimension)
    bases = first_primes(dimension)
    return lambda index: np.stack([radical_inverse(index, p) for p in bases], axis=1)


def halton(spark: SparkSession, n: int, dimension: int, skip: int = 0) -> DataFrame:
    """n Halton points from index ``skip`` on, in the bases of the first primes."""
    return _points(spark, n, skip, dimension, halton_kernel(dimension))


def rank1_lattice(spark: SparkSession, n: int, generator: list[int]) -> DataFrame:
    """Design of a lattice: row i holds i times the generator, modulo n."""
    positive(n=n)
    if not generator:
        raise ValueError("the generator needs a component")
    if max(abs(g) for g in generator) * n >= 1 << 62:
        generator = [g % n for g in generator]
    return spark.range(n).select(F.col("id").alias("point_id"), F.array(*[F.pmod(F.col("id") * F.lit(g).cast("long"), F.lit(n).cast("long")).cast("int") for g in generator]).alias("bins"))


def random_generator(n: int, dimension: int, seed: int) -> list[int]:
    """Components of [2, n) by a seed."""
    import random

    if n < 3:
        raise ValueError("a random generator needs n of at least 3")
    source = random.Random(seed)
    return [source.randrange(2, n) for _ in range(dimension)]


def korobov(spark: SparkSession, n: int, dimension: int, a: int | None = None, seed: int = 0) -> DataFrame:
    """Lattice whose generator is the powers of one number modulo n; a Latin hypercube if n and the number are coprime."""
    positive(n=n, dimension=dimension)
    a = random_generator(n, 1, seed)[0] if a is None else a % n
    if a <= 1:
        raise ValueError("the parameter must exceed 1 modulo n")
    return rank1_lattice(spark, n, [pow(a, j, n) for j in range(dimension)])


def lcg(spark: SparkSession, a: int, b: int, seed: int, n: int) -> DataFrame:
    """(pos, value, state): n values between a and b of the Park-Miller generator; a jump gives each row its own state."""
    if seed % MODULUS == 0:
        raise ValueError("the seed must not be a multiple of the modulus")
    # state after i steps: 16807**i * seed, by squares of the multiplier for the bits of i
    squares, m = [], 16807
    for _ in range(40):
        squares.append(m)
        m = m * m % MODULUS
    powers = F.array(*[F.lit(s).cast("long") for s in squares])
    start = F.lit(seed % MODULUS).cast("long")
    before = F.aggregate(F.sequence(F.lit(0), F.lit(39)), start, lambda s, k: F.when(F.call_function("getbit", F.col("id"), k) == 1, F.pmod(s * F.get(powers, k), F.lit(MODULUS)).cast("long")).otherwise(s))
    return spark.range(n).select(F.col("id").alias("pos"), lcg_next(before).alias("state")).select("pos", lcg_scaled(F.col("state"), a, b).alias("value"), "state")


def random_uniform(spark: SparkSession, n: int, dimension: int, seed: int) -> DataFrame:
    """Independent uniform points; the same for any partitioning."""
    positive(dimension=dimension)
    return _indices(spark, n, 0).select("point_id", F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda j: uniform(seed, F.col("point_id"), j)).alias("coords"))
