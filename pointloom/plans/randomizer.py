"""The facade: ordered sequences of integers below a bound, by ten methods.

Each method gives (pos, value); a seed and the sizes decide the rows, however
they are partitioned.  Methods that would never end or fail late in careless
use are refused when they are called.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.functions.rng import letters, permuted
from pointloom.plans import designs, sequences
from pointloom.plans.ranks import ranked, stored
from pointloom.sources.entropy import randint


def in_order_of(rows: DataFrame, n: int, *keys: Column) -> DataFrame:
    """(pos, value): values of the first n rows in the order of the keys; no task orders more than a range of rows."""
    return ranked(rows, *keys).where(F.col("pos") < n).select("pos", "value")


@dataclass(frozen=True)
class Randomizer:
    spark: SparkSession
    max_value: int
    n: int
    seed: int = 0

    def __post_init__(self) -> None:
        if self.max_value < 1 or self.n < 0:
            raise ValueError("max_value must be positive and n must not be negative")

    def _distinct(self, seed: int) -> DataFrame:
        if self.n > self.max_value:
            raise ValueError("there are not so many distinct values")
        return self.spark.range(self.n).select(F.col("id").alias("pos"), permuted(F.col("id"), self.max_value, F.lit(seed).cast("long")).alias("value"))

    def uniform_mersenne(self) -> DataFrame:
        """n distinct values: the first images of a seeded bijection."""
        return self._distinct(self.seed)

    def uniform_crypto(self) -> DataFrame:
        """n distinct values; the system's entropy is the seed, so that each call differs."""
        return self._distinct(secrets.randbits(62))

    def _column(self, design: DataFrame, n: int) -> DataFrame:
        return design.where(F.col("point_id") < n).select(F.col("point_id").alias("pos"), F.get("bins", 0).cast("long").alias("value"))

    def latin_sudoku(self, dims: int = 2, sudoku_boxes: int = 1) -> DataFrame:
        """First column of a Latin hypercube with a point in each sub-box; with several boxes values may pass ``max_value``."""
        if self.max_value % sudoku_boxes:
            raise ValueError("max_value must be a multiple of sudoku_boxes")
        return self._column(designs.sudoku(self.spark, dims, sudoku_boxes, self.max_value // sudoku_boxes, self.seed), self.n)

    def latin_improved(self) -> DataFrame:
        return self._column(designs.improved_lhd(self.spark, self.max_value, 1, self.seed).drop("restart"), self.n)

    def latin_matrix(self) -> DataFrame:
        return self._column(designs.lhd(self.spark, self.max_value, 1, self.seed), self.n)

    def sobol(self) -> DataFrame:
        """Places of the first values in the order of a one-dimensional Sobol sequence."""
        points = sequences.sobol(self.spark, 1, self.max_value)
        return in_order_of(points.select((F.col("point_id") - 1).alias("value"), F.get("coords", 0).alias("key")), self.n, F.col("key"), F.col("value"))

    def halton(self) -> DataFrame:
        """The same for the base-2 Halton sequence from index 5 on."""
        points = sequences.halton(self.spark, self.max_value, 1, skip=5)
        return in_order_of(points.select((F.col("point_id") - 5).alias("value"), F.get("coords", 0).alias("key")), self.n, F.col("key"), F.col("value"))

    def korobov_matrix(self, g: int | None = None) -> DataFrame:
        """Second column of a Korobov lattice, with repeats where g and max_value have a common factor."""
        if self.max_value <= 2:
            raise ValueError("a lattice needs max_value of at least 3")
        lattice = sequences.korobov(self.spark, self.max_value, 2, g, self.seed).where(F.col("point_id") < self.n)
        return lattice.select(F.col("point_id").alias("pos"), F.get("bins", 1).cast("long").alias("value"))

    def ambience(self, integers: DataFrame, whole: bool = False) -> DataFrame:
        """Distinct values of [0, max_value], the end included, from integers (value) of a source, in seeded order.

        n of them, or up to max_value with ``whole``.
        """
        if self.n > self.max_value + 1:
            raise ValueError("there are not so many distinct values")
        known = stored(integers.select(F.col("value").cast("long").alias("value")).where(F.col("value").between(0, self.max_value)).distinct())
        return in_order_of(known, self.max_value if whole else self.n, F.xxhash64(F.lit(self.seed), F.col("value")), F.col("value"))

    def quantum(self, words: DataFrame) -> DataFrame:
        """n values with repeats from entropy words (pos, word), which are read once."""
        drawn = stored(randint(words, 0, self.max_value).select(F.col("pos").alias("place"), F.floor("value").cast("long").alias("value")))
        return in_order_of(drawn, self.n, F.col("place"))


def random_alpha(spark: SparkSession, n: int = 1, seed: int = 0, as_list: bool = False) -> DataFrame:
    """One row of n lower-case letters, as a string or as an array."""
    drawn = letters(seed, F.lit(0), n)
    return spark.range(1).select((drawn if as_list else F.array_join(drawn, "")).alias("letters"))
