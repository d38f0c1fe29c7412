"""Seeded random columns that depend on ids, not on partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column) -> Column:
    """A double of [0, 1) for each value of the keys."""
    return F.xxhash64(F.lit(seed).cast("long"), *keys).bitwiseAND((1 << 53) - 1) / float(1 << 53)


def permuted(place: Column, n: int, seed: Column, rounds: int = 4) -> Column:
    """Image of ``place`` under a seeded bijection of [0, n), without a shuffle.

    A Feistel network over a rectangle of just over n cells; a value that leaves
    [0, n) is sent through again until it comes back (cycle walking).  The
    rectangle has at most sqrt(n) cells too many, so that 64 walks end for every
    n in practice; a walk that has not ended raises.
    """
    if n < 1:
        raise ValueError("n must be positive")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def once(x: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(seed, i, s["r"], F.lit(0)), F.lit(a)), F.lit(a)).cast("long")
            right = F.pmod(s["r"] + F.pmod(F.xxhash64(seed, i, left, F.lit(1)), F.lit(b)), F.lit(b)).cast("long")
            return F.struct(left.alias("l"), right.alias("r"))

        start = F.struct(F.pmod(x, F.lit(a)).cast("long").alias("l"), F.floor(x / a).cast("long").alias("r"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn)
        return end["l"] + end["r"] * F.lit(a)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(64)), once(place.cast("long")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def letters(seed: int, key: Column, n: int) -> Column:
    """An array of n lower-case letters for each key."""
    if n < 0:
        raise ValueError("n must not be negative")
    if n == 0:
        return F.array().cast("array<string>")
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.pmod(F.xxhash64(F.lit(seed), key, i), F.lit(26)) + 1).cast("int"), F.lit(1)))
