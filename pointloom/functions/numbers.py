"""Number helpers: bits, primes, binomials, a linear congruential step."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def high_bit(n: Column) -> Column:
    """1-based place of the highest 1 bit; 0 for n <= 0."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)


def low_zero_bit(n: Column) -> Column:
    """1-based place of the lowest 0 bit."""
    return F.bit_count(n.bitwiseXOR(n + 1))


#: Bases whose strong tests leave no composite below 2**32, and below 2**64.
_BASES, _ALL_BASES = (2, 7, 61), (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
#: Numbers without a factor up to here are tested by powers.
_SMALL_PRIMES = np.array([p for p in range(2, 212) if all(p % q for q in range(2, math.isqrt(p) + 1))])
#: The largest prime that a long holds.
LAST_PRIME = 2**63 - 25


def _strong(n: int) -> bool:
    """Whether an odd number below 2**64, larger than the bases, is prime, by Miller and Rabin."""
    s = ((n - 1) & (1 - n)).bit_length() - 1
    for base in _ALL_BASES:
        x = pow(base, (n - 1) >> s, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


def _strong_below_2_32(n: np.ndarray) -> np.ndarray:
    """The same of many odd numbers below 2**32, whose products fit 64 bits."""
    n = n.astype(np.uint64)
    odd = (n - np.uint64(1)) & ~(n - np.uint64(2))  # the power of two in n - 1
    ok = np.ones(len(n), bool)
    for base in _BASES:
        exponent, square, x = (n - np.uint64(1)) // odd, np.full(len(n), base, np.uint64) % n, np.ones(len(n), np.uint64)
        while exponent.any():
            x = np.where(exponent & np.uint64(1) == 1, x * square % n, x)
            square, exponent = square * square % n, exponent >> np.uint64(1)
        passed, turn = (x == 1) | (x == n - np.uint64(1)), odd >> np.uint64(1)
        while (turn > 1).any():
            x = np.where(turn > 1, x * x % n, x)
            passed |= (turn > 1) & (x == n - np.uint64(1))
            turn >>= np.uint64(1)
        ok &= passed
    return ok


def primes_among(n: np.ndarray) -> np.ndarray:
    """Which numbers of an array of longs are prime: small factors, then strong tests that have no exceptions."""
    out = np.isin(n, _SMALL_PRIMES)
    left = np.flatnonzero(n > _SMALL_PRIMES[-1])
    for p in _SMALL_PRIMES:
        left = left[n[left] % p != 0]
    short = n[left] < 2**32
    out[left[short]] = _strong_below_2_32(n[left[short]])
    out[left[~short]] = [_strong(v) for v in n[left[~short]].tolist()]
    return out


def is_prime(n: Column) -> Column:
    """Whether an integer is prime."""

    @F.pandas_udf("boolean")
    def tested(n: pd.Series) -> pd.Series:
        return pd.Series(primes_among(n.to_numpy(np.int64)))

    # null stays null
    return F.when(n < 2, False).when(n.isNotNull(), tested(F.coalesce(n.cast("long"), F.lit(0).cast("long"))))


def prime_from(n: Column) -> Column:
    """Smallest prime >= n, at least 2; numbers beyond the largest prime of a long are refused."""

    @F.pandas_udf("long")
    def sought(n: pd.Series) -> pd.Series:
        found = n.to_numpy(np.int64).copy()
        if (found > LAST_PRIME).any():
            raise ValueError("the next prime is no long")
        left = np.arange(len(found))
        while len(left := left[~primes_among(found[left])]):
            found[left] += np.where(found[left] > 2, 1 + found[left] % 2, 1)
        return pd.Series(found)

    return sought(F.greatest(F.ceil(n).cast("long"), F.lit(2).cast("long")))


def first_primes(k: int) -> list[int]:
    found: list[int] = []
    n = 2
    while len(found) < k:
        if all(n % p for p in found if p * p <= n):
            found.append(n)
        n += 1
    return found


def binomial(n: int, k: int) -> int:
    return math.comb(n, k) if 0 <= k <= n else 0


#: Park-Miller generator (fixed values): modulus, multiplier, and the scale its values are divided by.
MODULUS, MULTIPLIER, SCALE = 2147483647, 16807, 4.656612875e-10


def lcg_next(state: Column) -> Column:
    """Next state; 64-bit products need no factoring of the modulus."""
    return F.pmod(F.pmod(state, F.lit(MODULUS)) * MULTIPLIER, F.lit(MODULUS)).cast("long")


def lcg_scaled(state: Column, a: int, b: int) -> Column:
    """Integer between a and b that a state stands for."""
    low, high = min(a, b), max(a, b)
    r = state * SCALE
    value = F.bround((1 - r) * (low - 0.5) + r * (high + 0.5))
    return F.greatest(F.least(value.cast("long"), F.lit(high).cast("long")), F.lit(low).cast("long"))
