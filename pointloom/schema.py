"""Shapes of the tables that operators take and give.

A point set is (point_id, coords); strata are (stratum_id, lo, hi); a design is
(point_id, bins); a sequence is (pos, value).  Row order never means anything:
ids and positions do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "point_id long, coords array<double>"
DESIGN = "point_id long, bins array<int>"
STRATA = "stratum_id long, lo array<double>, hi array<double>"


def points_from(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """A point set from scalar columns."""
    return df.select(F.col(id_col).cast("long").alias("point_id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("coords"))


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def unitcube(dimension: int) -> tuple[list[float], list[float]]:
    """Lower and upper corner of the unit cube."""
    if dimension < 1:
        raise ValueError("dimension must be positive")
    return [0.0] * dimension, [1.0] * dimension


def positive(**values: int) -> None:
    for name, value in values.items():
        if value < 1:
            raise ValueError(f"{name} must be positive, not {value}")
