"""Embedding whitening: exact sums give the mean, a second pass the covariance, one small eigenproblem the projection.

Entries become integers x = floor(64 * c) + 1000000, so that sums are exact.
Each distinct x vector counts once in the fit.  The first pass sums x and counts
vectors; the second subtracts the mean before it multiplies, and sums the outer
products of batches by matrix products; both are merged by treeAggregate, so
that the driver gets a few matrices of d * d however many tasks there are.
LAPACK's symmetric eigh gives the components, whose projection is broadcast.  A
third pass of the same kind takes the covariance of the whitened fit list.

Defined cases: a row whose vector is null, empty, or holds a null, a NaN or an
infinity goes out, as does one with an entry of 64 * c beyond 2^40 in size, whose sums
would not stay exact, and one whose length is not that of most vectors (of the
longer ones where two lengths are as frequent).  Rows that repeat a vector or an
id have a result each, and a null id stays null.  A direction without variance
(an eigenvalue within rounding of zero) has ``whitened`` null and no part in
``identity_error``, which is null where no direction has variance.  A
``deviation`` beyond a long is null.  An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.frames import checkpointed, map_batches

SCALE, SHIFT = 64, 1_000_000
#: Largest size of a scaled entry: sums of batches stay far inside 64 bits.
LARGEST = 1 << 40
COMPONENTS = 16
#: Rows of one matrix product.
BLOCK = 4096
LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """Mean sums / n of the fit list, unit eigenvectors as columns by falling eigenvalue, and what whitening leaves."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - mean, rounded once: the whole part of the mean goes out in integers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - rest

    def varied(self) -> np.ndarray:
        """Which components have variance, beyond the rounding of the eigenproblem."""
        return self.values > max(self.values.max(initial=0.0), 0.0) * self.dimension * np.finfo(float).eps * 8

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of rows; components without variance are NaN."""
        some = self.varied()
        return np.where(some, self.centred(x) @ self.vectors / np.sqrt(np.where(some, self.values, 1.0)), np.nan)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums)**2 for each row, exact; None beyond a long."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        gaps = x - whole
        most = (np.abs(gaps).max(axis=1, initial=0).astype(float) + 1) * self.n
        small = self.dimension * most**2 < 2.0**62
        out: list[int | None] = [None] * len(x)
        exact = ((gaps[small] * self.n - rest) ** 2).sum(1)
        for i, v in zip(np.flatnonzero(small).tolist(), exact.tolist()):
            out[i] = v
        for i in np.flatnonzero(~small).tolist():
            total = sum((g * self.n - r) ** 2 for g, r in zip(gaps[i].tolist(), rest.tolist()))
            out[i] = total if total <= LONG else None
        return out


def scaled(entries: Column) -> Column:
    """The vector x of longs, or null where the entries have none."""
    held = entries.cast("array<double>")
    good = F.forall(held, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * SCALE) <= LARGEST))
    return F.when(good, F.transform(held, lambda c: F.floor(c * SCALE) + SHIFT))


def scaled_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the rows that have an x of the common length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(F.col(vector_col)).alias("x")).where("x IS NOT NULL")
    common = rows.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (common["d"] if common else 0)).where(F.size("x") > 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def summed(fit: DataFrame, of: Callable[[np.ndarray], tuple], depth: int = 2) -> tuple | None:
    """The sums, part by part, of the arrays ``of`` gives for blocks of x; None without rows.

    A task sums its blocks and gives one row; treeAggregate merges the rows of tasks on the executors.
    """
    import pickle

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                own = of(matrix(batch["x"].slice(lo, BLOCK)))
                total = own if total is None else tuple(a + b for a, b in zip(total, own))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(total)], pa.binary())})

    def merged(a: bytes | None, b: bytes | None) -> bytes | None:
        if a is None or b is None:
            return a or b
        return pickle.dumps(tuple(x + y for x, y in zip(pickle.loads(a), pickle.loads(b))))

    found = fit.mapInArrow(partial, "part binary").rdd.map(lambda r: bytes(r.part)).treeAggregate(None, merged, merged, depth)
    return pickle.loads(found) if found else None


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the distinct vectors of ``rows`` (vec_id, x); None without rows."""
    distinct = checkpointed(rows.select("x").distinct())
    # whole numbers of any size: a block's sums are 64 bits, what is merged are Python's
    first = summed(distinct, lambda x: (len(x), x.sum(0).astype(object)))
    if first is None:
        return None
    n, sums = first[0], tuple(int(s) for s in first[1])
    d = len(sums)
    mean = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)

    def outer(x: np.ndarray) -> tuple[np.ndarray]:
        y = mean.centred(x)
        return (y.T @ y,)

    covariance = summed(distinct, outer)[0] / n
    values, vectors = np.linalg.eigh(covariance)
    most = min(components, d)
    model = Whitening(n, sums, vectors[:, ::-1][:, :most].copy(), np.maximum(values[::-1][:most], 0.0), float(np.trace(covariance)))

    def spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = model.whitened(x)[:, model.varied()]
        return w.sum(0), w.T @ w

    total, products = summed(distinct, spread)
    if len(total):
        # whitened rows are centred but for rounding, which the outer product of their mean takes out
        model.identity_error = float(np.abs(products / n - np.outer(total / n, total / n) - np.eye(len(total))).max())
    return model


def whiten(rows: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each of ``rows`` (vec_id, x) and component."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        model = shared.value
        k = len(model.values)
        explained = np.where(model.values > 0, model.values / (model.trace or 1.0), 0.0)
        for lo in range(0, len(batch), BLOCK):
            part = batch.slice(lo, BLOCK)
            x = matrix(part["x"])
            w = model.whitened(x).ravel()
            yield {
                "vec_id": part["vec_id"].take(pa.array(np.repeat(np.arange(len(x)), k))),
                "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                "n": np.full(len(w), model.n),
                "deviation": [v for v in model.deviations(x) for _ in range(k)],
                "whitened": pa.array(w, mask=np.isnan(w)),
                "explained": np.tile(explained, len(x)),
                "identity_error": pa.array([model.identity_error] * len(w), pa.float64()),
            }

    return map_batches(rows, run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whitened_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of all vectors, by a whitening fitted on the distinct ones."""
    rows = scaled_rows(vectors, id_col, vector_col)
    return whiten(rows, fit(rows, components))
