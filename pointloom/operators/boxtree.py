"""A binary tree of boxes on the driver, down which tasks send their points, and small summaries of its leaves.

A summary of a task is one row, and treeAggregate merges the rows of tasks on the
executors, so that a round over all points is one job and the driver gets one row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of one pass down the tree.
BLOCK = 16_384


@dataclass
class BoxTree:
    """Node j parts its box at middle[j] in dimension side[j]; leaves have left[j] = -1. Node 0 is the root."""

    side: list[int] = field(default_factory=lambda: [0])
    middle: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])

    def __len__(self) -> int:
        return len(self.left)

    def split(self, node: int, side: int, middle: float) -> tuple[int, int]:
        """Part a leaf: points at the middle or beyond go right."""
        self.side[node], self.middle[node] = side, middle
        self.left[node], self.right[node] = len(self), len(self) + 1
        for _ in range(2):
            self.side.append(0)
            self.middle.append(0.0)
            self.left.append(-1)
            self.right.append(-1)
        return self.left[node], self.right[node]

    def leaves_of(self, x: np.ndarray, stop: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row of x, or the first node on its way for which ``stop`` holds."""
        side, middle, left, right = (np.array(a) for a in (self.side, self.middle, self.left, self.right))
        if stop is not None:
            left = np.where(stop, -1, left)
        node = np.zeros(len(x), np.int64)
        live = np.flatnonzero(left[node] >= 0)
        while len(live):
            at = node[live]
            node[live] = np.where(x[live, side[at]] >= middle[at], right[at], left[at])
            live = live[left[node[live]] >= 0]
        return node


def vectors(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch["coords"].flatten().to_numpy(zero_copy_only=False), float).reshape(len(batch), -1)


def gathered(points: DataFrame, of: Callable[[pa.RecordBatch], object], merge: Callable[[object, object], object], depth: int = 2) -> object | None:
    """``of`` batches of all points, merged in tasks and then between them; None without points."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                own = of(batch.slice(lo, BLOCK))
                total = own if total is None else merge(total, own)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([pickle.dumps(total)], pa.binary())})

    def merged(a: bytes | None, b: bytes | None) -> bytes | None:
        return a or b if a is None or b is None else pickle.dumps(merge(pickle.loads(a), pickle.loads(b)))

    found = points.mapInArrow(partial, "part binary").rdd.map(lambda r: bytes(r.part)).treeAggregate(None, merged, merged, depth)
    return pickle.loads(found) if found else None


@dataclass
class Boxes:
    """Number of points and bounds of some nodes, by ascending node."""

    node: np.ndarray
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @staticmethod
    def of(node: np.ndarray, x: np.ndarray) -> Boxes:
        order = np.argsort(node, kind="stable")
        names, first, n = np.unique(node[order], return_index=True, return_counts=True)
        if not len(names):
            return Boxes(names, n, x, x)
        return Boxes(names, n, np.minimum.reduceat(x[order], first, axis=0), np.maximum.reduceat(x[order], first, axis=0))

    def __add__(self, other: Boxes) -> Boxes:
        if not len(self.node) or not len(other.node):
            return self if len(self.node) else other
        node, n, lo, hi = (np.concatenate([getattr(self, c), getattr(other, c)]) for c in ("node", "n", "lo", "hi"))
        order = np.argsort(node, kind="stable")
        names, first = np.unique(node[order], return_index=True)
        return Boxes(names, np.add.reduceat(n[order], first), np.minimum.reduceat(lo[order], first, axis=0), np.maximum.reduceat(hi[order], first, axis=0))


def leaf_boxes(points: DataFrame, tree: BoxTree, wanted: set[int]) -> Boxes | None:
    """Boxes of those leaves among ``wanted`` that have points, in one job."""
    sought = np.zeros(len(tree), bool)
    sought[list(wanted)] = True

    def of(batch: pa.RecordBatch) -> Boxes:
        x = vectors(batch)
        node = tree.leaves_of(x)
        own = sought[node]
        return Boxes.of(node[own], x[own])

    return gathered(points, of, lambda a, b: a + b)
