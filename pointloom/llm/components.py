"""Connected components of a graph of links, by joins that Spark distributes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.frames import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round takes the smallest label among neighbours and then the label's own label; the number of
    rounds follows the logarithm of a component's width where links are stars, as those of ``forest`` are.
    Labels are checkpointed between rounds, so that a lost executor costs one round and lineage stays short.
    """
    known = edges.where("a <> b")
    both = checkpointed(known.select("a", "b").union(known.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component"), F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        roots = step.select(F.col("node").alias("root"), F.col("component").alias("above"))
        low = F.least("component", "above")
        labels = checkpointed(step.join(roots, step["component"] == roots["root"]).select("node", low.alias("component"), (low != F.col("old")).alias("moved")))
    return labels.select("node", "component")


def roots(tree: DataFrame) -> DataFrame:
    """(node, component) for every node of ``tree`` (node, parent), which has one smaller parent for a node: its root.

    Each round takes the parent's parent, so rounds follow the logarithm of the depth.
    """
    labels = checkpointed(tree.select("node", F.col("parent").alias("component"), F.lit(True).alias("moved")))
    while labels.where("moved").limit(1).count():
        above = labels.select(F.col("node").alias("parent"), F.col("component").alias("higher"))
        step = labels.join(above, labels["component"] == above["parent"], "left")
        labels = checkpointed(step.select("node", F.coalesce("higher", "component").alias("component"), F.col("higher").isNotNull().alias("moved")))
    return labels.select("node", "component")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places reaches over the links (i, j)."""
    label = np.arange(n)
    while len(i):
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    return label
