"""Connected components over written edge tables, by alternating large-star and small-star rounds.

Every round aggregates minima with map-side combine, writes them as a table and joins them back: both sides of the join then
come straight from a shuffle, so that Spark can split the rows of a node with very many neighbours (the least one of a large
component), and no node's neighbours are ever gathered in one place; edges leave the driver untouched. Rounds end when a fingerprint of the edge set stays the same, that is, when every
edge points from a node to its component's smallest node.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import cut, discard


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect the same nodes as the edges a-b do."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        label = new[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (v long, u long) in any direction, repeats and loops allowed -> (node, component) for every node that is not
    its component's smallest; a node without a row is its own component. Null ends are ignored."""
    now = cut(edges.where("v <> u").select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = cut(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")), "least")
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = cut(large.where("v <> u").distinct(), "large")
        discard(least)
        least = cut(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        small = large.join(least, "v").select(F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("v"), F.col("m").alias("u"))
        small = cut(small.distinct(), "edges")
        for done in (now, large, least):
            discard(done)
        now, before, state = small, state, _state(small)
        if state == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component"))
