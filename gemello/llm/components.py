"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gemello.session import written


def connected_components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, component) for every node of edges (u, v): component is the least node that can be reached.

    Steps alternate until the edges form stars around the least nodes, in about log(n) rounds; each round is written to the shared
    folder. Nothing is gathered: a node with many neighbours is a minimum (combined in the map tasks) and a join, which adaptive
    execution splits.
    """
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_forest, "u long, v long"), name)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written before they are joined, so that the join can be split where a node has many neighbours
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large, name)
        small = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        linked = large.join(small, "u")
        e = written(linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct(), name)
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _forest(batches):
    """Per batch, the stars of its own components in place of its edges: fewer edges, the same connection."""
    for b in batches:
        u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        if len(u):
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            roots = union(len(nodes), at[: len(u)], at[len(u) :])
            keep = roots != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[roots[keep]])], ["u", "v"])


def union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for nodes 0..n-1 and edges (a, b)."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        if (lo == hi).all():
            break
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
