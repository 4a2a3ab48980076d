"""Connected components of a graph given as edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.sources.workspace import materialise


# Edges whose components one task finds.
TASK_EDGES = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of every node but the smallest, for the components of some edges."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    root = np.arange(len(nodes))
    while len(a):
        # The larger root of each edge hooks to the smaller one; then every node looks up its root.
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _forests(batches):
    u, v = [], []
    for batch in batches:
        u.append(batch.column("u").to_numpy(zero_copy_only=False))
        v.append(batch.column("v").to_numpy(zero_copy_only=False))
    if u:
        nodes, roots = forest(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["u", "v"])


def _star(pairs: DataFrame, both_ways: bool) -> DataFrame:
    """Hook the neighbours of every node `u` to the smallest of them (`u` included).

    `both_ways` hooks the larger neighbours (large star), else the node and its smaller ones (small star).
    """
    if both_ways:
        seen = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        seen = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = seen.join(least, "u")
    if both_ways:
        hooked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hooked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    return hooked.where("u <> v").distinct()


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node, component) for every node that occurs in `edges` (columns u, v); component is its smallest node.

    Tasks join the edges they hold, up to about `task_edges`, and leave one edge for each node below its root. While
    that takes several tasks, a large and a small star (Kiveris et al. 2014) go on with what is left; their number
    grows with the logarithm of the edges. Loops are no edges and repeated edges count once; without edges the result is
    empty. Each round is written to the shared folder, so a lost executor costs one round.
    """
    now = materialise(edges.select("u", "v").where("u <> v"), "edges")
    mark = None
    while True:
        left = now.count()
        parts = -(-left // task_edges)
        if parts <= 1:
            now = materialise(now.coalesce(1).mapInArrow(_forests, "u long, v long"), "edges")
            break
        now = materialise(now.repartition(parts, "u").mapInArrow(_forests, "u long, v long"), "edges")
        now = materialise(_star(_star(now, True), False), "edges")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
