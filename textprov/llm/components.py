"""Connected components of an edge table: union-find within tasks, stars between them.

Each round contracts the edges a task holds by union-find (path halving), which leaves one edge a node
to the smallest node it is joined with there, and then exchanges edges by large-star and small-star
steps, whose minima are pre-aggregated. Rounds grow with the logarithm of the longest chain; every
round is written out, so lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Edges that a task contracts at once.
CONTRACT = 1 << 21


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[max(x, y)] = min(x, y)
    up = np.array(parent, np.int64)
    while True:
        higher = up[up]
        if (higher == up).all():
            return nodes, nodes[up]
        up = higher


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x[c].to_numpy() for x in held]) for c in ("a", "b"))
        nodes, root = roots(a, b)
        more = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(root[more]), pa.array(nodes[more])], names=["a", "b"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= CONTRACT:
            yield out(held)
            held, n = [], 0
    if held:
        yield out(held)


def connected(edges: DataFrame) -> DataFrame:
    """cid and comp, the smallest node it is connected with, of every node of ``edges`` (a, b; long, not null)."""
    schema = "a long, b long"
    stars = shared.written(edges.select("a", "b").filter("a <> b").mapInArrow(_contract, schema), "stars")
    while True:
        # large-star: a node's larger neighbours are hung on its smallest one
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("low").alias("a"), "b").distinct()
        # small-star: so are its smaller neighbours and itself
        large = shared.written(large, "large")
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select("low", "a", "b")
        small = small.select("low", F.explode(F.array("a", "b")).alias("b")).filter("low <> b").select(F.col("low").alias("a"), "b")
        after = shared.written(small.distinct().mapInArrow(_contract, schema).distinct(), "stars")
        # done when every node has one edge and no centre is itself hung on another
        n, nodes = after.agg(F.count(F.lit(1)), F.countDistinct("b")).first()
        stars = after
        if n == nodes and after.join(after.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
    leaves = stars.select(F.col("b").alias("cid"), F.col("a").alias("comp"))
    centres = stars.select(F.col("a").alias("cid"), F.col("a").alias("comp")).distinct()
    return shared.written(leaves.unionByName(centres), "components")
