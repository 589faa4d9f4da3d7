"""Connected components of a graph that may be larger than any one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Links that the driver joins by itself (4 MB); more go through alternating stars.
FEW_LINKS = 1 << 18


def _joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in the links, and the least key reachable from each."""
    keys, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = np.arange(len(keys))
    u, v = place[: len(a)], place[len(a) :]
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))  # of roots only, each below a smaller one
        while (root[root] != root).any():
            root = root[root]
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    return keys, keys[root]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating stars. edges (a, b) have a > b. Each node's least neighbour takes its
    larger (large) or its smaller neighbours and itself over; both sums are partial before the shuffle."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    moved = joined.where("b > a" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) long. Returns (key, component), the least key reachable, for each key with a link to another.
    The driver joins a small graph, whose labels are then a broadcast side: a round of stars is some ten stages, however few the links."""
    links = links.where("a <> b")
    if links.count() <= FEW_LINKS:
        few = links.select("a", "b").toArrow()
        columns = _joined(*(few.column(c).to_numpy() for c in ("a", "b")))
        label = written(links.sparkSession.createDataFrame(pa.table(list(columns), ["key", "component"])), "components")
        small = F.broadcast(label)
        small._written_to = label._written_to
        return small
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    known = None
    while True:
        last, edges = edges, written(_star(_star(edges, True), False), "edges")
        discard(last)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == known:
            label = written(edges.select(F.col("a").alias("key"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("key"), F.col("b").alias("component")).distinct()), "components")
            discard(edges)
            return label
        known = state
