"""Graphs as edge tables: page rank, levels, shortest paths, components. Undirected edges stand in both directions (src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written

#: Rounds after which an iteration is checkpointed, where the context has a folder for it.
EVERY = 5


def _cut(df: DataFrame, turn: int) -> DataFrame:
    return df.checkpoint() if turn % EVERY == 0 and df.sparkSession.sparkContext.getCheckpointDir() else df


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def laplacian(edges: DataFrame) -> DataFrame:
    """(i, j, v): degrees on the diagonal, -1 for each edge."""
    return degrees(edges).select(F.col("node").alias("i"), F.col("node").alias("j"), F.col("degree").alias("v")).unionByName(edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(-1).cast("long").alias("v")))


def modularity(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row (q) of a partition (node, grp)."""
    a, b = (groups.select(F.col("node").alias(n), F.col("grp").alias(g)) for n, g in (("src", "ga"), ("dst", "gb")))
    inside = edges.join(a, "src").join(b, "dst").groupBy("ga").agg(F.count_if(F.col("ga") == F.col("gb")).alias("e"))
    deg = degrees(edges).join(groups, "node").groupBy(F.col("grp").alias("ga")).agg(F.sum("degree").alias("k"))
    m = edges.agg(F.count(F.lit(1)).alias("m"))  # twice the number of edges
    return deg.join(inside, "ga", "left").crossJoin(F.broadcast(m)).agg(F.sum(F.coalesce("e", F.lit(0)) / F.col("m") - (F.col("k") / F.col("m")) * (F.col("k") / F.col("m"))).alias("q"))


def pagerank(edges: DataFrame, rounds: int = 10, alpha: float = 0.85) -> DataFrame:
    """(node, pr) after so many rounds from the uniform start; every node of an undirected graph has a neighbour. The shuffle by node of the edges is the
    same in every round."""
    edges = written(edges, "edges")
    deg = degrees(edges)
    n = deg.agg(F.count(F.lit(1)).alias("nodes"))
    out = edges.join(deg.withColumnRenamed("node", "src"), "src")
    rank = deg.crossJoin(F.broadcast(n)).select("node", (1 / F.col("nodes")).alias("pr"))
    for turn in range(1, rounds + 1):
        sent = out.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("pr") / F.col("degree")).alias("s"))
        rank = _cut(sent.crossJoin(F.broadcast(n)).select("node", ((1 - alpha) / F.col("nodes") + alpha * F.col("s")).alias("pr")), turn)
    return rank


def directed_pagerank(edges: DataFrame, rounds: int = 10, alpha: float = 0.85) -> DataFrame:
    """(node, pr) of distinct directed edges (src, dst) after so many rounds; what nodes without a way out hold is dealt to all evenly. Every round is
    written, as the next one reads it twice."""
    edges = written(edges.select("src", "dst"), "edges")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    deg = written(nodes.join(degrees(edges), "node", "left"), "degrees")
    n = deg.agg(F.count(F.lit(1)).alias("nodes"))
    rank = deg.crossJoin(F.broadcast(n)).select("node", "degree", (1 / F.col("nodes")).alias("pr"))
    for _ in range(rounds):
        sent = edges.join(rank.select(F.col("node").alias("src"), (F.col("pr") / F.col("degree")).alias("s")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("s").alias("s"))
        lost = rank.agg(F.coalesce(F.sum(F.when(F.col("degree").isNull(), F.col("pr"))), F.lit(0.0)).alias("lost"))
        every = deg.join(sent, "node", "left").crossJoin(F.broadcast(n)).crossJoin(F.broadcast(lost))
        last, rank = rank, written(every.select("node", "degree", ((1 - alpha) / F.col("nodes") + alpha * (F.coalesce("s", F.lit(0.0)) + F.col("lost") / F.col("nodes"))).alias("pr")), "rank")
        discard(last)
    discard(edges, deg)
    return rank.select("node", "pr")


def _fixed(edges: DataFrame, start: DataFrame, value: str, sent: Column) -> DataFrame:
    """start (node, value) after rounds until no value falls. Only nodes whose value fell send it in the next round. Edges and rounds are
    written, as they are read again."""
    edges = written(edges, "edges")
    known = fallen = start.select("node", value)
    last = None
    while True:
        heard = fallen.withColumnRenamed("node", "src").join(edges, "src").select(F.col("dst").alias("node"), sent.alias(value), F.lit(None).alias("__was"))
        rows = known.withColumn("__was", F.col(value)).unionByName(heard).groupBy("node").agg(F.min(value).alias(value), F.min("__was").alias("__was"))
        new = written(rows, "round")
        discard(last)
        last = new
        known, fallen = new.select("node", value), new.where(F.col("__was").isNull() | (F.col(value) < F.col("__was"))).select("node", value)
        if fallen.isEmpty():
            discard(edges)
            return known


def distances(edges: DataFrame, source: DataFrame, rounds: int | None = None, weight: str | None = None) -> DataFrame:
    """(node, d): least sum of weights (or number of edges) from the nodes of source (node), over at most so many edges or, without
    rounds, over any number. Weights are not negative."""
    known = source.select("node", F.lit(0).cast("long").alias("d"))
    step = F.col(weight) if weight else F.lit(1)
    if rounds is None:
        return _fixed(edges, known, "d", (F.col("d") + step).cast("long"))
    for turn in range(1, rounds + 1):
        reached = known.withColumnRenamed("node", "src").join(edges, "src").select(F.col("dst").alias("node"), (F.col("d") + step).cast("long").alias("d"))
        known = _cut(known.unionByName(reached).groupBy("node").agg(F.min("d").alias("d")), turn)
    return known


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component): the least node within so many edges or, without rounds, of all that are connected."""
    label = edges.select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node"))
    if rounds is None:
        return _fixed(edges, label, "component", F.col("component"))
    for turn in range(1, rounds + 1):
        heard = edges.join(label.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "component")
        label = _cut(label.unionByName(heard).groupBy("node").agg(F.min("component").alias("component")), turn)
    return label
