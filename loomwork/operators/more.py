"""Operators that are only described, not coded, in the study material of this field: sampling checks of itemsets, hybrids, trees of clusters, edge betweenness, order and matching."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import kept
from .itemsets import apriori, counted, grouped, least_count, unfolded


def toivonen(sets: DataFrame, share: float, size: int, fraction: float = 0.3, slack: float = 0.8, seed: int = 1) -> tuple[DataFrame, bool]:
    """(itemsets (items, n) of this size frequent in all baskets (key, items), whether they are certain to be all).

    Candidates of every size up to this one are the sets frequent in a sample of the baskets at a lower share, and their negative border:
    sets that are not, though all their parts of one item less are. All are counted in all baskets; if one of the border is
    frequent, sets above it may be missing."""
    rows = kept(unfolded(sets), "rows")
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_000))
    every = grouped(rows)
    levels, tried = apriori(rows.where(draw < int(fraction * 1_000_000)), share * slack, None, size)
    tried[0] = every.select(F.explode("items").alias("item")).distinct().select(F.array("item").alias("items"))  # an item that the sample lacks is of the border too
    least = least_count(every, share)
    certain, last = True, None
    for low, n in zip(levels, counted(every, tried), strict=True):
        enough = n.crossJoin(F.broadcast(least)).where(F.col("n") >= F.col("least")).select("items", "n")
        certain = certain and enough.join(low.select("items"), "items", "left_anti").isEmpty()
        last = enough.join(low.select("items"), "items", "left_semi")
    return last if len(levels) >= size else last.limit(0), certain


def toivonen_exact(sets: DataFrame, share: float, size: int, fraction: float = 0.3, slack: float = 0.8) -> DataFrame:
    """Itemsets of this size, certain to be all: where a sample leaves doubt, another one is drawn at a lower share, at last all baskets."""
    sets = kept(sets, "sets")
    for turn in range(1, 5):
        got, certain = toivonen(sets, share, size, fraction, slack, turn)
        if certain:
            return got
        slack *= 0.8
    return toivonen(sets, share, size, 1.0, 1.0)[0]


def weighted_hybrid(one: DataFrame, two: DataFrame, weight: float = 0.5) -> DataFrame:
    """(user, item, pred) from two predictors; where one is silent the other counts alone."""
    j = one.withColumnRenamed("pred", "p").join(two.withColumnRenamed("pred", "q"), ["user", "item"], "full")
    return j.select("user", "item", F.coalesce(weight * F.col("p") + (1 - weight) * F.col("q"), "p", "q").alias("pred"))


def switching_hybrid(one: DataFrame, two: DataFrame) -> DataFrame:
    """The first predictor where it speaks, else the second."""
    return weighted_hybrid(one, two, 1.0)


def agglomerate(points: list[tuple[int, list[float]]], k: int) -> dict[int, int]:
    """Hierarchical clustering by centroids of few points: id -> least id of its cluster."""
    groups = {i: ([i], list(v)) for i, v in points}
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    heap = [(gap(groups[a][1], groups[b][1]), a, b, 1, 1) for a in groups for b in groups if a < b]
    heapq.heapify(heap)
    while len(groups) > k and heap:
        _, a, b, na, nb = heapq.heappop(heap)
        if a not in groups or b not in groups or len(groups[a][0]) != na or len(groups[b][0]) != nb:
            continue
        (ia, va), (ib, vb) = groups.pop(a), groups.pop(b)
        ids, n = ia + ib, len(ia) + len(ib)
        groups[min(a, b)] = (ids, [(x * len(ia) + y * len(ib)) / n for x, y in zip(va, vb, strict=True)])
        new = min(a, b)
        for c in groups:
            if c != new:
                p, q = min(c, new), max(c, new)
                heapq.heappush(heap, (gap(groups[p][1], groups[q][1]), p, q, len(groups[p][0]), len(groups[q][0])))
    return {i: min(ids) for ids, _ in groups.values() for i in ids}


def representatives(points: DataFrame, by: str, shrink: float = 0.2) -> DataFrame:
    """(by, id, v): each cluster's points moved by a share towards their mean, as scattered representatives are."""
    from .cluster import summaries

    mean = summaries(points, by)
    return points.join(mean, by).select(by, "id", F.zip_with("v", "mean", lambda x, m: x + shrink * (m - x)).alias("v"))


def betweenness(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(a, b, credit), a < b: Girvan-Newman credit of each edge, half the sum over the roots (node). Counts of shortest paths flow down level by level, credit flows up."""
    level = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths"))
    seen = level
    for d in range(1, depth + 1):
        step = level.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("to")), "node").groupBy("root", F.col("to").alias("node")).agg(F.sum("paths").alias("paths"))
        level = step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(d).alias("d"), "paths")
        seen = seen.unionByName(level)
    down = seen.withColumnRenamed("node", "src").join(edges, "src").join(seen.select("root", F.col("node").alias("dst"), (F.col("d") - 1).alias("d"), F.col("paths").alias("below")), ["root", "dst", "d"])
    tree = down.select("root", "src", "dst", "d", (F.col("paths") / F.col("below")).alias("share"))
    credit, flows = seen.select("root", "node", F.lit(1.0).alias("c")), None
    for d in reversed(range(depth)):
        flow = tree.where(F.col("d") == d).join(credit.select("root", F.col("node").alias("dst"), "c"), ["root", "dst"]).select("root", "src", "dst", (F.col("c") * F.col("share")).alias("f"))
        flows = flow if flows is None else flows.unionByName(flow)
        up = flow.groupBy("root", F.col("src").alias("node")).agg(F.sum("f").alias("g"))
        credit = credit.join(up, ["root", "node"], "left").select("root", "node", (F.col("c") + F.coalesce("g", F.lit(0.0))).alias("c"))
    return flows.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg((F.sum("f") / 2).alias("credit"))


def topological_order(edges: list[tuple]) -> list | None:
    """Least order of the nodes of a small graph, or None if it has a cycle."""
    into: dict = {}
    for a, b in edges:
        into.setdefault(a, 0)
        into[b] = into.get(b, 0) + 1
    ready, out = [n for n, k in into.items() if not k], []
    heapq.heapify(ready)
    while ready:
        out.append(n := heapq.heappop(ready))
        for a, b in edges:
            if a == n:
                into[b] -= 1
                if not into[b]:
                    heapq.heappush(ready, b)
    return out if len(out) == len(into) else None


def stable_matching(wishes: dict, ranks: dict) -> dict:
    """Proposers by their wishes; ranks: each receiver's list. Receiver -> proposer."""
    place = {r: {p: i for i, p in enumerate(l)} for r, l in ranks.items()}
    free, at, held = sorted(wishes, reverse=True), dict.fromkeys(wishes, 0), {}
    while free:
        p = free.pop()
        if at[p] == len(wishes[p]):
            continue
        r = wishes[p][at[p]]
        at[p] += 1
        q = held.get(r)
        if q is None or place[r][p] < place[r][q]:
            held[r] = p
            free += [q] if q is not None else []
        else:
            free.append(p)
    return held


def intervals_kept(rows: list[tuple]) -> list[tuple]:
    """Most intervals (begin, end, ...) that do not overlap, by earliest end."""
    out: list[tuple] = []
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if not out or r[0] >= out[-1][1]:
            out.append(r)
    return out
