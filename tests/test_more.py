import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomwork.operators import graph, more


def test_toivonen(spark):
    rng = random.Random(2)
    baskets = [sorted(rng.sample(range(6), rng.randint(2, 5))) for _ in range(300)]
    sets = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "key int, items array<int>")
    got, certain = more.toivonen(sets, 0.3, 2)
    want = {c for c in combinations(range(6), 2) if sum(set(c) <= set(b) for b in baskets) >= 90}
    assert {tuple(r["items"]) for r in got.collect()} <= want
    if certain:
        assert {tuple(r["items"]) for r in got.collect()} == want


def test_hybrids(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0)], "user int, item int, pred double")
    b = spark.createDataFrame([(1, 1, 4.0), (1, 3, 5.0)], "user int, item int, pred double")
    assert {(r.item, r.pred) for r in more.weighted_hybrid(a, b).collect()} == {(1, 3.0), (2, 4.0), (3, 5.0)}
    assert {(r.item, r.pred) for r in more.switching_hybrid(a, b).collect()} == {(1, 2.0), (2, 4.0), (3, 5.0)}


def test_agglomerate():
    assert more.agglomerate([(1, [0.0]), (2, [1.0]), (3, [10.0]), (4, [10.5])], 2) == {1: 1, 2: 1, 3: 3, 4: 3}


def test_betweenness(spark):
    edges = graph.undirected(spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)], "src int, dst int"))
    roots = edges.select(F.col("src").alias("node")).distinct()
    got = {(r.a, r.b): r.credit for r in more.betweenness(edges, roots, 3).collect()}
    assert got[3, 4] == pytest.approx(9) and got[1, 2] == pytest.approx(1) and got[1, 3] == pytest.approx(4)


def test_small_problems():
    assert more.topological_order([(1, 2), (2, 3), (1, 3)]) == [1, 2, 3] and more.topological_order([(1, 2), (2, 1)]) is None
    assert more.stable_matching({"a": ["x", "y"], "b": ["x", "y"]}, {"x": ["b", "a"], "y": ["a", "b"]}) == {"x": "b", "y": "a"}
    assert more.intervals_kept([(0, 5), (1, 2), (2, 4), (3, 9)]) == [(1, 2), (2, 4)]
