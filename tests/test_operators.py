"""Operators against small inputs whose answers are worked by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.functions import text as fn
from loomwork.operators import cluster, geo, graph, itemsets, relational, search, series, similarity
from loomwork.operators import text as text_ops
from loomwork.plans.series import plain_text
from loomwork.sources import sinks, tables


def test_division_equals_double_negation(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(6), rng.randrange(4)) for _ in range(40)] + [(None, 1), (3, None)]
    r, s = spark.createDataFrame(rows, "k int, i int"), spark.createDataFrame([(0,), (1,), (1,), (3,)], "i int")
    have = {k: {i for a, i in rows if a == k} for k, _ in rows}
    assert {x.k for x in relational.division(r, s, "k", "i").collect()} == {k for k, v in have.items() if {0, 1, 3} <= v}
    assert {x.k for x in relational.division(r, s.limit(0), "k", "i").collect()} == set(have)


def test_constraints(spark):
    t = spark.createDataFrame([(1, "a", 5), (1, "b", 50), (2, None, 7)], "id int, c string, n int")
    assert [r.id for r in relational.check_unique(t, "id").collect()] == [1]
    assert [r.c for r in relational.check_foreign_key(t, "c", spark.createDataFrame([("a",)], "k string"), "k").collect()] == ["b"]
    assert [r.n for r in relational.check_range(t, "n", 1, 10).collect()] == [50]
    assert [r.c for r in relational.check_in(t, "c", ["a"]).collect()] == ["b"]


def test_baskets_and_rules(spark):
    rows = [(k, i) for k, b in enumerate(["ACD", "BCE", "ACE", "FE"]) for i in b]
    df = spark.createDataFrame(rows, "key int, item string")
    sets = itemsets.baskets(df, "key", "item")
    pairs = {("".join(r["items"]), r.n) for r in itemsets.frequent(sets, support=2, size=2).collect()}
    assert pairs == {("AC", 2), ("CE", 2)}
    assert itemsets.frequent(sets, support=2, size=3).count() == 0
    items = df.groupBy("item").agg(F.count("*").alias("n"))
    p = spark.createDataFrame([("A", "C", 2), ("C", "E", 2)], "a string, b string, n long")
    total = df.agg(F.count_distinct("key").alias("total"))
    got = {(r.a, r.b): (r.conf, r.interest) for r in itemsets.rules(p, items, total).collect()}
    assert got["A", "C"] == pytest.approx((1.0, 0.25))
    assert got["C", "E"] == pytest.approx((2 / 3, 2 / 3 - 3 / 4))


def test_itemsets_equal_brute_force(spark):
    from itertools import combinations

    rng = random.Random(3)
    baskets = [sorted(rng.sample(range(9), rng.randint(1, 7))) for _ in range(60)]
    sets = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "key int, items array<int>")
    for size in (1, 2, 3, 4):
        want = {c for c in combinations(range(9), size) if sum(set(c) <= set(b) for b in baskets) >= 12}
        assert {tuple(r["items"]) for r in itemsets.frequent(sets, support=12, size=size).collect()} == want


def test_pearson(spark):
    rows = [("a", i, v) for i, v in enumerate([4.0, 5.0, 5.0])] + [("b", i, v) for i, v in enumerate([2.0, 3.0, 5.0])] + [("c", i, 3.0) for i in range(3)]
    got = {(r.a, r.b): r.sim for r in similarity.pearson(spark.createDataFrame(rows, "k string, i int, v double"), "k", "i", "v").collect()}
    assert got["a", "b"] == pytest.approx(0.755929, abs=1e-6)
    assert got["a", "c"] == 0


def test_lsh_pairs_are_similar_pairs(spark):
    rng = random.Random(5)
    base = {k: set(rng.sample(range(200), 30)) for k in range(12)}
    base[12] = base[0] | {199}
    rows = spark.createDataFrame([(k, u) for k, s in base.items() for u in s], "k int, u int")
    bins = spark.createDataFrame([(199,)], "bins int")
    got = {(r.a, r.b) for r in similarity.lsh(similarity.minhash(rows, "k", "u", bins, 20), "k", 2).collect()}
    assert (0, 12) in got
    sims = {(r.a, r.b): r.sim for r in similarity.verified(spark.createDataFrame(list(got), "a int, b int"), rows, "k", "u").collect()}
    for (a, b), s in sims.items():
        assert s == pytest.approx(len(base[a] & base[b]) / len(base[a] | base[b]))


def test_tokenisers(spark):
    t = spark.createDataFrame([("Don't (stop), it's 5-fold; [ok]? élan",), ("",), (None,)], "t string")
    a = [r[0] for r in t.select(fn.words_a(F.col("t"))).collect()]
    assert a == [["don't", "stop", "it's", "5-fold", "ok", "élan"], [], None]
    assert t.select(fn.words_b(F.col("t"))).first()[0] == ["don", "t", "stop", "it", "s", "fold", "ok", "élan"]
    assert t.select(fn.words_az(F.col("t"))).first()[0] == ["don", "t", "stop", "it", "s", "fold", "ok", "lan"]
    assert t.select(fn.words_joined(F.col("t"))).first()[0] == ["dont", "stop", "its", "5fold", "ok", "élan"]
    assert t.select(fn.link_trimmed(F.lit("https://spot.com/"))).first()[0] == "ot.com"


def test_spelling(spark):
    words = spark.createDataFrame([("spelling", 5), ("spell", 9), ("spill", 9), ("word", 2)], "word string, n long")
    asked = spark.createDataFrame([("spelling",), ("spel",), ("speling",), ("psell",), ("wrdo",), ("zzzzzz",), ("wo",)], "word string")
    got = {r.word: r.fix for r in text_ops.spell(asked, words).collect()}
    assert got == {"spelling": "spelling", "spel": "spell", "speling": "spelling", "psell": "spell", "wrdo": "word", "zzzzzz": "zzzzzz", "wo": "word"}


def test_viterbi_equals_enumeration(spark):
    from itertools import product

    rng = np.random.default_rng(2)
    move = rng.random((4, 4))
    emission = rng.random((5, 3))
    best = max(product(range(3), repeat=5), key=lambda p: math.prod([move[3, p[0]], *(move[a, b] for a, b in zip(p, p[1:])), move[p[-1], 3], *(emission[i, t] for i, t in enumerate(p))]))
    rows = spark.createDataFrame([(1, i, e.tolist()) for i, e in enumerate(emission)], "k int, pos int, emission array<double>")
    assert tuple(r.tag for r in text_ops.viterbi(rows, "k", move, 3).orderBy("pos").collect()) == best


def test_kmeans_keeps_an_empty_cluster(spark):
    points = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 1.0]), (2, [9.0, 9.0])], "id int, v array<double>")
    seeds = spark.createDataFrame([(0, [0.0, 0.0]), (1, [9.0, 8.0]), (2, [-50.0, -50.0])], "cluster int, mean array<double>")
    got, centres = cluster.kmeans(points, seeds, 2)
    assert {r.id: r.cluster for r in got.collect()} == {0: 0, 1: 0, 2: 1}
    assert {r.cluster: r["mean"] for r in centres.collect()}[2] == [-50.0, -50.0]


def test_bfr_finds_blobs(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = np.random.default_rng(4)
    centres = np.array([[0, 0, 0], [20, 0, 0], [0, 20, 0]])
    x = [(i, (centres[i % 3] + rng.normal(0, 1, 3)).tolist()) for i in range(120)] + [(999, [500.0, 500.0, 500.0])]
    bfr = cluster.Bfr(3)
    for part in (x[:60], x[60:]):
        bfr.add(spark.createDataFrame(part, "id int, v array<double>"))
    got = {r.id: r.cluster for r in bfr.result().collect()}
    assert set(got) == {i for i, _ in x} and got[999] == -1
    assert len({(i % 3, c) for i, c in got.items() if i != 999 and c != -1}) == 3


def test_pagerank_sums_to_one(spark):
    edges = graph.undirected(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src int, dst int"))
    pr = {r.node: r.pr for r in graph.pagerank(edges, 30).collect()}
    assert sum(pr.values()) == pytest.approx(1) and max(pr, key=pr.get) == 3
    assert {r.node: r.d for r in graph.distances(edges, spark.createDataFrame([(1,)], "node int"), 3).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_hull(spark):
    rng = random.Random(6)
    points = [(i, rng.random(), rng.random()) for i in range(60)] + [(100, -1.0, -1.0), (101, 2.0, -1.0), (102, 2.0, 2.0), (103, -1.0, 2.0), (104, 0.5, -1.0)]
    assert {r.id for r in geo.hull(spark.createDataFrame(points, "id int, x double, y double")).collect()} == {100, 101, 102, 103}


def test_spirograph(spark):
    got = geo.spirograph(spark).collect()
    assert len(got) == 503 and (got[0].x, got[0].y) == pytest.approx((-118.284969, 34.020546))


def test_rt_follows_growth(spark):
    counts = spark.createDataFrame([("s", f"2024-01-0{i + 1}", n) for i, n in enumerate([20, 40, 55, 90])], "k string, day string, n long")
    got = series.rt_estimate(counts, "k", "day", "n").orderBy("day").collect()
    assert len(got) == 3 and all(r.low_90 <= r.ml <= r.high_90 and r.high_50 - r.low_50 <= r.high_90 - r.low_90 for r in got) and got[0].ml > 1


def test_grid_paths():
    assert search.Grid.parse("UCS\n5 3\n0 0\n5\n1\n4 1\n1 5 1 -1 -2\n6 2 4 10 3\n9 8 -10 -20 40").solve() == ["0,0 1,0 2,0 3,0 4,1"]
    assert search.Grid.parse("BFS\n2 2\n0 0\n5\n1\n1 1\n0 -10\n-10 -20").solve() == ["FAIL"]


def test_inference(spark):
    base = ["Parent(x,y) => Elder(x,y)", "Elder(x,y) & Elder(y,z) => Elder(x,z)", "Parent(Ann,Bob)", "Parent(Bob,Cy)"]
    for f in (search.ask, search.prove):
        assert f(base, "Elder(Ann,Cy)")
    assert not search.prove(base, "Parent(Cy,Ann)")
    text = "\n".join(["2", "Elder(Ann,Cy)", "Parent(Ann,Cy)", "3", "Parent(x,y) & Parent(y,z) => Elder(x,z)", "Parent(Ann,Bob)", "Parent(Bob,Cy)"])
    rows = search.solve_rows(spark.createDataFrame([(1, text)], "id int, text string"), search.answer).orderBy("line").collect()
    assert [r.result for r in rows] == ["TRUE", "FALSE"]


def test_html():
    assert plain_text("<p>a<script>var t='</p>';</script><b>b &amp; c</b><style>x{}</style></p>d") == "ab & cd"


def test_files(spark, tmp_path):
    (tmp_path / "r1.txt").write_text("1,0.5,2\n2,1,3\n")
    (tmp_path / "r2.txt").write_text("3,4,5\n")
    got = sorted((r.round, r.id, r.features) for r in tables.numeric_rounds(spark, str(tmp_path / "*.txt")).collect())
    assert got == [(1, "1", [0.5, 2.0]), (1, "2", [1.0, 3.0]), (2, "3", [4.0, 5.0])]
    sinks.write_scores(spark.createDataFrame([("a", 0.5)], "k string, v double"), str(tmp_path / "out"), "k", "v")
    assert tables.text_lines(spark, str(tmp_path / "out")).first().value == "a=0.5"
    (tmp_path / "d.tsv").write_text("7\thello\tyou\nbroken\n")
    assert [tuple(r) for r in tables.tsv_documents(spark, str(tmp_path / "d.tsv")).collect()] == [("7", "hello\tyou")]
    (tmp_path / "p.kml").write_text("<kml><Placemark><name>A</name><Point><coordinates>-118.2,34.0,0</coordinates></Point></Placemark></kml>")
    assert [tuple(r) for r in tables.kml_points(spark, str(tmp_path / "p.kml")).collect()] == [("A", -118.2, 34.0)]
