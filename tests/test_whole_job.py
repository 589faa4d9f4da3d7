"""Queries that take the whole of their input, against brute force."""

import math
import re
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomwork.catalog import QUERIES
from loomwork.operators import cluster, graph, series, similarity
from loomwork.plans import graph as graph_plans

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{D}/documents.parquet")


def test_shingles_of_all_documents(spark, documents, monkeypatch):
    monkeypatch.setattr(similarity, "SIDE", 32)  # several blocks of a size class
    sets = {i: {t[j : j + 4] for j in range(len(t) - 3)} for i, t in zip(documents.doc_id, documents.text) if t and len(t) >= 4}
    sims = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in combinations(sorted(sets), 2)}
    want = {p: s for p, s in sims.items() if s >= 0.3}
    got = QUERIES["shingle_jaccard_documents"](spark, D).collect()
    assert len(got) == len(want) > 0
    assert {(r.a, r.b): r.sim for r in got} == pytest.approx(want, abs=1e-6)


def test_shingles_are_exact_for_many_characters():
    texts = ["a😀bcd", "😀bcda", "", "abc", "".join(map(chr, range(0x4E00, 0x9000))) * 2]
    row, gram = similarity.shingle_rows(texts, 4)
    want = {(i, t[j : j + 4]) for i, t in enumerate(texts) for j in range(len(t) - 3)}
    assert len(row) == len(want) and len(set(gram)) == len({g for _, g in want})


def test_words_of_all_documents_one_edit_apart(spark, documents):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {w for t in documents.text.dropna() for w in re.findall("[a-z]+", t.translate(lower))}
    near = lambda w: {w[:i] + c + w[j:] for i in range(len(w) + 1) for j in (i, i + 1) for c in ["", *"abcdefghijklmnopqrstuvwxyz"]}
    want = {(a, b) for a in words for b in near(a) & words if a < b}
    got = QUERIES["edit_distance_pairs_documents"](spark, D).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_spread_is_chosen_among_twenty(spark, monkeypatch):
    tried = []
    real = series.best_sigma
    monkeypatch.setattr(series, "best_sigma", lambda c, key, day, n, choices: tried.append((choices, c)) or real(c, key, day, n, choices))
    got = QUERIES["rt_estimate"](spark, "/root/testdata/sf0.01").toPandas()
    choices, counts = tried[0]
    assert choices == [i / 20 for i in range(1, 21)]
    loglik = {s: sum(r.l for r in series.rt_estimate(counts, "event_type", "day", "n", s).groupBy("event_type").agg(F.max_by("loglik", "day").alias("l")).collect()) for s in (0.05, 0.1, 0.25)}
    total = got.sort_values("day").groupby("event_type").loglik.last().sum()
    assert total >= max(loglik.values()) - 1e-6 and total > loglik[0.1] + 1e-6


def test_series_are_smoothed_and_start_at_a_cutoff(spark):
    counts = {"high": [2, 3, 4, 30, 60, 70, 80, 90, 90], "low": [1, 2, 3, 8, 16, 18, 17, 16, 17], "tiny": [1, 2, 1, 3, 2, 1, 2, 1, 2]}
    rows = [(k, f"2024-01-0{i + 1}", n) for k, v in counts.items() for i, n in enumerate(v)]
    got = series.prepared(spark.createDataFrame(rows, "k string, day string, n long"), "k", "day", "n").orderBy("day").collect()
    for k, v in counts.items():
        smooth = []
        for i in range(len(v)):
            weights = {j: math.exp(-((i - j) ** 2) / 8) for j in range(max(0, i - 3), min(len(v), i + 4))}
            smooth.append(round(sum(w * v[j] for j, w in weights.items()) / sum(weights.values())))
        start = next((i for c in (25, 10) for i in range(len(v)) if smooth[i] >= c), 0)
        assert [r.n for r in got if r.k == k] == smooth[start:]


def test_posterior_and_interval_of_every_day(spark):
    e = pd.read_parquet(f"{D}/events.parquet")
    counts = e.groupby(["event_type", e.ts.dt.strftime("%Y-%m-%d")]).size()
    r, want, intervals = np.arange(121) / 10, {}, {}
    for kind, series_ in counts.groupby(level=0):
        k, ll = series_.sort_index().to_numpy(), np.zeros(121)
        for t in range(1, len(k)):
            lam = k[t - 1] * np.exp((r - 1) / 7)
            ll = ll + k[t] * np.log(lam) - lam
            p = np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum()
            want[kind, t + 1] = p
            c = np.round(np.cumsum(p), 9)
            _, low, high = min((j - i, i, j) for i in range(121) for j in range(i + 1, 121) if c[j] - c[i] > 0.9)
            intervals[kind, t + 1] = (low / 10, high / 10)
    got = QUERIES["rt_posterior_simple"](spark, D).toPandas()
    assert len(got) == 121 * len(want) and {t for _, t in want} == set(range(2, 31))
    for key, g in got.groupby(["event_type", "day"]):
        assert g.sort_values("r").p.to_numpy() == pytest.approx(want[key], abs=1e-6)
    assert {(x.event_type, x.day): (x.low, x.high) for x in QUERIES["hdi"](spark, D).collect()} == intervals


def test_graphs_of_any_depth(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(14)] + [(0, 14), (20, 21)]
    edges = graph.undirected(spark.createDataFrame(chain, "src long, dst long"))
    monkeypatch.setattr(graph_plans, "_edges", lambda spark, d: edges.where("least(src, dst) <> 0 OR greatest(src, dst) <> 14"))
    assert {r.node: r.d for r in graph_plans.bfs_levels(spark, D).collect()} == {i: i for i in range(15)}
    assert {r.node: r.component for r in graph_plans.connected_components(spark, D).collect()} == {i: 0 for i in range(15)} | {20: 20, 21: 20}
    want, cost = {0: 0}, lambda a, b: 10 + (a + b) % 7
    for i in range(14):
        want[i + 1] = want[i] + cost(i, i + 1)
    assert {r.node: r.d for r in graph_plans.shortest_paths(spark, D).collect()} == want
    # A long cheap way beats one dear edge.
    dear = edges.withColumn("w", F.when((F.least("src", "dst") == 0) & (F.greatest("src", "dst") == 14), 100).otherwise(1))
    got = {r.node: r.d for r in graph.distances(dear, spark.createDataFrame([(0,)], "node long"), weight="w").collect()}
    assert got == {i: i for i in range(15)}


def test_first_round_retains_outliers(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = np.random.default_rng(8)
    centres = np.array([[0.0, 0.0], [60.0, 60.0]])
    points = [(i, (centres[i % 2] + rng.normal(0, 1, 2)).tolist()) for i in range(400)] + [(1000 + i, [-900.0 - 300 * i, 700.0 * (i % 2)]) for i in range(3)]
    # Outliers come first, so that some of them are seeds.
    points = [(i + 10 if i < 1000 else i - 1000, v) for i, v in points]
    bfr = cluster.Bfr(2)
    bfr.add(spark.createDataFrame(points, "id long, v array<double>"))
    got = {r.id: r.cluster for r in bfr.result().collect()}
    assert set(got) == {i for i, _ in points} and {got[i] for i in range(3)} == {-1}
    assert len({(i % 2, c) for i, c in got.items() if i >= 10 and c != -1}) == 2
    assert bfr.rounds[0][1] == 2 and bfr.rounds[0][2] + bfr.rounds[0][4] + bfr.rounds[0][5] == len(points)
