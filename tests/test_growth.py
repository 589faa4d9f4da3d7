"""What is shuffled and read must not grow faster than the input: pairs, itemsets, counts of words."""

import random
from collections import Counter, defaultdict
from contextlib import contextmanager
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loomwork.catalog import QUERIES
from loomwork.operators import itemsets, similarity
from loomwork.operators import text as ops
from loomwork.plans import graph as graph_plans

D = "/root/testdata/sf0.001"


@contextmanager
def measured(spark):
    """Rows shuffled and rows read of the stages that run inside, once it is over."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(60000)
        got = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(got.apply(i).stageId(), got.apply(i).attemptId()): (got.apply(i).shuffleWriteRecords(), got.apply(i).inputRecords()) for i in range(got.size())}

    before, out = set(stages()), {}
    yield out
    new = [v for k, v in stages().items() if k not in before]
    out |= {"shuffled": sum(v[0] for v in new), "read": sum(v[1] for v in new)}


def brute(rows):
    held, got = defaultdict(dict), {}
    for k, i, v in rows:
        if k is not None and i is not None:
            held[i][k] = v
    for at in held.values():
        for a, b in combinations(sorted(at), 2):
            n, x, y = got.get((a, b), (0, 0, 0))
            got[a, b] = (n + 1, x + at[a], y + at[b])
    return got


ROWS = [(k, i, float(k * 7 + i)) for k, i in sorted({(random.Random(n).randrange(60), random.Random(-n).randrange(40)) for n in range(1, 900)})]


@pytest.mark.parametrize("pairs, long, ranges, far, kind", [(1 << 21, 2000, 1 << 16, 1, "long"), (500, 2000, 1 << 16, 1, "long"), (500, 7, 64, 1, "long"), (40, 7, 4, 1, "int"), (500, 7, 64, 1, "string"), (300, 2000, 64, 1 << 56, "long")])
def test_pairs_of_any_division(spark, monkeypatch, pairs, long, ranges, far, kind):
    monkeypatch.setattr(similarity, "PAIRS", pairs)
    monkeypatch.setattr(similarity, "LONG", long)
    monkeypatch.setattr(similarity, "RANGES", ranges)
    name = (lambda k: f"{k:03}") if kind == "string" else (lambda k: k * (far if k > 50 else 1) - 20)
    rows = [(name(k), i, v) for k, i, v in ROWS] + [(None, 1, 2.0), (name(1), None, 3.0)]
    aggregates = [F.count(F.lit(1)).alias("n"), F.sum("x_v").alias("x"), F.sum("y_v").alias("y")]
    got = similarity.paired(spark.createDataFrame(rows, f"k {kind}, i int, v double"), "k", "i", ["v"], aggregates).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b): (r.n, r.x, r.y) for r in got} == brute(rows)


def test_largest_keys_have_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PAIRS", 1)
    last = (1 << 56) - 1
    rows = [(k, i, 1.0) for i in range(1100) for k in (0, last - 1, last)]
    got = similarity.paired(spark.createDataFrame(rows, "k long, i int, v double"), "k", "i", [], [F.count(F.lit(1)).alias("n")]).collect()
    assert {(r.a, r.b): r.n for r in got} == {(0, last - 1): 1100, (0, last): 1100, (last - 1, last): 1100}


def test_pairs_of_nothing(spark):
    none = spark.createDataFrame([], "k long, i long")
    assert similarity.overlaps(none, "k", "i").collect() == [] and similarity.paired(none, "k", "i", [], []).collect() == []


def test_no_row_for_a_pair_is_shuffled(spark):
    rows = spark.range(6000).select((F.col("id") % 300).alias("k"), F.floor(F.col("id") / 300).alias("i"), (F.col("id") % 7).cast("double").alias("v"))
    with measured(spark) as seen:
        assert similarity.overlaps(rows, "k", "i").count() == similarity.pearson(rows, "k", "i", "v").count() == 300 * 299 / 2
    assert 0 < seen["shuffled"] < 8 * 6000


@pytest.mark.parametrize("name", ["similar_pairs_lsh", "cf_user_sim_lsh", "eval_precision_recall"])
def test_candidates_of_equal_signatures_are_not_made(spark, monkeypatch, name):
    monkeypatch.setattr(similarity, "lsh", lambda *_: pytest.fail("all pairs with an equal signature"))
    QUERIES[name](spark, D).collect()


def test_signatures_in_common(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.6), (2, 3, 0.7)], "a int, b int, sim double")
    signed = spark.createDataFrame([(1, [5, 6]), (2, [6, 5]), (3, [5, 5])], "k int, s array<int>")
    assert {(r.a, r.b, r.sim) for r in similarity.agreeing(pairs, signed, "k").collect()} == {(1, 3, 0.6), (2, 3, 0.7)}


def test_neighbours_by_the_shorter_way(spark):
    test = spark.createDataFrame([(u, 0) for u in range(50)], "user int, item int")
    rated = spark.createDataFrame([(u, b, float(b)) for u in range(50) for b in range(1, 40)], "user int, b int, stars double")
    few, many = (spark.createDataFrame([(0, b, 0.5) for b in range(1, n)], "a int, b int, sim double") for n in (2, 90))
    with measured(spark) as seen:
        assert similarity.rated_alike(test, rated, few, "user", "item").count() == 50
    assert seen["shuffled"] < 3000
    assert similarity.rated_alike(test, rated, many, "user", "item").count() == 50 * 39


def test_orders_of_suppliers_are_paired_once(spark):
    with measured(spark) as seen:
        edges = graph_plans._edges(spark, D).count()
    lines = spark.read.parquet(f"{D}/lineitem.parquet").count()
    assert edges and seen["shuffled"] < 4 * lines


def test_equal_baskets_are_one(spark, monkeypatch):
    written, sizes = itemsets.written, Counter()
    monkeypatch.setattr(itemsets, "written", lambda df, name: (out := written(df, name), sizes.update({name: out.count()}))[0])
    rows = spark.range(5000).select((F.col("id") / 5).cast("int").alias("key"), (F.col("id") % 5).cast("int").alias("item"))
    levels, tried = itemsets.apriori(rows, 0.5)
    assert [x.count() for x in levels] == [5, 10, 10, 5, 1, 0] and {r.n for x in levels for r in x.collect()} == {1000}
    assert sizes["held"] < 100


def test_rows_without_a_key_or_item(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (None, "a"), (None, "b"), (3, None), (4, None)], "key int, item string")
    levels, _ = itemsets.apriori(rows, 0.5)
    assert [{(tuple(r["items"]), r.n) for r in x.collect()} for x in levels] == [{(("a",), 3), (("b",), 3), ((None,), 2)}, {(("a", "b"), 2)}, set()]


@pytest.mark.parametrize("name", ["bigram_index", "inverted_index", "posting_segments"])
def test_no_row_for_a_word_is_shuffled(spark, monkeypatch, name):
    monkeypatch.setattr(ops, "CHARS", 4096)
    want = QUERIES[name](spark, D)
    want = sorted(map(tuple, want.collect()))
    docs = spark.read.parquet(f"{D}/documents.parquet").count()
    with measured(spark) as seen:
        got = sorted(map(tuple, QUERIES[name](spark, D).collect()))
    assert got == want and seen["shuffled"] <= docs + 100


def test_texts_are_read_once_for_transitions(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").count()
    with measured(spark) as seen:
        assert QUERIES["hmm_transition"](spark, D).count()
    assert seen["read"] <= docs + 100


def test_scores_are_summed_where_words_are(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h").alias("text"))
    queries = spark.createDataFrame([(q, w) for q in range(50) for w in "abcdefgh"], "item_id int, word string")
    with measured(spark) as seen:
        assert ops.search(queries, docs, F.split("text", " ")).count() == 500
    assert seen["shuffled"] < 200 * 8 * 4
