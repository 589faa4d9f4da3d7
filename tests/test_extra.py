"""Operators of loomwork.plans.extra and their neighbours, against plain Python."""

import hashlib
import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork import scratch
from loomwork.functions import text as fn
from loomwork.operators import cluster, crawl, geo, graph, itemsets, more, search, series, similarity
from loomwork.operators import text as text_ops
from loomwork.sources import sinks, tables

# A small set of tables of our own: staff, meetings, reports, tests.
SCRIPT = '''
-- staff
CREATE TABLE staff (id INT, name VARCHAR(40), floor INT);
INSERT INTO staff (id, name, floor) VALUES
( 1, 'Ada (lead)', 1 ), -- a comment, with ( 9, 'no', 9 )
( 2, "Bo ""B""", 02 ),
( 3, 'It''s, Cy', 2 ), (4, NULL, 3);
insert into meeting values (10, 1), (10, 2), (11, 1), (11, 3), (12, 1);
INSERT INTO report VALUES (1, 2, '2024-03-01', 7), (2, 3, '2024-03-02', 7), (3, 2, '2024-03-04', 5);
INSERT INTO test VALUES (1, 2, '2024-03-02', 'positive'), (2, 3, '2024-03-03', 'negative'), (3, 1, '2024-03-05', 'positive');
'''


@pytest.fixture(scope="module")
def office(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sql") / "office.sql"
    path.write_text(SCRIPT)
    schemas = {"staff": "id int, name string, floor int", "meeting": "meeting int, id int", "report": "row int, id int, day date, symptom int", "test": "row int, id int, day date, result string"}
    for name, schema in schemas.items():
        tables.insert_literals(spark, str(path), name, schema).createOrReplaceTempView(f"o_{name}")
    return spark


def test_literals_of_scripts(office):
    assert sorted(map(tuple, office.table("o_staff").collect())) == [(1, "Ada (lead)", 1), (2, 'Bo "B"', 2), (3, "It's, Cy", 2), (4, None, 3)]
    assert office.table("o_meeting").count() == 5 and office.table("o_report").where("day is null").count() == 0


def test_office_queries(office):
    """The most reported symptom, the floor of most positive staff, counts in a range of days, who has met all whom the positive have met."""
    assert office.sql("SELECT symptom FROM o_report GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1").first()[0] == 7
    assert office.sql("SELECT floor FROM o_staff JOIN o_test USING (id) WHERE result = 'positive' GROUP BY 1 ORDER BY count(DISTINCT id) DESC, floor LIMIT 1").first()[0] == 1
    assert office.sql("SELECT count(*) FROM o_test WHERE day BETWEEN '2024-03-02' AND '2024-03-04'").first()[0] == 2
    wanted = office.sql("SELECT DISTINCT meeting FROM o_meeting JOIN o_test USING (id) WHERE result = 'positive'")
    from loomwork.operators.relational import division

    assert [r.id for r in division(office.table("o_meeting"), wanted, "id", "meeting").collect()] == [1]


def test_levels_and_candidates(spark):
    rng = random.Random(11)
    baskets = [sorted(rng.sample("abcdefgh", rng.randint(1, 6))) for _ in range(80)] + [list("abcdefgh")]
    rows = spark.createDataFrame([(k, i) for k, b in enumerate(baskets) for i in b], "key int, item string")
    levels, tried = itemsets.apriori(rows, support=10)
    known = [{c for c in combinations("abcdefgh", n) if sum(set(c) <= set(b) for b in baskets) >= 10} for n in range(1, 9)]
    for n, (level, asked) in enumerate(zip(levels, tried, strict=True), 1):
        assert {tuple(r["items"]) for r in level.collect()} == known[n - 1]
        want = set(combinations("abcdefgh", n)) if n == 1 else {c for c in combinations("abcdefgh", n) if all(p in known[n - 2] for p in combinations(c, n - 1))}
        assert {tuple(r["items"]) for r in asked.collect()} == want
    assert not known[len(levels) - 1] and all(known[: len(levels) - 1])


def test_a_large_basket_is_not_unfolded(spark):
    """A basket of 3,000 items has 4.5 thousand million triples; only those of frequent pairs are looked at."""
    rows = [(0, i) for i in range(3000)] + [(k, i) for k in (1, 2) for i in (5, 6, 7, 8)]
    levels, _ = itemsets.apriori(spark.createDataFrame(rows, "key int, item int"), support=3)
    assert [x.count() for x in levels] == [4, 6, 4, 1, 0]


def test_negative_border(spark):
    """A sample that lacks half of the baskets cannot be certain, and says so; the exact form goes on."""
    baskets = [(k, ["a", "b"]) for k in range(60)] + [(k, ["c", "d"]) for k in range(60, 90)]
    sets = spark.createDataFrame(baskets, "key int, items array<string>")
    got, certain = more.toivonen(sets, 0.3, 2, fraction=0.0)
    assert not certain and got.count() == 0
    assert {tuple(r["items"]) for r in more.toivonen_exact(sets, 0.3, 2).collect()} == {("a", "b"), ("c", "d")}


def test_heavy_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(similarity, "HEAVY", 4)
    rows = [(k, i, float(k * i % 5)) for k in range(20) for i in range(6) if i == 0 or (k + i) % 3]
    df = spark.createDataFrame(rows, "k int, i int, v double")
    got = sorted((r.a, r.b, r.x_v, r.y_v) for r in similarity.common(df, "k", "i", "v").collect())
    assert got == sorted((a, b, x, y) for a, i, x in rows for b, j, y in rows if i == j and a < b)


def test_words(spark):
    words = {"cat", "cot", "cut", "dog", "dot", "do", "a", "b", "", "caat"}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {tuple(r) for r in text_ops.one_letter_apart(df).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1}
    near = {r.word: r.fix for r in text_ops.spell(spark.createDataFrame([("dgoo",), ("kitten",)], "word string"), spark.createDataFrame([("dog", 3), ("sitting", 9), ("kittttn", 1)], "word string, n long")).collect()}
    assert near == {"dgoo": "dog", "kitten": "kittttn"}
    t = spark.createDataFrame([("run/fast/VB",)], "t string")
    assert tuple(t.select(fn.word_tag(F.col("t")).alias("x")).select("x.*").first()) == ("run/fast", "VB")
    assert tuple(t.select(fn.hamming(F.lit("karolin"), F.lit("kathrin")), fn.hamming(F.lit("a"), F.lit("ab")), fn.bits_apart(F.lit(5), F.lit(6))).first()) == (3, None, 2)


def test_simhash(spark):
    counts = {1: {"one": 2, "two": 1}, 2: {"one": 1}}
    got = {r.k: r.fingerprint for r in text_ops.simhash(spark.createDataFrame([(k, w, n) for k, c in counts.items() for w, n in c.items()], "k int, word string, f long"), "k").collect()}
    bits = lambda w: int(hashlib.md5(w.encode()).hexdigest()[: fn.HEX], 16)
    for k, c in counts.items():
        assert got[k] == sum(1 << i for i in range(4 * fn.HEX) if sum(n if bits(w) >> i & 1 else -n for w, n in c.items()) > 0)


def test_index_in_segments(spark):
    counts = spark.createDataFrame([(1, "a", 2), (9, "a", 1), (10, "a", 5), (11, "b", 1)], "doc long, word string, f long")
    assert {tuple(r) for r in text_ops.posting_segments(counts, "doc", 10).collect()} == {("a", 0, "1:2 9:1"), ("a", 1, "10:5"), ("b", 1, "11:1")}


def test_crawl(spark):
    types = spark.createDataFrame([("Text/HTML; charset=utf-8",), ("image/png",), ("application/json",), (None,)], "c string")
    assert [tuple(r) for r in types.select(crawl.media_type(F.col("c")), crawl.kept_type(F.col("c"))).collect()] == [("text/html", True), ("image/png", True), ("application/json", False), (None, False)]
    fetches = spark.createDataFrame([("a", 200), ("b", 404), ("c", 404), ("d", 301), ("e", 799)], "url string, status int")
    got = {(r.section, r.metric): r.n for r in crawl.fetch_report(fetches, types.select(F.lit("u").alias("url"), F.col("c").alias("content_type")).where("c is not null")).collect()}
    assert got["fetch", "attempted"] == 5 and got["fetch", "succeeded"] == 1 and got["fetch", "failed"] == 4
    assert got["status", "404 Not Found"] == 2 and got["status", "301 Moved Permanently"] == 1 and got["status", "799"] == 1 and got["content", "text/html"] == 1


def test_directed_pagerank(spark):
    edges = [(1, 2), (1, 3), (2, 3), (3, 1), (4, 3), (3, 5)]
    m = np.zeros((5, 5))
    for a, b in edges:
        m[b - 1, a - 1] = 1 / sum(x == a for x, _ in edges)
    m[:, 4] = 1 / 5
    r = np.full(5, 1 / 5)
    for _ in range(8):
        r = 0.15 / 5 + 0.85 * m @ r
    got = {x.node: x.pr for x in graph.directed_pagerank(spark.createDataFrame(edges, "src int, dst int"), 8).collect()}
    assert [got[i] for i in range(1, 6)] == pytest.approx(r.tolist()) and sum(got.values()) == pytest.approx(1)


def test_a_path_of_thirty(spark):
    edges = graph.undirected(spark.createDataFrame([(i, i + 1) for i in range(29)], "src long, dst long"))
    assert {r.node: r.d for r in graph.distances(edges, spark.createDataFrame([(0,)], "node long")).collect()} == {i: i for i in range(30)}
    assert {r.component for r in graph.components(edges).collect()} == {0}


def test_kmeans_stops(spark, monkeypatch):
    passes = []
    real = cluster.vector_sums
    monkeypatch.setattr(cluster, "vector_sums", lambda *a, **k: passes.append(1) or real(*a, **k))
    points = spark.createDataFrame([(i, [float(i % 2 * 50 + i / 100), 1.0]) for i in range(40)], "id int, v array<double>")
    seeds = spark.createDataFrame([(0, [0.0, 0.0]), (1, [60.0, 0.0])], "cluster int, mean array<double>")
    got, centres = cluster.kmeans(points, seeds, 30)
    assert {r.id: r.cluster for r in got.collect()} == {i: i % 2 for i in range(40)} and len(passes) == 2
    assert {r.cluster: r["mean"][0] for r in centres.collect()} == pytest.approx({0: 0.19, 1: 50.2})


def test_weighted_correlation(spark):
    rng = random.Random(5)
    data = {(u, i): float(rng.randint(1, 5)) for u in range(6) for i in range(8) if rng.random() < 0.8}
    rows = spark.createDataFrame([(u, i, v) for (u, i), v in data.items()], "u int, i int, v double")
    weights = similarity.inverse_frequency(rows, "u", "i")
    w = {r.i: r.w for r in weights.collect()}
    assert w == pytest.approx({i: math.log(6 / sum(j == i for _, j in data)) for i in {i for _, i in data}})
    got = {(r.a, r.b): r.sim for r in similarity.pearson_weighted(rows, "u", "i", "v", weights).collect()}
    for a, b in combinations(range(6), 2):
        both = [i for i in range(8) if (a, i) in data and (b, i) in data and w[i] > 0]
        if len(both) < 3:
            assert (a, b) not in got
            continue
        k, x, y = (np.array(z) for z in ([w[i] for i in both], [data[a, i] for i in both], [data[b, i] for i in both]))
        mx, my = (k * x).sum() / k.sum(), (k * y).sum() / k.sum()
        vx, vy = (k * (x - mx) ** 2).sum(), (k * (y - my) ** 2).sum()
        assert got[a, b] == pytest.approx(0 if vx <= 1e-9 or vy <= 1e-9 else (k * (x - mx) * (y - my)).sum() / math.sqrt(vx * vy))


def test_series_and_places(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 5.0), (None, 1, 1.0)], "k string, t int, v double")
    assert [r.p for r in df.select("k", "t", series.cumulative_product(F.col("v"), "k", "t").alias("p")).where("k = 'a'").orderBy("t").collect()] == pytest.approx([2, 6])
    assert series.without(df, "k", ["a"]).count() == 2
    assert df.select(geo.wkt(F.lit("1.5"), F.lit("-2"))).first()[0] == "POINT(1.5 -2)"


def test_a_model_is_read_back(spark, tmp_path):
    tokens = spark.createDataFrame([("good", 1), ("good", 1), ("bad", 0), ("so", 0), ("so", 1)], "word string, y int")
    priors = spark.createDataFrame([(1, 1)], "n0_y long, n1_y long")
    asked = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "unseen")], "doc int, word string")
    counts = text_ops.nb_counts(tokens, "y")
    sinks.write_model(counts, str(tmp_path / "nb"))
    want = {1: 1, 2: 0, 3: 1}
    for model in (counts, sinks.read_model(spark, str(tmp_path / "nb"))):
        assert {r.doc: r.y for r in text_ops.nb_predict(asked, model, priors, "doc", "y").collect()} == want


def test_answers_by_both_methods():
    base = ["Lies(x,y) => In(x,y)", "Lies(x,y) & In(y,z) => In(x,z)", "Lies(Rome,Italy)", "Lies(Italy,World)"]
    text = "\n".join(["2", "In(Rome,World)", "In(Italy,Italy)", str(len(base)), *base])
    assert search.answer(text, search.prove) == ["TRUE", "FALSE"]
    assert search.answer("\n".join(["1", "In(Rome,World)", str(len(base)), *base])) == ["TRUE"]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match=re.escape("spark.checkpoint.dir")):
        scratch.work_dir(Session)


def test_tables_are_deleted(spark):
    table = scratch.written(spark.range(3), "gone")
    assert table.count() == 3
    scratch.discard(table, None, spark.range(1))
    with pytest.raises(Exception, match=r"(?i)path|exist|file"):
        spark.read.parquet(table._written_to).count()


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.txt").write_text("\nfirst\nsecond\n")
    (tmp_path / "a" / "b" / "two.txt").write_text("third")
    got = {r.path.rsplit("/", 1)[1]: r.value for r in tables.whole_files(spark, str(tmp_path / "a")).collect()}
    assert got == {"one.txt": "\nfirst\nsecond\n", "two.txt": "third"}
    (tmp_path / "p.kml").write_text("<kml>\n<Placemark>\n<name>A</name>\n<Point><coordinates>\n-118.2,34.0,0\n</coordinates></Point>\n</Placemark>\n</kml>")
    assert [tuple(r) for r in tables.kml_points(spark, str(tmp_path / "p.kml")).collect()] == [("A", -118.2, 34.0)]
