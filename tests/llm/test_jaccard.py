import random

import pytest

from loomwork.llm import components, jaccard

from .brute import documents


def grams(text):
    ws = (text or "").encode().translate(jaccard.LOWER).split()
    n = min(5, len(ws))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()


def brute(rows):
    """(id, size, component) for each row."""
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int")
    return sorted((tuple(r) for r in jaccard.link_ngrams(df).collect()), key=str)


def test_equals_brute_force(spark):
    rows = documents(7)
    assert run(spark, rows) == brute(rows)


def test_long_lists_in_blocks(spark, monkeypatch):
    """Posting lists beyond the short length go through blocks, with no round of leaders before."""
    monkeypatch.setattr(jaccard, "SHORT", 3)
    monkeypatch.setattr(jaccard, "SIDE", 4)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    rows = documents(8, 20)
    base = rows[0][1] if rows[0][1] and len(rows[0][1].split()) > 40 else " ".join(f"b{i}" for i in range(60))
    words = base.split()
    for k in range(16):  # a chain: each is near the next, the ends are far apart
        words = [*words[2:], f"n{k}a", f"n{k}b"]
        rows.append((1000 + k, " ".join(words)))
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (2, " \t\n")], [(1, "a b"), (2, "A  B"), (3, "a b c")]])
def test_small(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_keep_one(spark):
    rows = [(5, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "z"), (6, None), (7, None)]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [3, 4, 6, 7]


@pytest.mark.parametrize("summary", [1 << 18, 4000, 40])
def test_heavy_ngrams(spark, monkeypatch, summary):
    """N-grams of many classes go another way and give the same links, however many of them the summary holds."""
    monkeypatch.setattr(jaccard, "HEAVY", 3)
    monkeypatch.setattr(jaccard, "SUMMARY", summary)
    monkeypatch.setattr(jaccard, "FEW", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 300)
    rows = documents(8)
    found, counts = jaccard.heavy_ngrams(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "text", 5)
    assert (summary == 40 or len(found)) and len(found) <= summary and (counts >= 3).all()
    assert run(spark, rows) == brute(rows)


def test_summary_finds_what_is_certain(monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "SUMMARY", 20)
    rng = np.random.default_rng(1)
    h, c = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    every = []
    for _ in range(30):
        block = np.concatenate((rng.integers(100, 10_000, 200), np.repeat([1, 2, 3], [40, 25, 15]))).astype(np.uint64)
        every.append(block)
        h, c = jaccard._summed(np.concatenate((h, block)), np.concatenate((c, np.ones(len(block), dtype=np.int64))))
    total = sum(map(len, every))
    got = dict(zip(h.tolist(), c.tolist(), strict=True))
    assert len(got) <= 20
    for x, n in ((1, 1200), (2, 750), (3, 450)):
        assert n - total / 21 <= got.get(x, 0) <= n


@pytest.mark.parametrize("few", [None, 0])
def test_components_of_few_and_many_links(spark, monkeypatch, few):
    """The driver's way, which takes a bounded number of jobs, and the stars have the same labels."""
    if few is not None:
        monkeypatch.setattr(components, "FEW_LINKS", few)
    rng = random.Random(3)
    keys = [rng.randrange(-(1 << 63), 1 << 63) for _ in range(120)]
    chain = [(keys[i], keys[i + 1]) for i in range(40)]
    links = [*chain, *((rng.choice(keys[50:]), rng.choice(keys[50:])) for _ in range(50)), (keys[45], keys[45])]
    least = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in links:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"components-{few}", "")
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    jobs = len(tracker.getJobIdsForGroup(f"components-{few}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.key: r.component for r in got} == least and len(got) == len(least)
    assert few == 0 or jobs <= 6
