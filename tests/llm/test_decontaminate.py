import pytest
from pyspark.sql import functions as F

from loomwork.llm import decontaminate
from loomwork.llm.decontaminate import find_benchmark, remove_benchmark, words

from .brute import documents


def brute(rows, items):
    out = []
    for d, text in rows:
        ws, hit, got, longest = words(text), set(), set(), 0
        for name, it in items:
            iw = words(it)
            n = min(10, len(iw))
            for j in range(len(iw) - n + 1) if n else []:
                for i in range(len(ws) - n + 1):
                    if ws[i : i + n] == iw[j : j + n]:
                        k = n
                        while i + k < len(ws) and j + k < len(iw) and ws[i + k] == iw[j + k]:
                            k += 1
                        hit |= set(range(i, i + n))
                        got.add(str(name))
                        longest = max(longest, k)
        out.append((d, len(ws), len(hit), tuple(sorted(got)), longest))
    return sorted(out, key=str)


def planted():
    rows = documents(9, 20)
    long = next(t for _, t in rows if t and len(t.split()) > 1000).split()
    items = [(1, " ".join(long[50:75])), (2, "Short, item! One"), (3, ""), (4, None), (10, " ".join(long[60:80]) + " other end"), (11, "never seen words at all in here")]
    rows += [(500, "say " + items[0][1].upper() + " end"), (501, "x short ITEM one short item one y"), (502, " ".join(long[50:59]))]
    return rows, items


@pytest.mark.parametrize("block", [32_000_000, 10])
def test_equals_brute_force(spark, block):
    rows, items = planted()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, hits int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_benchmark(df, bench, block_bytes=block).withColumn("n", decontaminate.n_hit()).collect()
    assert sorted(((r.doc_id, r.n_words, r.n, tuple(r["items"]), r.longest) for r in got), key=str) == brute(rows, items)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 40)
    rows, items = planted()
    got = [decontaminate.Benchmark([(str(a), b) for a, b in items]).search([words(t)])[0] for _, t in rows]
    assert sorted(((d, len(words(t)), sum(b - a for a, b in g[0])) for (d, t), g in zip(rows, got, strict=True)), key=str) == sorted(((x[0], x[1], x[2]) for x in brute(rows, items)), key=str)


def test_removal(spark):
    rows, items = planted()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, hits int")
    kept = remove_benchmark(df, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(x[0]) for x in brute(rows, items) if not x[3])
    assert remove_benchmark(df, spark.createDataFrame([], "item_id long, text string")).count() == len(rows)
    assert find_benchmark(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).select(F.col("items")).count() == 0


def test_blocks_do_not_show(spark):
    """Spans, items and longest match with its item and place are the same however the benchmark is dealt."""
    rows, items = planted()
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows += [(600, f"x {line} y {line}"), (601, line)]
    items += [(9, line), (10, line), (9, line), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    fields = ("doc_id", "n_words", "hits", "items", "longest", "longest_item", "longest_at")
    one, many = (sorted((str([r[f] for f in fields]) for r in find_benchmark(df, bench, block_bytes=b).collect())) for b in (32_000_000, 10))
    assert one == many
    best = {r.doc_id: (r.longest_item, r.longest_at, r.hits) for r in find_benchmark(df, bench, block_bytes=10).where("doc_id >= 600").collect()}
    assert best == {600: ("10", 1, [[1, 13], [14, 26]]), 601: ("10", 0, [[0, 12]])}


def test_driver_holds_a_block_at_a_time(spark):
    items = [(i, "w " * (20 if i else 200)) for i in range(40)]
    sizes = [[len(t) for _, t in b] for b in decontaminate._blocks(spark.createDataFrame(items, "item_id long, text string"), "item_id", "text", 100)]
    assert sum(map(len, sizes)) == 40 and all(sum(b) <= 100 or len(b) == 1 for b in sizes)
