from collections import Counter

from loomwork.llm.lines import dedup_lines

from .brute import documents


def brute(rows):
    """One text for each (id, text); windows in the order of id (null first), then text hash, which only ties of id need."""
    texts = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    first, out = {}, {}
    for key in texts:
        lines = key[1].split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if first.setdefault(w, (key, i)) != (key, i):
                gone |= {i, i + 1, i + 2}
        out[key] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return Counter((r[0], *(out[r] if r[1] is not None else (None, 0, 0))) for r in rows)


def run(spark, rows):
    got = dedup_lines(spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_removed int"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    return Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect())


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = documents(seed)
        assert run(spark, rows) == brute(rows)


def test_every_line_that_goes_stands_elsewhere(spark):
    rows = [(1, "a\na\na\na\na"), (2, "x\na\na\na\ny"), (3, "p\nq\nr\ns"), (4, "q\nr\ns\nt")]
    got = run(spark, rows)
    assert got == brute(rows)
    kept = {line for _, t, *_ in got for line in t.split("\n")}
    assert {line for _, t in rows for line in t.split("\n")} <= kept


def test_empty_table(spark):
    assert not run(spark, [(1, "a")][:0]) and dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
