import random

import numpy as np

from loomwork.llm import toxicity


def corpus(seed, n):
    rng = random.Random(seed)
    syllables = ["th", "an", "er", "ing", "ou", "re", "st", "ea", "ly"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    out = []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(5, 300))]
        y = int(i % 4 == 0)
        for _ in range(rng.randint(1, 4) if y else 0):
            ws[rng.randrange(len(ws))] = rng.choice(["grumbox", "flarnik", "vexpod", "zubtrash"])
        out.append((" ".join(ws), y))
    return out


def test_held_out_accuracy():
    train, test = corpus(1, 900), corpus(2, 400)
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    p = model.scores([t for t, _ in test], {}) >= toxicity.THRESHOLD
    y = np.array([y for _, y in test]) == 1
    assert (p & y).sum() / y.sum() > 0.95 and (p & ~y).sum() / (~y).sum() < 0.05
    clean = " ".join(corpus(3, 8)[1][0].split()[:30])
    scores = model.scores([clean, clean + " flarnikk grumbbox", ""], {})  # spellings that no text has shown
    assert scores[1] > 0.3 > scores[0] and np.isfinite(scores).all()


def test_one_class_gives_no_model(spark):
    assert toxicity.fit(["a b", "c"], [0, 0]) is None and toxicity.fit([], []) is None and toxicity.fit(["", ""], [0, 1]) is None
    df = spark.createDataFrame([(1, "a", 0.5)], "doc_id long, text string, score double")
    assert toxicity.score_toxicity(df, None).first().score == 0.0


def test_frame(spark):
    data = corpus(4, 200)
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(data)] + [(900, None, "x"), (901, "", "x"), (None, "th", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)] + [(5, None), (None, 1), (777, 1)], "doc_id long, toxic int")
    model = toxicity.train_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model)
    assert got.columns == ["doc_id", "text", "score"]
    rows = got.collect()
    assert len(rows) == 203 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    again = toxicity.train_toxicity(docs, labels)
    assert np.array_equal(again.odds, model.odds)


def test_scores_equal_brute_force():
    """Word by word, stretch by stretch."""
    texts = [t for t, _ in corpus(5, 60)] + ["", "1234 5678", "a", "1d10t g00d, w_x", "x " * 5000]
    model = toxicity.Model(np.random.default_rng(1).normal(0, 1, toxicity.BUCKETS), -0.3)

    def score(text):
        ws = [w for w in toxicity.re.findall(r"[^\W_]+", text.lower()) if not w.isdigit()]
        z = [np.mean(model.odds[toxicity.buckets([w])[0]]) for w in ws]
        cuts = list(range(0, max(1, len(z) - toxicity.STRETCH // 2), toxicity.STRETCH))
        strongest = max((np.mean(z[a:b]) for a, b in zip(cuts, [*cuts[1:], len(z)], strict=True)), default=0.0) if z else 0.0
        return 1 / (1 + np.exp(-model.bias - strongest))

    assert np.allclose(model.scores(texts, {}), [score(t) for t in texts])
    assert toxicity.find("1d10t g00d 12") == ["1d10t", "g00d"]


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    rows, count = toxicity.buckets(["alpha", "beta", "gamma", "alphas"])
    names, rows = np.unique(rows, return_inverse=True)  # a small matrix
    of = rows, count, np.cumsum(count) - count
    table, soft, bias = rng.normal(0, 1, (len(names), 3)), rng.normal(0, 1, (3, 2)), rng.normal(0, 1, 2)
    token, n, label, weight = np.array([0, 1, 1, 3, 2, 0]), np.array([3, 1, 2]), np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])

    def loss():
        out, at = 0.0, 0
        for k, y, w in zip(n, label, weight, strict=True):
            mean = np.mean([table[rows[of[2][t] : of[2][t] + count[t]]].mean(axis=0) for t in token[at : at + k]], axis=0)
            z = mean @ soft + bias
            out += w * (np.log(np.exp(z).sum()) - z[y]) / len(n)
            at += k
        return out

    touched, grad, to_soft, to_bias = toxicity.gradients(table, soft, bias, token, n, of, label, weight)
    whole = np.zeros_like(table)
    whole[touched] = grad
    for value, got in ((table, whole), (soft, to_soft), (bias, to_bias)):
        for i in np.ndindex(value.shape):
            was, side = value[i], []
            for e in (1e-5, -1e-5):
                value[i] = was + e
                side.append(loss())
            value[i] = was
            assert abs((side[0] - side[1]) / 2e-5 - got[i]) < 1e-6


def test_clashing_names(spark):
    data = corpus(6, 60)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, (t, _) in enumerate(data)], "doc_id long, text string, __id int, __y int")
    model = toxicity.train_toxicity(docs, spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id long, toxic int"))
    twice = docs.unionByName(docs)
    got = toxicity.score_toxicity(twice, model)
    assert got.columns == [*docs.columns, "score"]
    rows = got.collect()
    assert len(rows) == 120 and len({(r.doc_id, r.score) for r in rows}) == 60  # repeated rows have one score
