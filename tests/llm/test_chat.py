import random


from loomwork.llm import chat


def talk(seed, n, long=0):
    rng = random.Random(seed)
    line = lambda k, end: " ".join(rng.choice(["so", "then", "word", "the", "plan"]) for _ in range(k)) + end
    rows = []
    for c in range(n):
        roles = ["system"] * (c % 4 == 0) + ["user", "assistant"] * (long if c == 0 and long else rng.randint(1, 5))
        for t, r in enumerate(roles):
            text = line(rng.randint(3, 12), "?") if r == "user" else "\n".join(line(rng.randint(20, 60), ".") for _ in range(rng.randint(1, 4)))
            rows.append((c, t, r, text))
    return rows


def parsed(spark, rows, model, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.parse_roles(chat.transcript(table).drop("role", "first", "lead"), model).orderBy("conv", "part", "at").collect()
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    return out


def test_roles_and_borders(spark):
    rows = talk(1, 60, long=80)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(table)
    lines = chat.transcript(table)
    many, one = parsed(spark, rows, model, 7), parsed(spark, rows, model, 1)
    key = lambda r: (r.conv, r.chat_turn, r.role, r.first, r.text)
    assert list(map(key, many)) == list(map(key, one))  # a conversation over many partitions has the path of one pass
    truth = {(r.conv, r.turn, r.line): r.role for r in lines.collect()}
    seen = [r for r in many if r.text]
    assert sum(r.role == truth[r.conv, r.turn, r.line] for r in seen) / len(seen) > 0.95


def test_viterbi_equals_enumeration(spark):
    from itertools import product

    import numpy as np

    table = spark.createDataFrame(talk(2, 30), "conv_id long, turn long, role string, text string")
    model = chat.fit(table)
    scores = np.random.default_rng(1).normal(0, 1, (4, chat.S))
    total = lambda p: model.start[p[0]] + scores[0, p[0]] + sum(model.move[a, b] + scores[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:])))
    assert tuple(chat._path(scores, model, -1, -1)) == max(product(range(chat.S), repeat=4), key=total)


def test_turns(spark):
    rows = [(1, 0, "user", "hello there?"), (1, 1, "assistant", None), (1, 2, "user", ""), (2, 0, None, "what is it"), (None, 0, "user", "x"), (1, 0, "user", "hello there?")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(spark.createDataFrame(talk(3, 30), "conv_id long, turn long, role string, text string"))
    got = chat.turns(chat.parse_roles(chat.transcript(table).drop("role", "first", "lead"), model)).collect()
    assert {r.conv for r in got} == {1, 2, None}
    assert all(r.rendered == f"<|{r.role}|>\n{r.text}\n<|end|>\n" for r in got)
    text = " ".join(r.text for r in got)
    assert text.count("hello there?") == 2 and "what is it" in text
    empty = chat.parse_roles(chat.transcript(table.limit(0)).drop("role", "first", "lead"), model)
    assert empty.count() == 0


def test_roles_of_conversations_that_taught_nothing(spark):
    rows = talk(7, 80)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(table.where("conv_id % 5 <> 1"))
    held = [r for r in rows if r[0] % 5 == 1]
    truth = {(r.conv, r.turn, r.line): r.role for r in chat.transcript(table).collect()}
    seen = [r for r in parsed(spark, held, model, 3) if r.text]
    assert sum(r.role == truth[r.conv, r.turn, r.line] for r in seen) / len(seen) > 0.9
