import hashlib
import random
import re
import time

import regex
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import surrogates
from loomwork.llm.surrogates import replace_pii, surrogate_map

from .brute import documents

ROWS = [
    (1, "Mail Bob.Lee@Mail.com or bob.lee@mail.com, call +1 (229) 555-4838 or 229-555-4838."),
    (2, "Card 4046195599780836 and 4046-1955-9978-0836; hosts 10.0.0.1, 42.144.35.254."),
    (3, None), (4, ""), (5, "Mrs. Maria met Mr. Ivan and Herr Klein. Госпожа Иванова. SSN 123-45-6789"),
    (6, "x@y.com"), (7, "x@y.org"), (None, "again 10.0.0.1"), (8, "version 1.2.3, 12-34, 2024-01-01, 99%"), (6, "x@y.com"), (9, "a@b.co " * 500),
]


def run(spark, key="k"):
    df = spark.createDataFrame([(*r, "z") for r in ROWS], "doc_id long, text string, entities string")
    return {r.doc_id: r for r in replace_pii(df, key).collect()}


def test_formats_and_coreference(spark):
    got = run(spark)
    assert len(replace_pii(spark.createDataFrame(ROWS, "doc_id long, text string"), "k").collect()) == len(ROWS)
    mail, phone = re.findall(r"\S+@\S+\.example", got[1].text), re.findall(r"\d{3}\)? ?-?(?:\d{3})-\d{4}", got[1].text)
    assert len(mail) == 2 and mail[0].lower() == mail[1] and re.match(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\.example", mail[0])
    assert len({re.sub(r"\D", "", p) for p in phone}) == 1 and "+1 (" in got[1].text and "555-4838" not in got[1].text
    cards = re.findall(r"4\d{15}|4\d{3}-\d{4}-\d{4}-\d{4}", got[2].text)
    assert len(cards) == 2 and len({c.replace("-", "") for c in cards}) == 1 and "4046195599780836" not in got[2].text
    hosts = re.findall(r"\d+\.\d+\.\d+\.\d+", got[2].text)
    assert hosts[0].startswith("10.") and hosts[1].startswith("42.") and hosts[0] in got[None].text
    assert got[3].text is None and got[4].text == "" and got[8].text == ROWS[8][1]
    names = re.match(r"Mrs\. ([A-Z][a-z]+a) met Mr\. ([A-Z][a-z]+n) and Herr ([A-Z][a-z]+n)\. Госпожа ([А-Я][а-я]+а)\. SSN \d{3}-\d{2}-\d{4}$", got[5].text)
    assert names and "Maria" not in got[5].text and "Иванова" not in got[5].text
    assert got[6].text != got[7].text  # two entities whose last label alone differs stay two
    assert len(set(got[9].text.split())) == 1 and len(got[9].entities) == 500
    assert run(spark, "other")[1].text != got[1].text


def test_map_is_one_to_one(spark):
    rows = [("PHONE", f"22955{i:05d}") for i in range(300)] + [("EMAIL", f"a{i}@b.{t}") for i in range(60) for t in ("com", "org", "net")] + [("NAME", a + b) for a in "BCD" for b in ("o", "a", "ob")]
    got = surrogate_map(spark.createDataFrame(rows, "kind string, canon string"), "k")
    assert got.count() == len(rows)
    assert got.groupBy("kind", "surrogate").count().where("count > 1").count() == 0
    assert got.where(F.col("canon") == F.col("surrogate")).count() == 0


def test_empty(spark):
    assert replace_pii(spark.createDataFrame([], "doc_id long, text string"), "k").count() == 0
    assert re.search(surrogates.PATTERNS["IP"].replace("(?<![\\w.])", ""), "1.2.3.4")


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _turn(seed, i):
    return _signed(xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(seed.encode(), seed=42))) % (1 << 40)


def _move(c, by):
    for a in surrogates.ALPHABETS:
        if c in a:
            return a[(a.index(c) + by) % len(a)]
    return surrogates.OTHER[(ord(c) + by) % len(surrogates.OTHER)] if c.isalpha() else c


def _check_digit(digits):
    d = [int(c) * (2 if i % 2 == 0 else 1) for i, c in enumerate(reversed(digits))]
    return -sum(x - 9 if x > 9 else x for x in d) % 10


def _surrogate(kind, canon, tweak, key):
    """One entity's surrogate, symbol by symbol."""
    body = {"IP": lambda: canon.split(".")[1:], "CARD": lambda: list(canon[1:-1]), "EMAIL": lambda: list(canon.rpartition(".")[0]), "NAME": lambda: list(canon[:-1]), "PHONE": lambda: list(canon[3:] if canon[0] == "+" else canon)}
    body = body.get(kind, lambda: list(canon))()
    half = [body[: len(body) // 2], body[len(body) // 2 :]]
    for r in range(surrogates.ROUNDS):
        own, other = half[r % 2], half[1 - r % 2]
        seed = hashlib.sha256("|".join([key, str(tweak), kind, str(r), str(len(body)), ",".join(other)]).encode()).hexdigest()
        half[r % 2] = [str((int(c) + _turn(seed, i)) % 256) if kind == "IP" else _move(c, _turn(seed, i)) for i, c in enumerate(own)]
    both = half[0] + half[1]
    joined, more = "".join(both), tweak >= surrogates.LONGER
    if kind == "IP":
        return ".".join([canon.split(".")[0], *both])
    if kind == "CARD":
        return canon[0] + joined + str((_check_digit(canon[0] + joined) + int(canon[-1]) - _check_digit(canon[:-1])) % 10)
    if kind == "EMAIL":
        return joined + (f"-{tweak}" if more else "") + ".example"
    if kind == "NAME":
        return joined + ("".join("bcdfghjklmnpqrst"[int(c, 16)] for c in f"{tweak:x}") if more else "") + canon[-1]
    return canon[:3] + joined if canon[0] == "+" else joined


def _brute_map(entities, key):
    tweak = dict.fromkeys(entities, 0)
    while True:
        made = {e: _surrogate(*e, t, key) for e, t in tweak.items()}
        groups = {}
        for e in sorted(entities, key=lambda e: (tweak[e], e[1])):
            groups.setdefault((e[0], made[e]), []).append(e)
        bad = [(e, i) for g in groups.values() for i, e in enumerate([e for j, e in enumerate(g) if j or e[1] == made[e]], 1)]
        if not bad:
            return made
        top = max(tweak.values())
        for e, i in bad:
            tweak[e] = top + i


def _brute(rows, key):
    """Each occurrence found by the patterns, one at a time, and replaced through a map of all."""
    java = lambda p: regex.compile(p.replace(r"[\w", "[A-Za-z0-9_").replace(r"(?!\w", "(?![A-Za-z0-9_]").replace(r"[\d", "[0-9").replace(r"\d", "[0-9]"))
    every = java(surrogates.EVERY)
    whole = {k: java(f"^(?:{p})$") for k, p in surrogates.PATTERNS.items() if k != "NAME"}
    grouped = java(f"^(?:{surrogates.GROUPED})$")

    def entity(t):
        kind = next((k for k, p in whole.items() if p.match(t)), "NAME")
        digits = "".join(c for c in t if c in "0123456789")
        if kind == "PHONE":
            return kind, digits[-10:] if grouped.match(t) or (len(digits) == 11 and digits[0] == "1") else "+" + digits
        return kind, t.lower() if kind == "EMAIL" else digits if kind in ("CARD", "SSN") else t

    table = _brute_map({entity(m[0]) for _, t in rows for m in every.finditer(t or "")}, key)

    def put(m):
        t, (kind, canon) = m[0], entity(m[0])
        new = table[kind, canon]
        if kind == "EMAIL":
            return "".join(n.upper() if i < len(t) and t[i] != t[i].lower() else n for i, n in enumerate(new))
        if kind in ("PHONE", "CARD", "SSN"):
            own, digits = [c for c in new if c.isdigit()], [c for c in t if c in "0123456789"]
            left = iter(digits[: len(digits) - len(own)] + own)
            return "".join(next(left) if c in "0123456789" else c for c in t)
        return new

    return [(d, None if t is None else every.sub(put, t)) for d, t in rows]


def _rows(seed=5):
    rng = random.Random(seed)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    words = ["the", "Straße", "of", "x", "№5", "1.2", "a-b", "Anna", "end."]
    kinds = [
        lambda: f"{rng.choice(['Bob', 'über', 'a', 'x.y+z'])}.{number(1)}@{rng.choice(['Mail', 'b', 'q-r'])}.{rng.choice(['com', 'org', 'co.uk', 'net'])}",
        lambda: f"+1 ({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"+49 30 {number(6)}", lambda: f"+33 {number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", lambda: f"+1{number(10)}",
        lambda: f"4{number(15)}", lambda: f"2720-{number(4)}-{number(4)}-{number(4)}", lambda: f"3{number(3)} {number(6)} {number(5)}", lambda: f"{number(3)}-{number(2)}-{number(4)}",
        lambda: ".".join(str(rng.randrange(0, 300)) for _ in range(4)), lambda: f"{rng.choice(['Mr.', 'Frau', 'Dr', 'Госпожа'])} {rng.choice(['Maria', 'Иван', 'Ödön', 'Bo'])}{rng.choice(['', ' Klein', '-Lee Smith'])}",
    ]
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.6 else rng.choice(kinds)() for _ in range(rng.randrange(30)))) for i in range(120)]
    return rows + [r for r in documents(4, 10)] + [(500, None), (501, ""), rows[0], rows[0], (502, rows[1][1])]


def test_equals_brute_force(spark):
    rows = ROWS + _rows()
    got = replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(_brute(rows, "k"), key=str)


def test_check_digit_stays(spark):
    cards = [c + str(_check_digit(c)) for c in ("453201511283036", "555555555555444", "37144963539843", "272012345678901")]
    text = replace_pii(spark.createDataFrame([(i, f"card {c}") for i, c in enumerate([*cards, "4532015112830360"])], "doc_id long, text string"), "k")
    new = {r.doc_id: r.text.split()[1] for r in text.collect()}
    assert all(_check_digit(new[i][:-1]) == int(new[i][-1]) and new[i] != c and new[i][0] == c[0] for i, c in enumerate(cards))
    assert _check_digit(new[4][:-1]) != int(new[4][-1])


def test_name_words_stay_one_person(spark):
    rows = [(1, "Mr. John Smith and Mrs Smith met Dr John Xavier Smith-Doe."), (2, "Ms Doe")]
    a, b = (r.text for r in replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").orderBy("doc_id").collect())
    john, smith, mrs, john2, xavier, smith2, doe = re.match(r"Mr\. (\w+) (\w+) and Mrs (\w+) met Dr (\w+) (\w+) (\w+)-(\w+)\.$", a).groups()
    assert john == john2 and smith == mrs == smith2
    assert b == f"Ms {doe}"
    assert len({john, smith, xavier}) == 3 and "Smith" not in a and "John" not in a


def test_one_body_under_many_domains(spark):
    """More addresses than the letters of one body can tell apart."""
    rows = [("EMAIL", f"a@b.{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(300)]
    got = surrogate_map(spark.createDataFrame(rows, "kind string, canon string"), "k").collect()
    assert len({r.surrogate for r in got}) == 300


def test_very_long_runs(spark):
    n = 1_000_000
    hard = ["x@" + "a." * (n // 2) + "com", "a" * n, "a." * (n // 2), "1" * n, "1 " * (n // 2), "x@" * (n // 2), "+1-" * (n // 3), "Mr. " * (n // 4), "Mr. " + "A" + "a" * n, "a@" + "-" * n, "1.2." * (n // 4), "a@b.co " * (n // 7)]
    df = spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string").repartition(4)
    begin = time.time()
    got = {r.doc_id: (r.n, r.m) for r in replace_pii(df, "k").select("doc_id", F.length("text").alias("n"), F.size("entities").alias("m")).collect()}
    assert time.time() - begin < 60
    assert got[0][1] == 1 and got[11][1] == n // 7 and all(got[i][1] == 0 for i in (1, 2, 3, 4, 6, 9))


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x@y.com", "a", 1, 2)], "doc_id long, text string, __s string, __id int, __th int")
    got = replace_pii(df, "k")
    assert got.columns == [*df.columns, "entities"] and got.first()["__s"] == "a" and "x@y" not in got.first().text
