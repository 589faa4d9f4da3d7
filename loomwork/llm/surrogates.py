"""Operator 6, PII: keyed surrogates for e-mail addresses, phone, card and social-security numbers, IPv4 addresses and titled names.

An entity has a kind and a canonical form (digits of a number, an address in lower case, one word of a name), so that it
is the same entity however it is written. A keyed Feistel network over its symbols gives the surrogate:
every symbol moves within its own alphabet (digits, vowels or consonants of its script and case,
octets), so length, punctuation, script and case stay, and two entities of one format cannot meet.
Names keep their title and last letter, on which the gender shows; cards keep the first digit and, where they are
valid by Luhn's check digit, stay valid; addresses keep the first octet, phone numbers the country code (of
numbers not in groups of 3, 3 and 4 the first two digits). An e-mail domain ends in the reserved ``example``; its capitals stay.

The map from entity to surrogate is one table. It is checked: where two entities have one surrogate,
or one has itself, all but the first get a further tweak of the key, until none is left. Then every
occurrence is replaced through the map, which keeps coreference over all texts.

Every pattern is linear in the text: runs are taken possessively and begin only where none goes on, so neither the
stack nor the time depends on how long a run is.

Only DataFrame functions; an entity that stands in a large share of the texts is one row of the map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, free_names, read, written

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
LOCAL = r"\p{L}\p{N}._%+-"
WORD = r"\p{Lu}\p{Ll}{1,30}[ -]"
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Señor|Señora|Господин|Госпожа"
GROUPED = r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
INTERNATIONAL = r"(?<![\w.])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?![\w-]|\.\d)"
#: Kind and pattern, in the order of preference. Java's syntax; no group takes part in the match's number.
#: Each word of a name is a match of its own: up to three name words may stand between it and the title.
PATTERNS = {
    "EMAIL": rf"(?<![{LOCAL}])[{LOCAL}]++@(?:[A-Za-z0-9-]++\.(?=[A-Za-z0-9-]))++[A-Za-z](?:-*+[A-Za-z0-9])++",
    "IP": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)",
    "PHONE": f"(?:{GROUPED}|{INTERNATIONAL})",
    "SSN": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "CARD": r"(?<![\w.-])(?:[3-6]\d{12,18}|2[2-7]\d{14}|[2-6]\d{3}(?:[ -]\d{4}){3}|3\d{3}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)",
    "NAME": rf"(?=\p{{Lu}}\p{{Ll}})(?<=(?<!\p{{L}})(?:{TITLES})\.? (?:{WORD})?(?:{WORD})?(?:{WORD})?)\p{{Lu}}\p{{Ll}}++",
}
NUMBERS = "|".join(f"(?:{PATTERNS[k]})" for k in ("IP", "PHONE", "SSN", "CARD"))
EVERY = f"(?:{PATTERNS['EMAIL']})|(?=[\\d+(])(?:{NUMBERS})|(?:{PATTERNS['NAME']})"
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
ALPHABETS = ("0123456789", *LETTERS, *(a.upper() for a in LETTERS))
#: Letters of no alphabet above become one of these; rounds of the network; tweaks from which a surrogate grows; rounds of the check.
OTHER, ROUNDS, LONGER, MOST = "bcdfghjklmnprstvwz", 4, 16, 200


def _kind(entity: Column) -> Column:
    cases = [(kind, F.regexp_like(entity, F.lit(f"^(?:{p})$"))) for kind, p in PATTERNS.items() if kind not in ("NAME",)]
    return F.coalesce(*(F.when(test, F.lit(kind)) for kind, test in cases), F.lit("NAME"))


def _canon(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, r"\D", "")
    american = F.regexp_like(entity, F.lit(f"^(?:{GROUPED})$")) | ((F.length(digits) == 11) & digits.startswith("1"))
    phone = F.when(american, F.right(digits, F.lit(10))).otherwise(F.concat(F.lit("+"), digits))
    return F.when(kind == "EMAIL", F.lower(entity)).when(kind == "PHONE", phone).when(kind.isin("CARD", "SSN"), digits).otherwise(entity)


def _moved(symbol: Column, by: Column) -> Column:
    n = len(OTHER)
    out = F.when(symbol.rlike(r"^\p{L}$"), F.substring(F.lit(OTHER), F.pmod(F.ascii(symbol) + by, F.lit(n)).cast("int") + 1, F.lit(1))).otherwise(symbol)
    for a in reversed(ALPHABETS):
        at = F.instr(F.lit(a), symbol)
        out = F.when(at > 0, F.substring(F.lit(a), F.pmod(at - 1 + by, F.lit(len(a))).cast("int") + 1, F.lit(1))).otherwise(out)
    return out


def _luhn(digits: Column) -> Column:
    """The check digit that the digits (all but the last of a number) ask for."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.try_add(c.try_cast("int"), F.when(i % 2 == 0, c.try_cast("int")).otherwise(0)))
    return F.pmod(-F.aggregate(d, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x)), F.lit(10))


def _surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon, tweak) with column surrogate."""
    octets, rest = F.split("canon", r"\."), F.split("canon", "")
    name = F.col("canon")
    body = (
        F.when(F.col("kind") == "IP", F.slice(octets, 2, 3))
        .when(F.col("kind") == "CARD", F.split(F.expr("substring(canon, 2, length(canon) - 2)"), ""))
        .when((F.col("kind") == "PHONE") & name.startswith("+"), F.split(F.substring(name, 4, 40), ""))
        .when(F.col("kind") == "EMAIL", F.split(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), ""))
        .when(F.col("kind") == "NAME", F.split(F.expr("left(canon, length(canon) - 1)"), ""))
        .otherwise(rest)
    )
    t = entities.withColumn("body", body).withColumn("mid", F.floor(F.size("body") / 2).cast("int"))
    t = t.withColumn("s0", F.slice("body", F.lit(1), F.col("mid"))).withColumn("s1", F.slice("body", F.col("mid") + 1, F.size("body") - F.col("mid")))
    for r in range(ROUNDS):
        own, other = (f"s{r % 2}", f"s{1 - r % 2}")
        seed = F.sha2(F.concat_ws("|", F.lit(key), F.col("tweak").cast("string"), "kind", F.lit(str(r)), F.size("body").cast("string"), F.array_join(other, ",")), 256)
        t = t.withColumn("seed", seed)
        turn = lambda i: F.pmod(F.xxhash64("seed", i), F.lit(1 << 40))
        letters = F.transform(own, lambda c, i: _moved(c, turn(i)))  # noqa: B023
        numbers = F.transform(own, lambda c, i: F.pmod(c.try_cast("bigint") + turn(i), F.lit(256)).cast("string"))  # noqa: B023
        t = t.withColumn(own, F.when(F.col("kind") == "IP", numbers).otherwise(letters))
    both = F.concat("s0", "s1")
    joined = F.array_join(both, "")
    # a tweak so high that the format has no room left: letters that spell it, or a number behind the name of the domain
    more = F.col("tweak") >= LONGER
    spelt = F.when(more, F.translate(F.lower(F.hex("tweak")), "0123456789abcdef", "bcdfghjklmnpqrst")).otherwise("")
    numbered = F.when(more, F.concat(F.lit("-"), F.col("tweak").cast("string"))).otherwise("")
    first = F.concat(F.substring(name, 1, 1), joined)
    check = F.pmod(_luhn(first) + F.right(name, F.lit(1)).try_cast("int") - _luhn(F.expr("left(canon, length(canon) - 1)")), F.lit(10))
    made = (
        F.when(F.col("kind") == "IP", F.concat_ws(".", octets[0], F.array_join(both, ".")))
        .when(F.col("kind") == "CARD", F.concat(first, check.cast("string")))
        .when((F.col("kind") == "PHONE") & name.startswith("+"), F.concat(F.left(name, F.lit(3)), joined))
        .when(F.col("kind") == "EMAIL", F.concat(joined, numbered, F.lit(".example")))
        .when(F.col("kind") == "NAME", F.concat(joined, spelt, F.right(name, F.lit(1))))
        .otherwise(joined)
    )
    return t.select("kind", "canon", "tweak", made.alias("surrogate"))


def surrogate_map(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of distinct (kind, canon), checked: no entity has its own form, no two of a kind share one.

    Of entities that meet, the one of least tweak and form stays; the others go on from the highest tweak so far by their rank, so that they part at once.
    Raises ValueError if numbers of one format are so many that no free one is left."""
    done = written(_surrogates(entities.select("kind", "canon", F.lit(0).alias("tweak")), key), "surrogates")
    for _ in range(MOST):
        first = done.groupBy("kind", "surrogate").agg(F.min(F.struct("tweak", "canon")).alias("f"))
        owned = done.join(first, ["kind", "surrogate"])
        clash = owned.where((F.col("canon") != F.col("f.canon")) | (F.col("canon") == F.col("surrogate")))
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("tweak", "canon"))
        top = done.agg(F.max("tweak").alias("top"))  # one row
        bad = written(clash.select("kind", "canon", rank.alias("rank")).crossJoin(F.broadcast(top)).select("kind", "canon", (F.col("top") + F.col("rank")).alias("tweak")), "clashes")
        if bad.isEmpty():
            discard(bad)
            return done.select("kind", "canon", "surrogate")
        last, done = done, written(done.join(bad, ["kind", "canon"], "left_anti").unionByName(_surrogates(bad, key)), "surrogates")
        discard(last, bad)
    raise ValueError("no free surrogate is left for some entities")


def _laid_out(entity: Column, kind: Column, new: Column) -> Column:
    """The surrogate in the entity's format: numbers keep every character that is not one of the digits replaced, addresses their capitals."""
    digits, own = F.regexp_replace(entity, r"\D", ""), F.regexp_replace(new, r"\D", "")
    filled = F.concat(F.left(digits, F.length(digits) - F.length(own)), own)
    cased = F.array_join(F.zip_with(F.split(entity, ""), F.split(new, ""), lambda e, c: F.when(e != F.lower(e), F.upper(c)).otherwise(F.coalesce(c, F.lit("")))), "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substring(filled, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + digit.cast("int")).alias("k"))

    return F.when(kind.isin("PHONE", "CARD", "SSN"), F.aggregate(F.split(entity, ""), start, step, lambda a: a["out"])).when(kind == "EMAIL", cased).otherwise(new)


def replace_pii(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with entities in text_col replaced, and entities (array of kinds, in order of place) after its columns.

    Null and empty texts have no entities and stay. Rows that agree in id and text are one text. Columns of df
    named entities are replaced. The same key gives the same surrogates for the same set of entities.
    """
    i, th, s = free_names(df, "__id", "__th", "__s")
    found = F.regexp_extract_all(F.col(text_col), F.lit(EVERY), F.lit(0))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), found.alias("e")).where("size(e) > 0").dropDuplicates(["id", "th"])
    each = rows.select("id", "th", F.posexplode("e").alias("at", "entity"))
    each = each.withColumn("kind", _kind(F.col("entity"))).withColumn("canon", _canon(F.col("kind"), F.col("entity")))
    each = written(each, "entities")
    table = surrogate_map(each.select("kind", "canon").distinct(), key)
    new = _laid_out(F.col("entity"), F.col("kind"), F.col("surrogate")).alias("new")
    named = each.join(table, ["kind", "canon"]).select("id", "th", F.struct("at", "kind", new).alias("s"))
    lists = named.groupBy(F.col("id").alias(i), F.col("th").alias(th)).agg(F.array_sort(F.collect_list("s")).alias(s))
    joined = df.join(lists, df[id_col].eqNullSafe(F.col(i)) & (F.xxhash64(df[text_col]) == F.col(th)), "left")
    pieces = F.split(df[text_col], EVERY, -1)
    text = F.array_join(F.zip_with(pieces, F.col(f"{s}.new"), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")
    names = [c for c in df.columns if c != "entities"]
    kinds = F.coalesce(F.col(f"{s}.kind"), F.array().cast("array<string>")).alias("entities")
    return joined.select(*(F.when(F.col(s).isNull(), df[c]).otherwise(text).alias(c) if c == text_col else df[c] for c in names), kinds)


#: Of the registered query; a real run brings its own.
QUERY_KEY = "surrogates of the registered query"


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_pii(read(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return out.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), F.array_join("entities", ",").alias("kinds"))
