"""Set and rating similarity, min-hash, collaborative filtering. Pairs come from co-occurrence, never from all against all."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..scratch import kept, written
from ..shipping import ship
from .relational import top_k

PRIME = 1_000_000_007
#: Variance up to this counts as none.
FLAT = 1e-9
#: Rows of pairs that a task makes, about; keys of an array; buckets of keys of which the work is known, at most.
PAIRS, LONG, RANGES = 1 << 21, 2000, 1 << 16
#: Texts of a block and shingles of a matrix, where blocks of texts meet; size classes to a factor of the least similarity.
SIDE, COLUMNS, STEPS = 512, 4096, 4


def _lookup(numbers: list[int]) -> Column:
    """A constant array; an expression for each number would make plans long."""
    return F.from_json(F.lit(str(numbers)), "array<int>")


def _dealt(work: dict[int, int], n: int) -> tuple[list[int], list[int], int]:
    """Of work by bucket: first part and number of parts of each of n buckets, and the number of all parts. Neighbours share a part up to PAIRS of work."""
    first, parts, at, held = [0] * n, [1] * n, 0, 0
    for bucket in range(n):
        w = work.get(bucket, 0)
        if held and held + w > PAIRS:
            at, held = at + 1, 0
        first[bucket], parts[bucket] = at, max(1, -(-w // (2 * PAIRS)))
        held += w
        if parts[bucket] > 1:
            at, held = at + parts[bucket], 0
    return first, parts, at + 1


def paired(rows: DataFrame, key: str, item: str, values: list[str], aggregates: list[Column]) -> DataFrame:
    """(a, b, aggregates) of the pairs a < b of keys that share an item; aggregates are over a row for each shared item, with values as x_ of a and y_ of b.

    Keys are dealt to parts of about PAIRS such rows: ranges of keys, so that keys that stand together meet in one part, or hash buckets where
    ranges would be uneven. A part gets each item's keys of its own and the larger ones as arrays and makes the pairs itself; no row for a pair is
    shuffled. A bucket with too many pairs is divided by the other key. An item of more than LONG keys is several arrays, each of which meets each.
    rows are read three times, so they are written unless they are."""
    rows = kept(rows, "rows")
    given = rows.select(F.col(item).alias("__i"), F.col(key).alias("k"), *(F.col(v).alias(f"v_{v}") for v in values)).where("__i IS NOT NULL AND k IS NOT NULL")
    items = given.groupBy("__i").agg(F.count(F.lit(1)).alias("d"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    total = items.agg(F.max("d").alias("most"), F.sum(F.col("d") * (F.col("d") - 1) / 2).alias("work"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).head()
    one = F.struct("k", *(f"v_{v}" for v in values))
    long = (total.most or 0) > LONG
    if long:
        several = items.where(F.col("d") > LONG).select("__i", "d")
        given = given.join(several, "__i", "left").withColumn("__c", F.coalesce(F.pmod(F.xxhash64("k"), F.ceil(F.col("d") / LONG)), F.lit(0)))
        baskets = written(given.groupBy("__i", "__c").agg(F.sort_array(F.collect_list(one)).alias("l"), F.max("d").alias("d")), "baskets")
        short, parted = baskets.where("d IS NULL").select("l", F.col("l").alias("m")), baskets.where("d IS NOT NULL")
        met = short.unionByName(parted.select("__i", "l").join(parted.select("__i", F.col("l").alias("m")), "__i").select("l", "m"))
        larger = F.coalesce(F.col("d") / 2, F.size("l") - 1 - F.col("pos"))
    else:
        baskets = written(given.groupBy("__i").agg(F.sort_array(F.collect_list(one)).alias("l")).where(F.size("l") > 1).select("l"), "baskets")
        met = baskets.select("l", F.col("l").alias("m"))
        larger = F.size("l") - 1 - F.col("pos")
    n = max(1, min(RANGES, 64 * -(-int(total.work or 0) // PAIRS)))
    hashed = lambda k: F.pmod(F.xxhash64(k), F.lit(n)).cast("int")
    ways = [hashed]
    if isinstance(given.schema["k"].dataType, IntegralType) and total.work:
        width = -(-(int(total.hi) - int(total.lo) + 1) // n)
        apart = lambda k: k.cast("decimal(20,0)") - F.lit(int(total.lo)) if width >= 1 << 40 else k - F.lit(int(total.lo))
        ways.insert(0, lambda k: F.least(F.floor(apart(k) / width).cast("int"), F.lit(n - 1)))  # a quotient may be rounded up to n
    found = []
    for way in ways:
        each = baskets.select("*", F.posexplode("l").alias("pos", "e")).groupBy(way(F.col("e.k")).alias("bucket")).agg(F.sum(larger).cast("long").alias("w"))
        found.append((way, {r.bucket: r.w for r in each.collect()}))  # RANGES rows at most
        if max(found[-1][1].values(), default=0) <= 2 * PAIRS:
            break
    bucket, work = min(found, key=lambda f: max(f[1].values(), default=0))
    first, parts, every = _dealt(work, n)
    split = max(parts) > 1
    part = lambda k: bucket(k) if split else _lookup(first)[bucket(k)]
    # What an explode makes is a column; without it, plans would compute an array anew in each place that names it.
    own = met.select(F.transform("l", lambda e: F.struct(part(e.k).alias("g"), e.alias("e"))).alias("l"), "m").select("l", "m", F.explode(F.array_distinct("l.g")).alias("g"))
    own = own.select("g", F.filter("l", lambda e: e.g == F.col("g"))["e"].alias("x"), "m").select("*", F.explode(F.array(F.col("x")[0]["k"])).alias("least"))
    sent = own.select("g", "x", F.filter("m", lambda e: e.k > F.col("least")).alias("y"))
    if split:
        sent = sent.select("x", "y", _lookup(first)[F.col("g")].alias("p"), _lookup(parts)[F.col("g")].alias("__n")).select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("h"))
        sent = sent.select((F.col("p") + F.col("h")).alias("g"), "x", F.when(F.col("__n") == 1, F.col("y")).otherwise(F.filter("y", lambda e: F.pmod(F.xxhash64(e.k), F.col("__n")) == F.col("h"))).alias("y"))
    sent = sent.where(F.size("y") > 0).select("g", *(F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in "xy" for f in ["k", *(f"v_{v}" for v in values)])).repartitionById(every, "g")
    left = sent.select("*", F.posexplode("x_k").alias("i", "a"))
    both = left.select("*", F.posexplode("y_k").alias("j", "b")).where("a < b")
    made = both.select("g", "a", "b", *(F.col(f"x_v_{v}")[F.col("i")].alias(f"x_{v}") for v in values), *(F.col(f"y_v_{v}")[F.col("j")].alias(f"y_{v}") for v in values))
    return made.groupBy("g", "a", "b").agg(*aggregates).drop("g") if aggregates else made.distinct().drop("g")


def overlaps(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, i, na, nb) of distinct rows: shared items and set sizes, which go with the rows, since there are more pairs than rows."""
    rows = kept(rows.select(key, item), "rows")
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return paired(rows.join(sizes, key), key, item, ["n"], [F.count(F.lit(1)).alias("i"), F.min("x_n").alias("na"), F.min("y_n").alias("nb")])


def jaccard() -> Column:
    return F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))


def set_cosine() -> Column:
    return F.col("i") / (F.sqrt("na") * F.sqrt("nb"))


def pearson(rows: DataFrame, key: str, item: str, value: str, least: int = 3) -> DataFrame:
    """(a, b, n, sim) over common items, means over these alone; no variance gives 0. From sums, so partial before the shuffle."""
    s = paired(rows, key, item, [value], moments(F.col(f"x_{value}"), F.col(f"y_{value}")))
    return correlated(s, least)


def moments(x: Column, y: Column) -> list[Column]:
    """Aggregates n, x, y, xx, yy, xy of a pair's common values."""
    return [F.count(F.lit(1)).alias("n"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * y).alias("xy")]


def correlated(sums: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, n, sim) of moments by pair, where there are enough common values."""
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    cov = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    sim = F.when((vx <= FLAT) | (vy <= FLAT), 0.0).otherwise(cov / F.sqrt(F.greatest(vx, F.lit(FLAT)) * F.greatest(vy, F.lit(FLAT))))
    return sums.where(F.col("n") >= least).select("a", "b", "n", sim.alias("sim"))


def inverse_frequency(rows: DataFrame, key: str, item: str) -> DataFrame:
    """(item, w): ln of the number of keys over those that have the item, of distinct rows; an item that all have weighs nothing."""
    total = rows.agg(F.count_distinct(key).alias("total"))
    held = rows.groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    return held.crossJoin(F.broadcast(total)).select(item, F.log(F.col("total") / F.col("n")).alias("w"))


def pearson_weighted(rows: DataFrame, key: str, item: str, value: str, weights: DataFrame, least: int = 3) -> DataFrame:
    """(a, b, n, sim): as pearson, each common item weighed by weights (item, w)."""
    heavy = rows.join(weights, item).where("w > 0").select(key, item, value, "w")
    x, y, w = F.col(f"x_{value}"), F.col(f"y_{value}"), F.col("x_w")
    sums = [F.sum(w).alias("w"), F.sum(w * x).alias("x"), F.sum(w * y).alias("y"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"), F.sum(w * x * y).alias("xy")]
    s = paired(heavy, key, item, [value, "w"], [F.count(F.lit(1)).alias("n"), *sums])
    vx, vy = F.col("xx") - F.col("x") * F.col("x") / F.col("w"), F.col("yy") - F.col("y") * F.col("y") / F.col("w")
    cov = F.col("xy") - F.col("x") * F.col("y") / F.col("w")
    sim = F.when((vx <= FLAT) | (vy <= FLAT), 0.0).otherwise(cov / F.sqrt(F.greatest(vx, F.lit(FLAT)) * F.greatest(vy, F.lit(FLAT))))
    return s.where(F.col("n") >= least).select("a", "b", "n", sim.alias("sim"))


def pearson_all(rows: DataFrame, key: str, item: str, value: str, least: int = 3) -> DataFrame:
    """As pearson, but deviations are from each key's mean over all its items."""
    mean = rows.groupBy(key).agg(F.avg(value).alias("m"))
    dev = rows.join(mean, key).select(key, item, (F.col(value) - F.col("m")).alias("d"))
    x, y = F.col("x_d"), F.col("y_d")
    s = paired(dev, key, item, ["d"], [F.count(F.lit(1)).alias("n"), F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy")])
    sim = F.when((F.col("xx") <= FLAT) | (F.col("yy") <= FLAT), 0.0).otherwise(F.col("xy") / F.sqrt(F.greatest("xx", F.lit(FLAT)) * F.greatest("yy", F.lit(FLAT))))
    return s.where(F.col("n") >= least).select("a", "b", "n", sim.alias("sim"))


def hash_constants(n: int) -> list[tuple[int, int]]:
    """(a, b) of n universal hash functions, the same on every run."""
    return [((i + 1) * 7919 % 100_003 + 1, (i + 1) * 104_729 % 99_991) for i in range(n)]


def signatures(rows: DataFrame, key: str, value: str, bins: DataFrame, n: int) -> DataFrame:
    """(key, s): the array of least ((a x + b) mod prime) mod bins over the values of a key, for n functions in one pass. bins: one row (bins)."""
    hashed = [F.min(F.pmod(F.pmod(F.col(value) * a + b, F.lit(PRIME)), F.col("bins"))).alias(f"h{i}") for i, (a, b) in enumerate(hash_constants(n))]
    wide = rows.crossJoin(F.broadcast(bins)).groupBy(key).agg(*hashed)
    return wide.select(key, F.array(*(f"h{i}" for i in range(n))).alias("s"))


def minhash(rows: DataFrame, key: str, value: str, bins: DataFrame, n: int) -> DataFrame:
    """(key, h, sig): a row for each of the signatures."""
    return signatures(rows, key, value, bins, n).select(key, F.posexplode("s").alias("h", "sig"))


def agreeing(pairs: DataFrame, signed: DataFrame, key: str) -> DataFrame:
    """Those pairs (a, b, ...) that have a signature in common. signed: (key, s).

    Where pairs are few because their similarity is measured, this takes less than to make all pairs with a signature in common, which are very many."""
    one, two = signed.select(F.col(key).alias("a"), F.col("s").alias("__x")), signed.select(F.col(key).alias("b"), F.col("s").alias("__y"))
    same = F.exists(F.zip_with("__x", "__y", lambda x, y: x == y), lambda e: e)
    return pairs.join(one, "a").join(two, "b").where(same).select(*pairs.columns)


def lsh(signatures: DataFrame, key: str, rows_per_band: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, that agree in all of one band."""
    band = signatures.groupBy(key, F.floor(F.col("h") / rows_per_band).alias("band")).agg(F.array_sort(F.collect_list(F.struct("h", "sig"))).alias("s"))
    return paired(band.select(key, F.struct("band", "s.sig").alias("v")), key, "v", [], [])


def verified(candidates: DataFrame, rows: DataFrame, key: str, item: str) -> DataFrame:
    """(a, b, sim) of candidate pairs, by their exact Jaccard similarity."""
    one, two = rows.select(F.col(key).alias("a"), F.col(item).alias("i")), rows.select(F.col(key).alias("b"), F.col(item).alias("i"))
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    shared = candidates.join(one, "a").join(two, ["b", "i"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("i"))
    sized = shared.join(n.select(F.col(key).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(key).alias("b"), F.col("n").alias("nb")), "b")
    return sized.select("a", "b", jaccard().alias("sim"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair (a, b, sim) in both directions, in one pass over pairs."""
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")
    return pairs.select(turned, "sim").select("p.a", "p.b", "sim")


def rated_alike(test: DataFrame, rated: DataFrame, sims: DataFrame, shared: str, asked: str) -> DataFrame:
    """test (user, item) with the rows of rated (b, shared, ...) that have its shared column and a similarity w with its asked column. Of the two ways to join, the one with fewer rows between."""
    near = kept(both_ways(sims).select(F.col("a").alias(asked), "b", F.col("sim").alias("w")), "near")
    between = lambda t, c: test.join(t.groupBy(c).agg(F.count(F.lit(1)).alias("n")), c).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n
    if between(near, asked) <= between(rated, shared):
        return test.join(near, asked).join(rated, [shared, "b"])
    return test.join(rated, shared).join(near, [asked, "b"])


def predict_item(test: DataFrame, train: DataFrame, sims: DataFrame, n: int = 5) -> DataFrame:
    """test (user, item) -> (user, item, pred): weighted mean of the user's ratings of the n most similar items; else the item's mean; else the mean of item means. train (user, item, stars), a row a pair."""
    near = rated_alike(test, train.select("user", F.col("item").alias("b"), "stars"), sims, "user", "item")
    best = top_k(near, ["user", "item"], [F.desc("w"), F.col("b")], n)
    got = best.groupBy("user", "item").agg(F.sum(F.col("stars") * F.col("w")).alias("u"), F.sum("w").alias("v"))
    mean = train.groupBy("item").agg(F.avg("stars").alias("m"))
    every = mean.agg(F.avg("m").alias("mm"))
    j = test.join(got, ["user", "item"], "left").join(mean, "item", "left").crossJoin(F.broadcast(every))
    return j.select("user", "item", F.coalesce(F.when((F.col("u") != 0) & (F.col("v") != 0), F.col("u") / F.col("v")), "m", "mm").alias("pred"))


def predict_user(test: DataFrame, train: DataFrame, sims: DataFrame, n: int = 5) -> DataFrame:
    """As predict_item, from the n most similar users who rated the item: own mean plus weighted mean of their deviations."""
    mean = train.groupBy("user").agg(F.avg("stars").alias("m"))
    rated = train.join(mean, "user").select(F.col("user").alias("b"), "item", (F.col("stars") - F.col("m")).alias("dev"))
    near = rated_alike(test, rated, sims, "item", "user")
    best = top_k(near, ["user", "item"], [F.desc("w"), F.col("b")], n)
    got = best.groupBy("user", "item").agg(F.sum(F.col("dev") * F.col("w")).alias("u"), F.sum("w").alias("v"))
    every = mean.agg(F.avg("m").alias("mm"))
    j = test.join(got, ["user", "item"], "left").join(mean, "user", "left").crossJoin(F.broadcast(every))
    return j.select("user", "item", F.coalesce(F.col("m") + F.when((F.col("u") != 0) & (F.col("v") != 0), F.col("u") / F.col("v")), "m", "mm").alias("pred"))


def shingle_rows(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) without repeats, in the order of shingles, which are numbered from 0: one number stands for the same k characters in all texts."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    m = len(chars) - k + 1
    if m < 1:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    letters, chars = np.unique(chars, return_inverse=True)
    gram = chars[:m].astype(np.int64)
    for j in range(1, k):
        if int(gram.max() + 1) * len(letters) >= 1 << 62:
            gram = np.unique(gram, return_inverse=True)[1]
        gram = gram * len(letters) + chars[j : m + j]
    inside = row[:m] == row[k - 1 :]
    gram = np.unique(gram[inside], return_inverse=True)[1]
    both = np.unique(gram * len(texts) + row[:m][inside])
    return both % len(texts), both // len(texts)


def shingle_overlaps(a: list[str], b: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix of shared k-character shingles of each text of a with each of b, and the set sizes of both."""
    row, gram = shingle_rows(a + b, k)
    sizes = np.bincount(row, minlength=len(a) + len(b))
    left = row < len(a)
    n = int(gram[-1]) + 1 if len(gram) else 0
    shared = (np.bincount(gram[left], minlength=n) > 0) & (np.bincount(gram[~left], minlength=n) > 0)
    column, kept = np.cumsum(shared) - 1, shared[gram]
    row, gram = row[kept], column[gram[kept]]
    out = np.zeros((len(a), len(b)))
    for lo in range(0, int(shared.sum()), COLUMNS):
        begin, end = np.searchsorted(gram, (lo, lo + COLUMNS))
        marks = np.zeros((len(a) + len(b), COLUMNS), dtype=np.float32)
        marks[row[begin:end], gram[begin:end] - lo] = 1
        out += marks[: len(a)] @ marks[len(a) :].T
    return out, sizes[: len(a)], sizes[len(a) :]


def similar_texts(texts: DataFrame, k: int, least: float) -> DataFrame:
    """(a, b, sim), a < b: every pair of texts (id long, text) whose sets of k-character shingles have a Jaccard similarity of least or more.

    Sets of a pair differ in size by a factor of 1 / least at most, so blocks of texts meet those of near size classes only; a
    task counts the overlaps of two blocks as matrices. Nothing is left out, so the work and the result grow with the square
    of the texts of like size."""
    ship(texts.sparkSession)
    step = math.log(1 / least) / STEPS

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(size=[int(math.log(len(shingle_rows([t], k)[0])) / step) for t in f.text])

    sized = texts.where(F.length("text") >= k).select("id", "text").mapInPandas(measure, "id long, text string, size int")
    blocks, first = {}, 0
    for size, n in sorted((r["size"], r["count"]) for r in sized.groupBy("size").count().collect()):  # size classes are few
        blocks[size] = (first, -(-n // SIDE))
        first += blocks[size][1]
    # One class more than the bound allows, for logarithms that fall on a border.
    near = [(x, y) for s, (f, m) in blocks.items() for t, (g, o) in blocks.items() if s <= t <= s + STEPS + 1 for x in range(f, f + m) for y in range(g, g + o) if x <= y]
    meets = sorted({(z, x, y) for x, y in near for z in (x, y)})
    spark = texts.sparkSession
    table = spark.createDataFrame([(s, f, m) for s, (f, m) in blocks.items()], "size int, first int, m int")
    placed = sized.join(F.broadcast(table), "size").select("id", "text", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("m"))).cast("int").alias("block"))
    dealt = placed.join(F.broadcast(spark.createDataFrame(pd.DataFrame(meets, columns=["block", "x", "y"]).astype("int32"), "block int, x int, y int")), "block")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = key
        a, b = pdf[pdf.block == x], pdf[pdf.block == y]
        ia, ib = a.id.to_numpy(), b.id.to_numpy()
        shared, na, nb = shingle_overlaps(a.text.tolist(), b.text.tolist(), k)
        sim = shared / (na[:, None] + nb[None] - shared)
        hit = sim >= least
        if x == y:
            hit &= ia[:, None] < ib[None]
        i, j = np.nonzero(hit)
        return pd.DataFrame({"a": np.minimum(ia[i], ib[j]), "b": np.maximum(ia[i], ib[j]), "sim": sim[i, j]})

    return dealt.groupBy("x", "y").applyInPandas(run, "a long, b long, sim double")
