"""Frequent itemsets level by level, rules, and the bucket filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, written


def baskets(df: DataFrame, key: str, item: str, more_than: int = 0) -> DataFrame:
    """(key, items): the sorted set of each key with more than so many items."""
    sets = df.groupBy(key).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return sets.where(F.size("items") > more_than)


def grouped(rows: DataFrame) -> DataFrame:
    """(id, items, m, void): the different sets of items of rows (key, item) and how many keys have each, written. What all keys would be asked is asked of these.
    The rows without a key are a set of their own, which is void: its items count, its keys and pairs do not."""
    sets = rows.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("item")))["item"].alias("items"))
    return written(sets.groupBy("items", F.col("key").isNull().alias("void")).agg(F.count(F.lit(1)).alias("m")).withColumn("id", F.monotonically_increasing_id()), "sets")


def _total(sets: DataFrame) -> DataFrame:
    return sets.agg(F.coalesce(F.sum(F.when(~F.col("void"), F.col("m"))), F.lit(0)).alias("total"))


def least_count(sets: DataFrame, share: float | None, support: int | None = None) -> DataFrame:
    """One row (least): the count that a frequent set needs."""
    if share is None:
        return sets.sparkSession.range(1).select(F.lit(support).alias("least"))
    return _total(sets).select((F.col("total") * share).alias("least"))


def _kept(found: DataFrame, least: DataFrame) -> DataFrame:
    """(items, n) of found (items, m) rows that are enough. Counts are partial before the shuffle."""
    counts = found.groupBy("items").agg(F.sum("m").alias("n"))
    return counts.crossJoin(F.broadcast(least)).where(F.col("n") >= F.col("least")).select("items", "n")


def candidates(level: DataFrame, size: int) -> DataFrame:
    """(items): sets of one item more than those of level (items of size - 1), each of whose parts of one item less is in level. Two sets that
    agree but in their last item make one; of its parts these two are known, the others are looked up."""
    prefix = F.slice("items", 1, size - 2)
    one = level.select(prefix.alias("p"), F.element_at("items", -1).alias("x"))
    two = level.select(prefix.alias("p"), F.element_at("items", -1).alias("y"))
    made = one.join(two, "p").where("x < y").select(F.concat("p", F.array("x", "y")).alias("items"))
    for drop in range(1, size - 1):
        part = F.concat(F.slice("items", 1, drop - 1), F.slice("items", drop + 1, size - drop))
        made = made.withColumn("part", part).join(level.select(F.col("items").alias("part")), "part", "left_semi").select("items")
    return made


def apriori(rows: DataFrame, share: float | None = None, support: int | None = None, most: int | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of distinct rows (key, item), the frequent itemsets (items, n) of each size from 1, up to size most or till none is left, and
    the candidates (items) of each size."""
    return of_sets(grouped(rows), share, support, most)


def of_sets(sets: DataFrame, share: float | None = None, support: int | None = None, most: int | None = None) -> tuple[list[DataFrame], list[DataFrame]]:
    """As apriori, of sets as grouped makes them. Rows are read once to make those, and equal baskets are one from then on.

    A basket is never unfolded into subsets. What a basket holds of one size, rows (id, items), meets the candidates by all
    items but the last, and the candidate's last item is looked up in the basket; only candidates that stand in a basket are rows.
    Each size is written in the shared folder, as the next one reads it three times."""
    least = written(least_count(sets, share, support), "least")
    each = sets.select("id", F.explode("items").alias("item"), "m", "void")
    levels, tried = [written(_kept(each.select(F.array("item").alias("items"), "m"), least), "level")], [each.select(F.array("item").alias("items")).distinct()]
    inside = each.where("NOT void").join(levels[0].select(F.col("items")[0].alias("item")), "item", "left_semi").select("id", "item", "m")
    held, size, tables = inside.select("id", F.array("item").alias("items")), 1, []
    while (most is None or size < most) and not levels[-1].isEmpty():
        size += 1
        asked = written(candidates(levels[-1], size), "candidates")
        by_prefix = asked.select(F.slice("items", 1, size - 1).alias("items"), F.element_at("items", -1).alias("item"))
        grown = held.join(by_prefix, "items").join(inside, ["id", "item"]).select("id", F.concat("items", F.array("item")).alias("items"), "m")
        grown = written(grown, "held")
        levels.append(written(_kept(grown, least), "level"))
        tried.append(asked)
        held = grown.join(levels[-1].select("items"), "items", "left_semi").select("id", "items")
        tables.append(grown)
        discard(*tables[:-1])
        tables = tables[-1:]
    discard(*tables, least)
    return levels, tried


def unfolded(sets: DataFrame) -> DataFrame:
    """Rows (key, item) of baskets (key, items), whatever the key's name."""
    return sets.select(F.col(sets.columns[0]).alias("key"), F.explode("items").alias("item"))


def frequent(sets: DataFrame, share: float | None = None, support: int | None = None, size: int = 1) -> DataFrame:
    """(items, n) of itemsets of this size in at least share of all baskets (key, items), or support baskets."""
    levels, _ = apriori(unfolded(sets), share, support, size)
    return levels[size - 1] if len(levels) >= size else levels[-1].limit(0)


def counted(sets: DataFrame, wanted: list[DataFrame]) -> list[DataFrame]:
    """(items, n) of wanted sets (items) of sizes 1, 2, ... in sets as grouped makes them. Every set's items but the last are wanted one size before."""
    rows = sets.select("id", F.explode("items").alias("item"), "m", "void")
    held, out = None, []
    for size, asked in enumerate(wanted, 1):
        if size == 1:
            held = rows.join(asked.select(F.col("items")[0].alias("item")), "item", "left_semi").select("id", F.array("item").alias("items"), "m", "void")
        else:
            by_prefix = asked.select(F.slice("items", 1, size - 1).alias("items"), F.element_at("items", -1).alias("item"))
            held = held.where("NOT void").select("id", "items").join(by_prefix, "items").join(rows, ["id", "item"]).select("id", F.concat("items", F.array("item")).alias("items"), "m", "void")
        held = written(held, "held")
        out.append(held.groupBy("items").agg(F.sum("m").alias("n")))
    return out


def rules(pairs: DataFrame, items: DataFrame, total: DataFrame) -> DataFrame:
    """(a, b, support, conf, interest) in both directions. interest is signed: confidence less the share of b. pairs (a, b, n), items (item, n), total one row."""
    both = pairs.select("a", "b", "n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    left, right = items.select(F.col("item").alias("a"), F.col("n").alias("na")), items.select(F.col("item").alias("b"), F.col("n").alias("nb"))
    j = both.join(left, "a").join(right, "b").crossJoin(F.broadcast(total))
    return j.select("a", "b", F.col("n").alias("support"), (F.col("n") / F.col("na")).alias("conf"), (F.col("n") / F.col("na") - F.col("nb") / F.col("total")).alias("interest"))


def pcy_pairs(rows: DataFrame, share: float, buckets: int, total: DataFrame) -> DataFrame:
    """(a, b, n) of rows (key, item), item a number: pairs count only if both items and their bucket (7a + b) mod buckets are frequent."""
    limit = F.col("total") * share
    ok = rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") >= limit).select("item")
    one, two = rows.select("key", F.col("item").alias("a")), rows.select("key", F.col("item").alias("b"))
    pairs = one.join(two, "key").where("a < b").withColumn("h", F.pmod(F.col("a") * 7 + F.col("b"), F.lit(buckets)))
    full = pairs.groupBy("h").agg(F.count(F.lit(1)).alias("m")).crossJoin(F.broadcast(total)).where(F.col("m") >= limit).select("h")
    good = pairs.join(F.broadcast(full), "h", "left_semi")  # buckets rows at most
    good = good.join(ok.withColumnRenamed("item", "a"), "a", "left_semi").join(ok.withColumnRenamed("item", "b"), "b", "left_semi")
    return good.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).where(F.col("n") >= limit).select("a", "b", "n")
