"""Relational operators that Spark has no word for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def division(dividend: DataFrame, divisor: DataFrame, key: str, item: str) -> DataFrame:
    """Keys of dividend (key, item) that stand with every item of divisor (item). An empty divisor gives every key."""
    wanted = divisor.select(item).where(F.col(item).isNotNull()).distinct()
    total = wanted.agg(F.count(F.lit(1)).alias("__total"))
    met = dividend.select(key, item).distinct().join(wanted.withColumn("__hit", F.lit(1)), item, "left")
    counted = met.groupBy(key).agg(F.count("__hit").alias("__n"))
    return counted.crossJoin(F.broadcast(total)).where("__n = __total").select(key)  # total is one row


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "r") -> DataFrame:
    """The first k rows of each group in a total order, with their rank from 1. Spark cuts each task's rows to k before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def last_per_group(df: DataFrame, group: str, order: Column, *columns: str) -> DataFrame:
    """columns of the row of each group that comes last; an aggregate with partial sums, no sort."""
    picked = df.groupBy(group).agg(F.max_by(F.struct(*columns), order).alias("__r"))
    return picked.select(group, *(F.col(f"__r.{c}").alias(c) for c in columns))


def most_common(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value of a column, the least of equals."""
    return df.groupBy(column).count().orderBy(F.desc("count"), column).limit(1).select(column)


def check_unique(df: DataFrame, *key: str) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(*key).count().where("count > 1")


def check_foreign_key(df: DataFrame, column: str, other: DataFrame, target: str) -> DataFrame:
    """Rows whose value is in no row of other; nulls refer to nothing and pass."""
    return df.where(F.col(column).isNotNull()).join(other.select(F.col(target).alias(column)), column, "left_anti")


def check_range(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    return df.where(~F.col(column).between(low, high))


def check_in(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(~F.col(column).isin(values))


def matmul(left: DataFrame, right: DataFrame) -> DataFrame:
    """Product of matrices of triples (i, j, v); an absent cell is 0."""
    a, b = left.select("i", F.col("j").alias("k"), F.col("v").alias("x")), right.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return a.join(b, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def matvec(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """Product of a matrix (i, j, v) and a vector (j, v)."""
    return matrix.join(vector.select("j", F.col("v").alias("w")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def repartition_by_digits(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows dealt to n partitions by the digit sum of the key."""
    return df.withColumn("part", digit_sum_partition(F.col(key), n)).repartition(n, "part")


def digit_sum_partition(key: Column, n: int) -> Column:
    digits = F.filter(F.split(key.cast("string"), ""), lambda c: c.between("0", "9"))
    return F.pmod(F.aggregate(digits, F.lit(0), lambda acc, c: acc + c.cast("int")), F.lit(n)).cast("int")


def partition_sizes(df: DataFrame) -> DataFrame:
    """(partition, n) as the rows lie now."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("n"))
