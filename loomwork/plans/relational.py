"""Scans, joins, aggregates, sets and sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import relational as ops
from ..sources.tables import REVIEWS, categories, reviews, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def count_n() -> F.Column:
    return F.count(F.lit(1)).alias("n")


CATEGORY = "c AS (SELECT * FROM (SELECT p_partkey AS business_id, trim(unnest(string_split_regex(p_name, ',| '))) AS category FROM part) WHERE category <> '')"


@query(f"WITH {CATEGORY} SELECT business_id, category FROM c")
def explode_categories(spark: SparkSession, d: str) -> DataFrame:
    return categories(spark, d)


def _category_stars(spark: SparkSession, d: str) -> DataFrame:
    # ratings are summed by business before the join, so the larger side is shuffled once, as partial sums
    by_business = reviews(spark, d).groupBy("business_id").agg(F.sum("stars").alias("s"), count_n())
    joined = categories(spark, d).join(by_business, "business_id")
    return joined.groupBy("category").agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("avg_exact"))


@query(f"WITH {REVIEWS}, {CATEGORY} SELECT category, count(*) AS n, round(avg(stars), 6) AS avg_stars FROM r JOIN c USING (business_id) GROUP BY 1")
def join_inner_category_avg(spark: SparkSession, d: str) -> DataFrame:
    return _category_stars(spark, d).select("category", "n", F.round("avg_exact", 6).alias("avg_stars"))


@query(f"WITH {REVIEWS}, {CATEGORY} SELECT category, round(a, 6) AS avg_stars FROM (SELECT category, sum(stars) / count(*) AS a FROM r JOIN c USING (business_id) GROUP BY 1 ORDER BY a DESC, category LIMIT 10)")
def category_avg_topn(spark: SparkSession, d: str, n: int = 10) -> DataFrame:
    """Sorted by the exact average, then rounded."""
    top = _category_stars(spark, d).orderBy(F.desc("avg_exact"), "category").limit(n)
    return top.select("category", F.round("avg_exact", 6).alias("avg_stars"))


@query(f"WITH {REVIEWS} SELECT count(*) AS n FROM r")
def count_all(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).agg(count_n())


@query(f"WITH {REVIEWS} SELECT count(DISTINCT user_id) AS n FROM r")
def count_distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).agg(F.count_distinct("user_id").alias("n"))


@query(f"WITH {REVIEWS} SELECT count(*) AS n FROM r WHERE year(date) = 1997")
def filter_year_count(spark: SparkSession, d: str, year: int = 1997) -> DataFrame:
    return reviews(spark, d).where((F.col("date") >= f"{year}-01-01") & (F.col("date") < f"{year + 1}-01-01")).agg(count_n())


@query(f"WITH {REVIEWS} SELECT user_id, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def top_m_users(spark: SparkSession, d: str, m: int = 10) -> DataFrame:
    return reviews(spark, d).groupBy("user_id").agg(count_n()).orderBy(F.desc("n"), "user_id").limit(m)


@query(f"WITH {REVIEWS} SELECT business_id, count(*) AS n FROM r GROUP BY 1 HAVING count(*) > 30")
def busy_businesses(spark: SparkSession, d: str, n: int = 30) -> DataFrame:
    return reviews(spark, d).groupBy("business_id").agg(count_n()).where(F.col("n") > n)


@query(f"WITH {REVIEWS} SELECT CAST(list_sum(list_transform(string_split(CAST(business_id AS VARCHAR), ''), lambda x: CAST(x AS INTEGER))) % 8 AS INTEGER) AS part, count(*) AS n FROM r GROUP BY 1")
def custom_partition_counts(spark: SparkSession, d: str, n: int = 8) -> DataFrame:
    return reviews(spark, d).groupBy(ops.digit_sum_partition(F.col("business_id"), n).alias("part")).agg(count_n())


@query("SELECT c_custkey AS custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_left_outer(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(count_n())
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).join(counts, "custkey", "left").select("custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey AS custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_left_semi(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).join(orders, "custkey", "left_semi")


@query("SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_left_anti(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).join(orders, "custkey", "left_anti")


@query("SELECT c_custkey AS custkey, coalesce(n_name, 'none') AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary lookup with a default. Nations are a fixed table of 25 rows."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    joined = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select(F.col("c_custkey").alias("custkey"), F.coalesce("n_name", F.lit("none")).alias("nation"))


@query("SELECT a.r_name AS a, b.r_name AS b FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def join_self_theta(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region")
    a, b = r.select(F.col("r_regionkey").alias("i"), F.col("r_name").alias("a")), r.select(F.col("r_regionkey").alias("j"), F.col("r_name").alias("b"))
    return a.join(b, F.col("i") < F.col("j")).select("a", "b")


@query("SELECT r_name AS region, n_name AS nation FROM region CROSS JOIN nation")
def join_cross(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(F.col("r_name").alias("region")).crossJoin(table(spark, d, "nation").select(F.col("n_name").alias("nation")))


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_nationkey < r_regionkey * 5")
def join_theta(spark: SparkSession, d: str) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, F.col("n_nationkey") < F.col("r_regionkey") * 5).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("SELECT nationkey, count(*) AS n FROM (SELECT c_nationkey AS nationkey, c_custkey FROM customer) NATURAL JOIN (SELECT n_nationkey AS nationkey, n_name FROM nation) GROUP BY 1")
def join_natural(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), "c_custkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name")
    shared = [x for x in c.columns if x in n.columns]
    return c.join(n, shared).groupBy("nationkey").agg(count_n())


@query("SELECT o_custkey AS custkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def relational_division(spark: SparkSession, d: str) -> DataFrame:
    """Customers with orders of every priority."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderpriority")
    return ops.division(o, o.select("o_orderpriority"), "custkey", "o_orderpriority")


@query("SELECT o_orderkey AS key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7'))")
def in_subquery_nested(spark: SparkSession, d: str) -> DataFrame:
    for name in ("orders", "customer", "lineitem", "part"):
        table(spark, d, name).createOrReplaceTempView(f"q_{name}")
    return spark.sql("""SELECT o_orderkey AS key FROM q_orders
        WHERE o_custkey IN (SELECT c_custkey FROM q_customer WHERE c_acctbal < 0)
          AND o_orderkey IN (SELECT l_orderkey FROM q_lineitem WHERE l_partkey IN (SELECT p_partkey FROM q_part WHERE p_brand = 'Brand#7'))""")


@query("SELECT l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > (SELECT avg(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey))")
def having_scalar_subquery(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(count_n())
    mean = counts.agg(F.avg("n").alias("m"))  # one row
    return counts.crossJoin(F.broadcast(mean)).where("n > m").select("key", "n")


@query("""SELECT 'lineitems' AS metric, count(*) AS n FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-05-31'
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-05-31'
UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-05-31'""")
def between_counts(spark: SparkSession, d: str, low: str = "1996-03-01", high: str = "1996-05-31") -> DataFrame:
    """Bounds are parameters of the statement."""
    text = """SELECT 'lineitems' AS metric, count(*) AS n FROM {l} WHERE l_shipdate BETWEEN to_timestamp_ntz(:low) AND to_timestamp_ntz(:high)
        UNION ALL SELECT 'orders', count(*) FROM {o} WHERE o_orderdate BETWEEN to_timestamp_ntz(:low) AND to_timestamp_ntz(:high)
        UNION ALL SELECT 'customers', count(DISTINCT o_custkey) FROM {o} WHERE o_orderdate BETWEEN to_timestamp_ntz(:low) AND to_timestamp_ntz(:high)"""
    return spark.sql(text, args={"low": low, "high": high}, l=table(spark, d, "lineitem"), o=table(spark, d, "orders"))


@query("SELECT user_id % 10 AS grp, count(*) AS n FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY 1) WHERE t = 'error' GROUP BY 1")
def latest_status_floor(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last event is an error, by group."""
    last = ops.last_per_group(table(spark, d, "events"), "user_id", F.struct("ts", "event_id"), "event_type")
    return last.where("event_type = 'error'").groupBy((F.col("user_id") % 10).alias("grp")).agg(count_n())


@query("SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1")
def most_common_value(spark: SparkSession, d: str) -> DataFrame:
    return ops.most_common(table(spark, d, "events"), "event_type")


def _nations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("nationkey"))
    return c, table(spark, d, "supplier").where("s_acctbal < 3000").select(F.col("s_nationkey").alias("nationkey"))


_C, _S = "SELECT c_nationkey AS nationkey FROM customer WHERE c_acctbal > 5000", "SELECT s_nationkey AS nationkey FROM supplier WHERE s_acctbal < 3000"


@query(f"{_C} UNION {_S}")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    a, b = _nations(spark, d)
    return a.union(b).distinct()


@query(f"{_C} UNION ALL {_S}")
def set_union_all(spark: SparkSession, d: str) -> DataFrame:
    a, b = _nations(spark, d)
    return a.union(b)


@query(f"{_C} INTERSECT {_S}")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = _nations(spark, d)
    return a.intersect(b)


@query(f"{_C} EXCEPT {_S}")
def set_difference(spark: SparkSession, d: str) -> DataFrame:
    a, b = _nations(spark, d)
    return a.subtract(b)


@query("SELECT DISTINCT p_brand, p_type FROM part")
def project_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


BRANDS = f"{REVIEWS}, b AS (SELECT user_id AS u, list(DISTINCT p_brand) AS s FROM r JOIN part ON p_partkey = business_id GROUP BY 1)"


@query(f"WITH {BRANDS} SELECT x.u, CAST(len(list_distinct(x.s || y.s)) AS BIGINT) AS n_union, CAST(len(list_intersect(x.s, y.s)) AS BIGINT) AS n_inter, CAST(len(x.s) - len(list_intersect(x.s, y.s)) AS BIGINT) AS n_diff FROM b x JOIN b y ON y.u = x.u + 1")
def array_set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Brands of user u against those of user u + 1."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("business_id"), "p_brand")
    sets = reviews(spark, d).join(part, "business_id").groupBy(F.col("user_id").alias("u")).agg(F.collect_set("p_brand").alias("s"))
    nxt = sets.select((F.col("u") - 1).alias("u"), F.col("s").alias("t"))
    size = lambda c: F.size(c).cast("long")
    return sets.join(nxt, "u").select("u", size(F.array_union("s", "t")).alias("n_union"), size(F.array_intersect("s", "t")).alias("n_inter"), size(F.array_except("s", "t")).alias("n_diff"))


@query(f"WITH {REVIEWS} SELECT business_id, count(*) AS n FROM r GROUP BY 1")
def group_count(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).groupBy("business_id").agg(count_n())


@query(f"WITH {REVIEWS} SELECT user_id, round(avg(stars), 6) AS avg_stars FROM r GROUP BY 1")
def group_avg(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).groupBy("user_id").agg(F.round(F.avg("stars"), 6).alias("avg_stars"))


@query(f"WITH {REVIEWS} SELECT round(avg(a), 6) AS mean FROM (SELECT avg(stars) AS a FROM r GROUP BY user_id)")
def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).groupBy("user_id").agg(F.avg("stars").alias("a")).agg(F.round(F.avg("a"), 6).alias("mean"))


@query("SELECT l_orderkey AS order_id, list_aggregate(list_sort(list(DISTINCT p_brand)), 'string_agg', ',') AS items FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def collect_set_basket(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    sets = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_set("p_brand").alias("s"))
    return sets.select("order_id", F.array_join(F.array_sort("s"), ",").alias("items"))


@query("SELECT label, CAST(dim - 1 AS INTEGER) AS dim, count(*) AS n, round(sum(v), 6) AS sum, round(sum(v * v), 6) AS sumsq FROM (SELECT label, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2")
def vector_sum_sumsq(spark: SparkSession, d: str) -> DataFrame:
    """Summaries (N, SUM, SUMSQ) of labelled vectors, by dimension."""
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "e")).withColumn("v", F.col("e").cast("double"))
    return x.groupBy("label", "dim").agg(count_n(), F.round(F.sum("v"), 6).alias("sum"), F.round(F.sum(F.col("v") * F.col("v")), 6).alias("sumsq"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def last_per_group(spark: SparkSession, d: str) -> DataFrame:
    return ops.last_per_group(table(spark, d, "events"), "user_id", F.struct("ts", "event_id"), "event_id", "value")


@query(f"WITH {REVIEWS} SELECT DISTINCT user_id, business_id FROM r")
def distinct_pairs(spark: SparkSession, d: str) -> DataFrame:
    return reviews(spark, d).select("user_id", "business_id").distinct()


def _cells(df: DataFrame, i: str, j: str) -> DataFrame:
    return df.groupBy(F.col(i).alias("i"), F.col(j).alias("j")).agg(F.count(F.lit(1)).alias("v"))


@query("SELECT i, CAST(sum(m.v * w.v) AS BIGINT) AS v FROM (SELECT c_nationkey AS i, n_regionkey AS j, count(*) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) m JOIN (SELECT n_regionkey AS j, count(*) AS v FROM nation GROUP BY 1) w USING (j) GROUP BY 1")
def matvec(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    m = _cells(table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_nationkey", "n_regionkey")
    return ops.matvec(m, nation.groupBy(F.col("n_regionkey").alias("j")).agg(F.count(F.lit(1)).alias("v"))).select("i", F.col("v").cast("long").alias("v"))


@query("WITH a AS (SELECT c_nationkey AS i, n_regionkey AS j, count(*) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), b AS (SELECT n_regionkey AS i, s_nationkey AS j, count(*) AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2) SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM a JOIN b ON a.j = b.i GROUP BY 1, 2")
def matmul(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    a = _cells(table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_nationkey", "n_regionkey")
    b = _cells(table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "n_regionkey", "s_nationkey")
    return ops.matmul(a, b).select("i", "j", F.col("v").cast("long").alias("v"))


@query("SELECT brand, part, r FROM (SELECT p_brand AS brand, p_partkey AS part, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY round(sum(l_extendedprice), 2) DESC, p_partkey) AS INTEGER) AS r FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) WHERE r <= 3")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    """Three parts of each brand with the largest spend."""
    spend = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.round(F.sum("l_extendedprice"), 2).alias("s"))
    brand = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    return ops.top_k(spend.join(brand, "part"), ["brand"], [F.desc("s"), F.col("part")], 3).select("brand", "part", "r")


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS s FROM events GROUP BY 1")
def scan_json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(k).alias("s"))


def _hops(spark: SparkSession, d: str) -> DataFrame:
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    n = table(spark, d, "nation").select(name("r", "n_regionkey").alias("a"), name("n", "n_nationkey").alias("b"))
    c = table(spark, d, "customer").select(name("n", "c_nationkey").alias("a"), name("c", "c_custkey").alias("b"))
    return n.unionByName(c)


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
t AS (SELECT a, b, 1 AS d FROM e UNION SELECT t.a, e.b, t.d + 1 FROM t JOIN e ON e.a = t.b WHERE t.d < 3) SELECT a, b, CAST(min(d) AS INTEGER) AS d FROM t GROUP BY 1, 2""")
def transitive_closure(spark: SparkSession, d: str, hops: int = 3) -> DataFrame:
    """Pairs within three hops of region, nation, customer, and the least number of hops."""
    edges = _hops(spark, d)
    step = edges.select("a", "b", F.lit(1).alias("d"))
    every = step
    for k in range(2, hops + 1):
        step = step.select("a", F.col("b").alias("m")).join(edges.select(F.col("a").alias("m"), "b"), "m").select("a", "b", F.lit(k).alias("d")).distinct()
        every = every.unionByName(step)
    return every.groupBy("a", "b").agg(F.min("d").alias("d"))


@query(f"WITH {REVIEWS} SELECT user_id, business_id, stars, CAST(row_number() OVER (PARTITION BY user_id ORDER BY stars DESC, business_id, order_id) AS INTEGER) AS pos FROM r")
def rank_position(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("stars"), "business_id", "order_id")
    return reviews(spark, d).withColumn("pos", F.row_number().over(w)).select("user_id", "business_id", "stars", "pos")
