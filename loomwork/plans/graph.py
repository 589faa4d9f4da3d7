"""Link graph and supplier graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as ops
from ..operators.relational import top_k
from ..sources.tables import PAIRS, supplier_pairs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _edges(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    """Each supplier with the k suppliers it shares most orders with, in both directions."""
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")
    both = supplier_pairs(spark, d).select(turned, "n").select(F.col("p.a").alias("src"), F.col("p.b").alias("dst"), "n")
    return ops.undirected(top_k(both, ["src"], [F.desc("n"), F.col("dst")], k))


_G = f"""{PAIRS}, bo AS (SELECT a AS src, b AS dst, n FROM p UNION ALL SELECT b, a, n FROM p), tk AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS r FROM bo) WHERE r <= 5),
g AS MATERIALIZED (SELECT src, dst FROM tk UNION SELECT dst, src FROM tk), dg AS (SELECT src AS node, count(*) AS degree FROM g GROUP BY 1)"""
HREF = 'href="([^"]*)"'
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, own, url, target, host): own host, and each href resolved against the page's host."""
    pages = table(spark, d, "pages").select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("own"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    base = F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1)
    target = F.when(F.col("href").rlike("^[a-z]+://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(base, "href")).otherwise(F.concat(base, F.lit("/"), "href"))
    return pages.withColumn("target", target).withColumn("host", F.regexp_extract("target", r"^[a-z]+://([^/?#]*)", 1))


LINKS = """lk AS (SELECT page_id, url, own, target, regexp_extract(target, '^[a-z]+://([^/?#]*)', 1) AS host FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS own,
  CASE WHEN regexp_matches(href, '^[a-z]+://') THEN href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href ELSE regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' || href END AS target
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)))"""


@query(f"WITH {LINKS} SELECT DISTINCT page_id, host FROM lk")
def link_edges(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("page_id", "host").distinct()


@query(f"WITH {_G} SELECT node, degree FROM dg")
def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return ops.degrees(_edges(spark, d))


@query(f"WITH {_G} SELECT node AS i, node AS j, degree AS v FROM dg UNION ALL SELECT src, dst, CAST(-1 AS BIGINT) FROM g")
def laplacian_entries(spark: SparkSession, d: str) -> DataFrame:
    return ops.laplacian(_edges(spark, d))


@query(f"""WITH {_G}, s AS (SELECT s_suppkey AS node, s_nationkey AS grp FROM supplier), m AS (SELECT count(*) AS m FROM g), k AS (SELECT grp, sum(degree) AS k FROM dg JOIN s USING (node) GROUP BY 1),
e AS (SELECT x.grp, count(*) FILTER (x.grp = y.grp) AS e FROM g JOIN s x ON x.node = src JOIN s y ON y.node = dst GROUP BY 1) SELECT round(sum(e / m - (k / m) * (k / m)), 6) AS q FROM k JOIN e USING (grp) CROSS JOIN m""")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    """Of the supplier graph divided by nation."""
    groups = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("grp"))
    return ops.modularity(_edges(spark, d), groups).select(F.round("q", 6).alias("q"))


def _unrolled(start: str, step: str, rounds: int, last: str) -> str:
    return ", ".join([f"x0 AS ({start})", *(f"x{t} AS MATERIALIZED ({step.format(x=f'x{t - 1}')})" for t in range(1, rounds + 1))]) + f" {last.format(x=f'x{rounds}')}"


@query(f"WITH {_G}, " + _unrolled("SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM dg) AS pr FROM dg", "SELECT dst AS node, 0.15 / (SELECT count(*) FROM dg) + 0.85 * sum(pr / degree) AS pr FROM g JOIN {x} ON {x}.node = src JOIN dg ON dg.node = src GROUP BY 1", 10, "SELECT node, round(pr, 6) AS pr FROM {x}"))
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return ops.pagerank(_edges(spark, d)).select("node", F.round("pr", 6).alias("pr"))


def _fixed_sql(start: str, step: str, value: str) -> str:
    """To the fixed point: step adds rows to x (node, value) till it has no new one; the least value of a node stays."""
    return f"WITH RECURSIVE {_G}, x AS ({start} UNION {step}) SELECT node, min({value}) AS {value} FROM x GROUP BY 1"


# A least path has fewer edges than there are nodes, each of weight 16 at most.
@query(_fixed_sql("SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS d", "SELECT dst, d + 1 FROM x JOIN g ON src = node WHERE d + 1 < (SELECT count(*) FROM dg)", "d"))
def bfs_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels from supplier 0."""
    return ops.distances(_edges(spark, d), spark.createDataFrame([(0,)], "node long"))


@query(_fixed_sql("SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS d", "SELECT dst, d + 10 + (src + dst) % 7 FROM x JOIN g ON src = node WHERE d + 10 + (src + dst) % 7 < 16 * (SELECT count(*) FROM dg)", "d"))
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d).withColumn("w", 10 + (F.col("src") + F.col("dst")) % 7)
    return ops.distances(edges, spark.createDataFrame([(0,)], "node long"), weight="w")


@query(_fixed_sql("SELECT node, node AS component FROM dg", "SELECT dst, component FROM x JOIN g ON src = node", "component"))
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return ops.components(_edges(spark, d))
