"""Time series, geometry and crawl reports."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import geo, series
from ..operators.relational import last_per_group
from ..shipping import ship
from ..sources.sinks import long_report
from ..sources.tables import table
from .graph import LINKS, _links

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_D = "d AS (SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1, 2)"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    """Days as text, which all readers of a result agree on."""
    return series.daily(table(spark, d, "events"), "event_type", "ts").withColumn("day", F.col("day").cast("string"))


def _day_window():
    return Window.partitionBy("event_type").orderBy("day")


@query(f"WITH {_D} SELECT event_type, day, CAST(n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS DOUBLE) AS v FROM d")
def ts_diff(spark: SparkSession, d: str) -> DataFrame:
    return _daily(spark, d).select("event_type", "day", (F.col("n") - F.lag("n").over(_day_window())).cast("double").alias("v"))


def _gauss_sql() -> str:
    import math

    terms = [(k, math.exp(-k * k / 8)) for k in range(-3, 4)]
    at = lambda k: f"lead(v, {k}) OVER w" if k > 0 else f"lag(v, {-k}) OVER w" if k else "v"
    num = " + ".join(f"coalesce({at(k)} * {w!r}, 0)" for k, w in terms)
    den = " + ".join(f"CASE WHEN {at(k)} IS NOT NULL THEN {w!r} ELSE 0 END" for k, w in terms)
    return f"SELECT event_type, day, round(({num}) / ({den}), 6) AS v FROM (SELECT event_type, day, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS v FROM d) WINDOW w AS (PARTITION BY event_type ORDER BY day)"


@query(f"WITH {_D} {_gauss_sql()}")
def ts_gaussian_smooth(spark: SparkSession, d: str) -> DataFrame:
    return ts_diff(spark, d).select("event_type", "day", F.round(series.smoothed("v", "event_type", "day"), 6).alias("v"))


@query(f"WITH {_D} SELECT event_type, day, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day) AS BIGINT) AS v FROM d")
def ts_cumulative(spark: SparkSession, d: str) -> DataFrame:
    w = _day_window().rowsBetween(Window.unboundedPreceding, 0)
    return _daily(spark, d).select("event_type", "day", F.sum("n").over(w).alias("v"))


GRID = 121
_RT = f"""{_D}, k AS (SELECT event_type, CAST(row_number() OVER w AS INTEGER) AS t, n, lag(n) OVER w AS p FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)),
g AS (SELECT i / 10.0::DOUBLE AS r FROM range({GRID}) x(i)),
l AS (SELECT event_type, t, r, n * (ln(p) + (r - 1) / 7) - p * exp((r - 1) / 7) AS ll FROM k CROSS JOIN g WHERE t >= 2),
c AS (SELECT event_type, t, r, sum(ll) OVER (PARTITION BY event_type, r ORDER BY t) AS ll FROM l),
e AS (SELECT event_type, t, r, exp(ll - max(ll) OVER (PARTITION BY event_type, t)) AS x FROM c),
po AS (SELECT event_type, t, r, x / sum(x) OVER (PARTITION BY event_type, t) AS p FROM e)"""


def _posterior(spark: SparkSession, d: str) -> DataFrame:
    """(event_type, t, r, p) from the second day on: the product of Poisson likelihoods over the grid, normalised. Series of a calendar's length times a fixed grid."""
    w = _day_window()
    k = _daily(spark, d).select("event_type", F.row_number().over(w).alias("t"), "n", F.lag("n").over(w).alias("prev")).where("t >= 2")
    grid = spark.range(GRID).select((F.col("id") / 10).alias("r"))
    ll = F.col("n") * (F.log("prev") + (F.col("r") - 1) / 7) - F.col("prev") * F.exp((F.col("r") - 1) / 7)
    c = k.crossJoin(F.broadcast(grid)).withColumn("ll", F.sum(ll).over(Window.partitionBy("event_type", "r").orderBy("t")))
    day = Window.partitionBy("event_type", "t")
    e = c.withColumn("x", F.exp(F.col("ll") - F.max("ll").over(day)))
    return e.select("event_type", "t", "r", (F.col("x") / F.sum("x").over(day)).alias("p"))


@query(f"WITH {_RT} SELECT event_type, t AS day, round(r, 1) AS r, round(p, 6) AS p FROM po")
def rt_posterior_simple(spark: SparkSession, d: str) -> DataFrame:
    """For every day from the second on."""
    return _posterior(spark, d).select("event_type", F.col("t").alias("day"), F.round("r", 1).alias("r"), F.round("p", 6).alias("p"))


@query(f"""WITH {_RT}, s AS (SELECT event_type, t, CAST(round(r * 10) AS INTEGER) AS i, round(sum(p) OVER (PARTITION BY event_type, t ORDER BY r), 9) AS c FROM po),
h AS (SELECT a.event_type, a.t, arg_min({{'lo': a.i, 'hi': b.i}}, (b.i - a.i, a.i)) AS z FROM s a JOIN s b ON a.event_type = b.event_type AND a.t = b.t AND b.i > a.i AND b.c - a.c > 0.9 GROUP BY 1, 2)
SELECT event_type, t AS day, round(z.lo / 10.0::DOUBLE, 1) AS low, round(z.hi / 10.0::DOUBLE, 1) AS high FROM h""")
def hdi(spark: SparkSession, d: str, mass: float = 0.9) -> DataFrame:
    """Shortest interval whose mass above its low end is more than mass, for every day from the second on."""
    posterior = _posterior(spark, d)
    w = Window.partitionBy("event_type", "t").orderBy("r")
    s = posterior.select("event_type", "t", F.round(F.col("r") * 10).cast("int").alias("i"), F.round(F.sum("p").over(w), 9).alias("c"))
    b = s.select("event_type", "t", F.col("i").alias("j"), F.col("c").alias("e"))
    pairs = s.join(b, ["event_type", "t"]).where((F.col("j") > F.col("i")) & (F.col("e") - F.col("c") > mass))  # a fixed grid squared
    best = pairs.groupBy("event_type", "t").agg(F.min(F.struct((F.col("j") - F.col("i")).alias("w"), "i", "j")).alias("z"))
    return best.select("event_type", F.col("t").alias("day"), F.round(F.col("z.i") / 10, 1).alias("low"), F.round(F.col("z.j") / 10, 1).alias("high"))


#: Spreads of the reproduction number to choose from.
SIGMAS = [i / 20 for i in range(1, 21)]


@query()
def rt_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Reproduction number by day of the smoothed counts, with the spread that fits best."""
    counts = series.prepared(_daily(spark, d), "event_type", "day", "n")
    sigma = series.best_sigma(counts, "event_type", "day", "n", SIGMAS).first().sigma
    return series.rt_estimate(counts, "event_type", "day", "n", sigma)


_BUCKET = "CASE WHEN n < 1024 THEN '< 1KB' WHEN n < 10240 THEN '1KB ~ <10KB' WHEN n < 102400 THEN '10KB ~ <100KB' WHEN n < 1048576 THEN '100KB ~ <1MB' ELSE '>= 1MB' END"


@query(f"SELECT {_BUCKET} AS bucket, count(*) AS n FROM (SELECT strlen(html) AS n FROM pages) GROUP BY 1")
def size_buckets(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("html")
    bucket = F.when(n < 1024, "< 1KB").when(n < 10240, "1KB ~ <10KB").when(n < 102400, "10KB ~ <100KB").when(n < 1048576, "100KB ~ <1MB").otherwise(">= 1MB")
    return table(spark, d, "pages").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {LINKS} SELECT 'pages' AS section, 'fetched' AS metric, count(*) AS n FROM pages UNION ALL SELECT 'sizes', {_BUCKET}, count(*) FROM (SELECT strlen(html) AS n FROM pages) GROUP BY 2
UNION ALL SELECT 'links', 'total', count(*) FROM lk UNION ALL SELECT 'links', 'distinct', count(DISTINCT target) FROM lk UNION ALL SELECT 'links', CASE WHEN host = own THEN 'OK' ELSE 'N_OK' END, count(*) FROM lk GROUP BY 2""")
def crawl_report(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    counts = links.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("target").alias("distinct"))
    both = counts.select(F.explode(F.map_from_arrays(F.array(F.lit("total"), F.lit("distinct")), F.array("total", "distinct"))).alias("metric", "n"))
    inside = links.groupBy(F.when(F.col("host") == F.col("own"), "OK").otherwise("N_OK").alias("metric")).agg(F.count(F.lit(1)).alias("n"))
    pages = table(spark, d, "pages").agg(F.lit("fetched").alias("metric"), F.count(F.lit(1)).alias("n"))
    return long_report(pages=pages, sizes=size_buckets(spark, d).withColumnRenamed("bucket", "metric"), links=both.unionByName(inside))


#: Fixed value: endings that a crawl does not follow.
ENDINGS = "css|js|json|webmanifest|ttf|svg|wav|avi|mov|mpeg|mpg|ram|m4v|wma|wmv|mid|txt|mp2|mp3|mp4|zip|rar|gz|exe|ico"


@query(f"""WITH {LINKS}, u AS (SELECT DISTINCT replace(lower(target), ',', '_') AS url, host = own AS inside FROM lk), s AS (SELECT DISTINCT replace(lower(url), ',', '_') AS url FROM pages)
SELECT url, bool_or(inside) AND NOT regexp_matches(url, '\\.({ENDINGS})$') AND url NOT IN (SELECT url FROM s) AS visit FROM u GROUP BY 1""")
def crawl_should_visit(spark: SparkSession, d: str) -> DataFrame:
    """Inside the site, not an ending to leave out, not fetched yet."""
    u = _links(spark, d).groupBy(F.replace(F.lower("target"), F.lit(","), F.lit("_")).alias("url")).agg(F.bool_or(F.col("host") == F.col("own")).alias("inside"))
    seen = table(spark, d, "pages").select(F.replace(F.lower("url"), F.lit(","), F.lit("_")).alias("url")).distinct().withColumn("seen", F.lit(True))
    return u.join(seen, "url", "left").select("url", (F.col("inside") & ~F.col("url").rlike(rf"\.({ENDINGS})$") & F.col("seen").isNull()).alias("visit"))


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def plain_text(html: str | None) -> str:
    """Text of a page without scripts and styles, blanks run together."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return " ".join("".join(p if p.strip() else " " for p in parser.parts).split())


@query()
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"page_id": f.page_id, "text": [plain_text(h) for h in f.html]})

    return table(spark, d, "pages").select("page_id", "html").mapInPandas(run, "page_id long, text string")


@query("SELECT i, round(-118.284969 + 0.001 * (9 * cos(8 * i * 0.1::DOUBLE) - 4 * cos(9 * i * 0.1::DOUBLE) - 5), 6) AS x, round(34.020546 + 0.001 * (9 * sin(8 * i * 0.1::DOUBLE) - 4 * sin(9 * i * 0.1::DOUBLE)), 6) AS y FROM range(503) t(i)")
def spirograph_points(spark: SparkSession, d: str) -> DataFrame:
    return geo.spirograph(spark).select("i", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _plane(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


_XY = "xy AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)"


@query(f"WITH {_XY} SELECT id AS vec_id, round(sqrt((x - (SELECT x FROM xy WHERE id = 0)) ** 2 + (y - (SELECT y FROM xy WHERE id = 0)) ** 2), 6) AS d FROM xy WHERE id <> 0 ORDER BY d, vec_id LIMIT 4")
def geo_nearest(spark: SparkSession, d: str, k: int = 4) -> DataFrame:
    """The k points nearest to point 0."""
    p = _plane(spark, d)
    home = p.where("id = 0").select(F.col("x").alias("u"), F.col("y").alias("v"))
    far = p.where("id <> 0").crossJoin(F.broadcast(home)).select(F.col("id").alias("vec_id"), F.round(geo.distance(F.col("x"), F.col("y"), F.col("u"), F.col("v")), 6).alias("d"))
    return far.orderBy("d", "vec_id").limit(k)


@query(f"WITH {_XY}, e AS (SELECT p.id AS a, q.id AS b FROM xy p JOIN xy q ON p.id <> q.id JOIN xy z ON z.id <> p.id AND z.id <> q.id GROUP BY 1, 2 HAVING min((q.x - p.x) * (z.y - p.y) - (q.y - p.y) * (z.x - p.x)) > 0) SELECT DISTINCT a AS vec_id FROM e")
def geo_hull_vertices(spark: SparkSession, d: str) -> DataFrame:
    return geo.hull(_plane(spark, d)).select(F.col("id").alias("vec_id"))


@query()
def rt_standings(spark: SparkSession, d: str) -> DataFrame:
    """The last day of each series: under control if the 90 % interval ends at 1 or below, growing if it begins at 1 or above."""
    last = last_per_group(rt_estimate(spark, d), "event_type", F.col("day"), "day", "ml", "low_90", "high_90", "low_50", "high_50")
    state = F.when(F.col("high_90") <= 1, "under control").when(F.col("low_90") >= 1, "growing").otherwise("open")
    return last.withColumn("state", state)
