"""Tables of a data folder and the views over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators.similarity import paired


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Rows of a task's share of a table that is dealt out by a key.
SHARE = 1 << 20


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, which comes from so many rows, dealt out by keys to tasks of about SHARE rows. Adaptive execution deals by bytes, of which small rows have few: a
    task's sorts and hash tables are then several times as large. A small table stays as it is."""
    return df.repartition(-(-rows // SHARE), *keys) if rows > 4 * SHARE else df


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """user_id, business_id, stars (1 to 5), date, order_id: order lines read as ratings."""
    n = table(spark, d, "lineitem").count()
    lines = spread(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), n, "l_orderkey")
    orders = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), n, "o_orderkey")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("business_id"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("stars"),
        F.col("o_orderdate").alias("date"),
        F.col("o_orderkey").alias("order_id"),
    )


#: The same view in SQL.
REVIEWS = """r AS (SELECT o_custkey AS user_id, l_partkey AS business_id, CAST(ceil(l_quantity / 10) AS DOUBLE) AS stars,
  o_orderdate AS date, o_orderkey AS order_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def categories(spark: SparkSession, d: str) -> DataFrame:
    """(business_id, category), one row for each word of a part's name; null and empty names give none."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("business_id"), "p_name")
    exploded = parts.select("business_id", F.explode(F.split("p_name", ",| ")).alias("category"))
    return exploded.select("business_id", F.trim("category").alias("category")).where("category <> ''")


def supplier_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, n) with a < b: number of orders that have lines of both suppliers."""
    lines = table(spark, d, "lineitem")
    has = spread(lines.select("l_orderkey", "l_suppkey"), lines.count(), "l_orderkey", "l_suppkey").distinct()
    return paired(has, "l_suppkey", "l_orderkey", [], [F.count(F.lit(1)).alias("n")])


PAIRS = """has AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem),
p AS (SELECT x.l_suppkey AS a, y.l_suppkey AS b, count(*) AS n FROM has x JOIN has y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY 1, 2)"""


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; a malformed line gives nulls."""
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def csv_table(spark: SparkSession, path: str, schema: str, header: bool = True, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("sep", sep).csv(path)


def numeric_rounds(spark: SparkSession, path: str) -> DataFrame:
    """(round, id, features): headerless numeric files of one folder, a round for each file in the order of names."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split("value", ",").alias("v")).where(F.size("v") > 1)
    # a row a file: ranked on one task, as are the names that a folder listing returns
    rank = rows.select("file").distinct().select("file", F.dense_rank().over(Window.orderBy("file")).alias("round"))
    return rows.join(rank, "file").select("round", F.col("v")[0].alias("id"), F.transform(F.slice("v", 2, 1 << 20), lambda x: x.cast("double")).alias("features"))


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): a row for each file of a tree; a class is read off the path by the caller."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def tsv_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of lines ``id<tab>text``; a line without a tab is left out."""
    part = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.col("value").contains("\t")).select(part[0].alias("doc_id"), part[1].alias("text"))


def kml_points(spark: SparkSession, path: str) -> DataFrame:
    """(name, x, y) of the placemarks of a KML file: x is the longitude."""
    mark = F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<Placemark>(.*?)</Placemark>"), F.lit(1))).alias("p")
    at = F.split(F.trim(F.regexp_extract("p", r"(?s)<coordinates>\s*([^<]*?)\s*</coordinates>", 1)), ",")
    one = spark.read.text(path, wholetext=True).select(mark)
    return one.select(F.regexp_extract("p", r"(?s)<name>\s*(.*?)\s*</name>", 1).alias("name"), at[0].cast("double").alias("x"), at[1].cast("double").alias("y"))


def insert_literals(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Rows that INSERT INTO name (...) VALUES (...), (...) statements of SQL scripts give, in the order of the schema's columns. Values are
    numbers, NULL, or text in single or double quotes, in which a doubled quote is one; comments begin with two dashes. A script is one text."""
    value = r"""(?:'[^']*+(?:''[^']*+)*+'|"[^"]*+(?:""[^"]*+)*+"|[^\s,()'"]++)"""
    script = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"(?m)--.*$", "").alias("s"))
    statement = rf"(?is)\binsert\s+into\s+`?{name}`?\s*(?:\([^)]*\))?\s*values\s*((?:\(\s*{value}(?:\s*,\s*{value})*+\s*\)\s*,?\s*)++)"
    rows = script.select(F.explode(F.regexp_extract_all("s", F.lit(statement), F.lit(1))).alias("v"))
    rows = rows.select(F.explode(F.regexp_extract_all("v", F.lit(rf"\(\s*({value}(?:\s*,\s*{value})*+)\s*\)"), F.lit(1))).alias("r"))
    cells = rows.select(F.regexp_extract_all("r", F.lit(value), F.lit(0)).alias("c"))

    def plain(i: int) -> Column:
        c = F.try_element_at("c", F.lit(i + 1))
        quoted = lambda q: F.replace(F.expr(f"substring(c[{i}], 2, length(c[{i}]) - 2)"), F.lit(q * 2), F.lit(q))
        return F.when(F.upper(c) == "NULL", F.lit(None)).when(c.startswith("'"), quoted("'")).when(c.startswith('"'), quoted('"')).otherwise(c)

    fields = StructType.fromDDL(schema).fields
    return cells.select(*(plain(i).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))
