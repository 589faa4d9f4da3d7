"""Writers of the report and model formats. Each overwrites its folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).csv(path)


def write_pairs(df: DataFrame, path: str, key: str, value: str, sep: str = "\t") -> None:
    """Lines ``key<sep>value``."""
    df.select(F.concat_ws(sep, F.col(key).cast("string"), F.col(value).cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_scores(df: DataFrame, path: str, key: str, value: str) -> None:
    """Lines ``key=value``, as a search server's external score file."""
    write_pairs(df, path, key, value, "=")


def write_model(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """What write_model wrote: a model is a table, so it is used as it was before."""
    return spark.read.parquet(path)


def long_report(**sections: DataFrame) -> DataFrame:
    """(section, metric, n) from DataFrames (metric, n)."""
    out = None
    for name, df in sections.items():
        part = df.select(F.lit(name).alias("section"), F.col("metric").cast("string").alias("metric"), F.col("n").cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out
