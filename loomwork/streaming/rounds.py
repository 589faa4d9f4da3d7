"""Micro-batch forms over file streams. Extensions: the library's own operators are batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cluster import Bfr


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(begin, key, n): counts by tumbling window; rows later than the watermark are left out."""
    timed = events.withColumn("__t", F.col(ts).cast("timestamp")).withWatermark("__t", late)
    return timed.groupBy(F.window("__t", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("begin"), key, "n")


def bfr_stream(points: DataFrame, bfr: Bfr, checkpoint: str) -> StreamingQuery:
    """One clustering round for each micro-batch of points (id, v); read bfr.result() when the query is done."""

    def round_(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            bfr.add(batch)

    return points.writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_rounds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream that takes one Parquet file at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
