"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary folder of its own; on a cluster that is an error,
    since each executor would write to a disk that no other one reads."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='loomwork-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint()`` usable: it needs a folder in the context."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark))


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends there, and a lost
    executor costs a read, not a recomputation."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself if it is a table from ``written``, else such a table of it."""
    return df if "_written_to" in df.__dict__ else written(df, name)


def discard(*tables: DataFrame | None) -> None:
    """Delete the folders of tables from ``written`` that nothing reads any more."""
    for df in tables:
        if df is not None and (path := df.__dict__.get("_written_to")):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
