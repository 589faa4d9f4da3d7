"""What the operators of this subpackage share: shared-folder tables, text keys, safe column names."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.scratch import checkpoint_dir, discard, work_dir, written
from loomwork.shipping import ship

__all__ = ["LOWER", "ascii_lower", "checkpoint_dir", "discard", "free_names", "parts", "read", "release", "texts", "trim", "work_dir", "written"]


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that no longer exist."""
    trim()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give a Python worker's unused memory back: workers stay for later tasks, beside other workers and the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def texts(column: pa.Array, rows: int = 500) -> Iterator[str]:
    """The texts of a column, some rows at a time; null counts as empty."""
    for begin in range(0, len(column), rows):
        for text in column.slice(begin, rows).to_pylist():
            yield text or ""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: bytes.translate table of the same rule, for Python workers.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
