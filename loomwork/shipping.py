"""Make this package importable for Python workers that do not share the driver's path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to the context, once; Spark brings them to every executor."""
    context = spark.sparkContext
    if getattr(context, "_loomwork_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="loomwork-")) / "loomwork.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path("loomwork") / source.relative_to(root))
    context.addPyFile(str(target))
    context._loomwork_shipped = True
