"""Points in the plane: nearest, hull, curves."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def distance(x: Column, y: Column, u: Column, v: Column) -> Column:
    return F.sqrt((x - u) * (x - u) + (y - v) * (y - v))


def wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Corners of the hull, counter-clockwise; points on an edge are none."""
    p = sorted({(r.x, r.y): r.id for r in pdf.sort_values("id", ascending=False).itertuples()}.items())
    if len(p) < 3:
        return pd.DataFrame([(i, x, y) for (x, y), i in p], columns=["id", "x", "y"])
    cross = lambda o, a, b: (a[0][0] - o[0][0]) * (b[0][1] - o[0][1]) - (a[0][1] - o[0][1]) * (b[0][0] - o[0][0])

    def half(points: list) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and cross(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return pd.DataFrame([(i, x, y) for (x, y), i in half(p) + half(p[::-1])], columns=["id", "x", "y"])


def hull(points: DataFrame) -> DataFrame:
    """Corners of the convex hull of points (id, x, y): every task keeps its own hull's corners, the hull of these is the whole one."""
    ship(points.sparkSession)

    def part(frames):
        best = None
        for f in frames:
            best = _chain(f if best is None else pd.concat([best, f]))
        if best is not None:
            yield best

    schema = points.select("id", "x", "y").schema
    corners = points.select("id", "x", "y").mapInPandas(part, schema).withColumn("g", F.lit(0))
    return corners.groupBy("g").applyInPandas(lambda f: _chain(f.drop(columns="g")), schema)


def spirograph(spark: SparkSession, step: float = 0.1, big: float = 8.0, small: float = 1.0, a: float = 4.0, x0: float = -118.284969, y0: float = 34.020546, scale: float = 0.001) -> DataFrame:
    """(i, x, y): points of the curve at steps below 16 pi, moved so that the first lies at (x0, y0)."""
    n = math.ceil(16 * math.pi / step)
    t = F.col("id") * step
    k = 1 + big / small
    x = (big + small) * F.cos(big / small * t) - a * F.cos(k * t)
    y = (big + small) * F.sin(big / small * t) - a * F.sin(k * t)
    return spark.range(n).select(F.col("id").alias("i"), (F.lit(x0) + scale * (x - (big + small - a))).alias("x"), (F.lit(y0) + scale * y).alias("y"))
