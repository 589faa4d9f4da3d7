"""Time series: smoothing, cumulation, reproduction number."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship

GAMMA = 1 / 7


def daily(events: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, day, n)."""
    return events.groupBy(key, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


def smoothed(value: str, key: str, order: str, half: int = 3, sd: float = 2.0) -> Column:
    """Centred Gaussian mean over the rows that are there and not null."""
    w = Window.partitionBy(key).orderBy(order)
    num, den = F.lit(0.0), F.lit(0.0)
    for k in range(-half, half + 1):
        weight = math.exp(-k * k / (2 * sd * sd))
        x = F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k < 0 else F.col(value)
        num = num + F.coalesce(x * weight, F.lit(0.0))
        den = den + F.when(x.isNotNull(), weight).otherwise(0.0)
    return F.when(den > 0, num / den)


def cumulative_product(value: Column, key: str, order: str) -> Column:
    """Product of the positive values up to each row, as the exponential of a sum of logarithms."""
    return F.exp(F.sum(F.log(value)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def without(df: DataFrame, key: str, left_out: list) -> DataFrame:
    """Rows whose series is none of those left out; a null key stays."""
    return df.where(~F.coalesce(F.col(key).isin(left_out), F.lit(False)))


def prepared(counts: DataFrame, key: str, day: str, n: str, cutoffs: tuple[float, ...] = (25, 10)) -> DataFrame:
    """(key, day, n): daily counts smoothed and rounded (halves to even), each series from its first day at or above the first
    cutoff that it reaches. A series that reaches none stays whole."""
    smooth = counts.select(key, day, F.bround(smoothed(n, key, day)).alias(n))
    w = Window.partitionBy(key)
    starts = (F.min(F.when(F.col(n) >= c, F.col(day))).over(w) for c in cutoffs)
    return smooth.withColumn("__f", F.coalesce(*starts, F.min(day).over(w))).where(F.col(day) >= F.col("__f")).drop("__f")


def _interval(p: np.ndarray, r: np.ndarray, mass: float) -> tuple[float, float]:
    c = np.cumsum(p)
    hi = np.searchsorted(c, c + mass, side="right")
    ok = hi < len(p)
    width = np.where(ok, hi - np.arange(len(p)), len(p) + 1)
    i = int(width.argmin())
    return float(r[i]), float(r[min(hi[i], len(p) - 1)])


def _posteriors(k: np.ndarray, r: np.ndarray, sigma: float) -> Iterator[tuple[np.ndarray, float]]:
    """Posterior over r and log-likelihood so far of each day from the second on."""
    move = np.exp(-0.5 * ((r[:, None] - r[None]) / sigma) ** 2)
    move /= move.sum(axis=0)
    post = r**3 * np.exp(-r)
    post /= post.sum()
    loglik = 0.0
    for t in range(1, len(k)):
        lam = max(k[t - 1], 1e-9) * np.exp(GAMMA * (r - 1))
        like = np.exp(k[t] * np.log(lam) - lam - math.lgamma(k[t] + 1))
        prior = move @ post
        joint = like * prior
        total = joint.sum()
        post = joint / total if total > 0 else prior
        loglik += math.log(total) if total > 0 else -745.0
        yield post, loglik


def rt_estimate(counts: DataFrame, key: str, day: str, n: str, sigma: float = 0.25, grid: int = 1201, top: float = 12.0) -> DataFrame:
    """(key, day, ml, low_90, high_90, low_50, high_50, loglik) of a series (key, day, n): each day's posterior over R is the last one, widened by
    a Gaussian of spread sigma, times the Poisson likelihood of the day's count. The prior is Gamma(4). One series is one
    group: its length is that of a calendar."""
    ship(counts.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day)
        r = np.linspace(0, top, grid)
        days = enumerate(_posteriors(pdf[n].to_numpy(dtype=float), r, sigma), 1)
        out = [(pdf[key].iloc[0], pdf[day].iloc[t], float(r[p.argmax()]), *_interval(p, r, 0.9), *_interval(p, r, 0.5), loglik) for t, (p, loglik) in days]
        return pd.DataFrame(out, columns=[key, day, "ml", "low_90", "high_90", "low_50", "high_50", "loglik"])

    kind = counts.schema[key].dataType.simpleString()
    return counts.groupBy(key).applyInPandas(run, f"{key} {kind}, {day} {counts.schema[day].dataType.simpleString()}, ml double, low_90 double, high_90 double, low_50 double, high_50 double, loglik double")


def best_sigma(counts: DataFrame, key: str, day: str, n: str, choices: list[float], grid: int = 1201, top: float = 12.0) -> DataFrame:
    """One row (sigma, loglik): the spread whose total log-likelihood over all series is the largest, the smaller of equals."""
    ship(counts.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, s = pdf.sort_values(day)[n].to_numpy(dtype=float), float(pdf["__s"].iloc[0])
        loglik = 0.0
        for _, loglik in _posteriors(k, np.linspace(0, top, grid), s):  # noqa: B007
            pass
        return pd.DataFrame({"sigma": [s], "loglik": [loglik]})

    tried = counts.withColumn("__s", F.explode(F.array(*map(F.lit, choices))))
    each = tried.groupBy(key, "__s").applyInPandas(run, "sigma double, loglik double")
    return each.groupBy("sigma").agg(F.sum("loglik").alias("loglik")).orderBy(F.desc("loglik"), "sigma").limit(1)
