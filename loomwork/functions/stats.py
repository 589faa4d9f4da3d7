"""Densities as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' coefficients for g = 7.
LANCZOS_G = 7
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function, x from one half on."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (z + i)
    t = z + LANCZOS_G + 0.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(total)


def poisson(k: Column, rate: Column) -> Column:
    """Probability of k events at a positive rate."""
    return F.exp(k * F.log(rate) - rate - log_gamma(k + 1))


def gamma(x: Column, shape: Column) -> Column:
    """Density of the gamma distribution of scale one; 0 at and below 0 for shapes above one."""
    return F.when(x > 0, F.exp((shape - 1) * F.log(x) - x - log_gamma(shape))).otherwise(0.0)
