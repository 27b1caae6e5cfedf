"""Numeric column functions that Spark has no built-in for."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_M = 6_371_000.0


def d(x: float) -> Column:
    return F.lit(float(x))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, d(low)), d(high))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, d(0))


def sigmoid(x: Column) -> Column:
    return d(1) / (d(1) + F.exp(-x))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by Abramowitz and Stegun 26.2.17; error below 7.5e-8."""
    k = d(1) / (d(1) + d(0.2316419) * F.abs(x))
    # The published coefficients.
    poly = k * (d(0.319381530) + k * (d(-0.356563782) + k * (d(1.781477937) + k * (d(-1.821255978) + k * d(1.330274429)))))
    tail = F.exp(-x * x / 2) / d(math.sqrt(2 * math.pi)) * poly
    return F.when(x >= 0, d(1) - tail).otherwise(tail)


def normal_ppf(p: Column) -> Column:
    """Inverse of the standard normal distribution function by Abramowitz and Stegun 26.2.23; error below 4.5e-4."""
    q = F.when(p < 0.5, p).otherwise(d(1) - p)
    t = F.sqrt(d(-2) * F.log(q))
    # The published coefficients.
    top = d(2.515517) + t * (d(0.802853) + t * d(0.010328))
    low = d(1) + t * (d(1.432788) + t * (d(0.189269) + t * d(0.001308)))
    z = t - top / low
    return F.when(p < 0.5, -z).otherwise(z)


def log_factorial(k: Column) -> Column:
    """ln k! of a whole number, as a sum of logarithms."""
    return F.when(k > 1, F.aggregate(F.sequence(F.lit(2), F.greatest(k.cast("int"), F.lit(2))), d(0), lambda a, i: a + F.log(i.cast("double")))).otherwise(d(0))


def log_gamma(x: Column) -> Column:
    """ln Gamma of a positive number: Stirling's series after shifting the argument by eight."""
    z = x + 8
    shift = sum((F.log(x + i) for i in range(1, 8)), F.log(x))
    series = d(1 / 12) / z - d(1 / 360) / (z * z * z) + d(1 / 1260) / F.pow(z, d(5)) - d(1 / 1680) / F.pow(z, d(7))
    return (z - 0.5) * F.log(z) - z + d(0.5 * math.log(2 * math.pi)) + series - shift


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return d(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(d(1) - a))


def safe_divide(n: Column, by: Column, fill: float = 0.0) -> Column:
    """Quotient where the divisor is large enough beside the dividend, else ``fill``."""
    return F.when(F.abs(by) >= d(math.sqrt(2.220446049250313e-16)) * F.greatest(F.abs(n), d(1)), n / by).otherwise(d(fill))


def safe_log(x: Column, least: float = 1e-300) -> Column:
    return F.log(F.greatest(x, d(least)))


def safe_sqrt(x: Column) -> Column:
    return F.sqrt(F.greatest(x, d(0)))


def safe_exp(x: Column, most: float = 700.0) -> Column:
    return F.exp(F.least(x, d(most)))


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, d(lam)) - 1) / d(lam)
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, d(2 - lam)) - 1) / d(2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, d(lam)) - 1) / d(lam)


def lognormal_params(mean: float, sd: float) -> tuple[float, float]:
    """(mu, sigma) of the log-normal distribution of this mean and standard deviation."""
    return math.log(mean**2 / math.sqrt(sd**2 + mean**2)), math.sqrt(math.log(1 + sd**2 / mean**2))
