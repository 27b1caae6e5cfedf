"""Fuzzy connectives and utility functions over columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewatch.functions.mathx import d


def lukasiewicz_and(a: Column, b: Column) -> Column:
    return F.greatest(d(0), a + b - 1)


def lukasiewicz_or(a: Column, b: Column) -> Column:
    return F.least(d(1), a + b)


def lukasiewicz_implies(a: Column, b: Column) -> Column:
    return F.least(d(1), d(1) - a + b)


def godel_and(a: Column, b: Column) -> Column:
    return F.least(a, b)


def godel_or(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def godel_implies(a: Column, b: Column) -> Column:
    return F.when(a <= b, d(1)).otherwise(b)


def product_and(a: Column, b: Column) -> Column:
    return a * b


def product_or(a: Column, b: Column) -> Column:
    return a + b - a * b


def product_implies(a: Column, b: Column) -> Column:
    return F.when(a <= b, d(1)).otherwise(b / a)


def negate(a: Column) -> Column:
    return d(1) - a


def crra(x: Column, gamma: float) -> Column:
    """Constant relative risk aversion; logarithmic at gamma 1."""
    x = F.greatest(x, d(1e-10))
    return F.log(x) if abs(gamma - 1) < 1e-10 else (F.pow(x, d(1 - gamma)) - 1) / d(1 - gamma)


def cara(x: Column, alpha: float) -> Column:
    """Constant absolute risk aversion; linear at alpha 0."""
    return x if abs(alpha) < 1e-10 else -F.exp(d(-alpha) * x) / d(alpha)


def prospect(x: Column, gain: float = 0.88, loss: float = 0.88, aversion: float = 2.25, reference: float = 0.0) -> Column:
    """Value of a gain or loss beside the reference point."""
    z = x - reference
    return F.when(z >= 0, F.pow(F.greatest(z, d(0)), d(gain))).otherwise(d(-aversion) * F.pow(F.greatest(-z, d(0)), d(loss)))


def weighted_probability(p: Column, gamma: float = 0.61) -> Column:
    up = F.pow(p, d(gamma))
    return up / F.pow(up + F.pow(d(1) - p, d(gamma)), d(1 / gamma))


def multi_attribute(utilities: list[Column], weights: list[float], k: float = 0.0) -> Column:
    """Additive for k = 0, else the multiplicative form."""
    if abs(k) < 1e-10:
        return sum((d(w) * u for u, w in zip(utilities, weights)), d(0))
    out = d(1)
    for u, w in zip(utilities, weights):
        out = out * (d(1) + d(k * w) * u)
    return (out - 1) / d(k)
