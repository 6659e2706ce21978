"""Scalar expression builders: every function returns a Column, so Catalyst sees through it."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column | str) -> Column:
    """The value, or null for null, NaN and infinities: all three are one kind of absence here."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def rounded(c: Column | str, scale: float = 1e4) -> Column:
    """Half-up rounding by floor: the same steps in any IEEE engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * scale + 0.5) / F.lit(scale)


def log_ratio(top: Column, bottom: Column) -> Column:
    """ln(top / bottom), null unless both are positive."""
    return F.when((top > 0) & (bottom > 0), F.ln(top / bottom))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def smoothstep(t: Column) -> Column:
    x = clamp(t, 0.0, 1.0)
    return x * x * (3 - 2 * x)


#: Coefficients of two published approximations of the normal distribution.
ERF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
ZS_COEFFICIENTS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
ZS_P = 0.2316419


def _horner(coefficients: tuple[float, ...], t: Column) -> Column:
    total = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        total = total * t + F.lit(c)
    return total * t


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; error below 1.5e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    tail = _horner(ERF_COEFFICIENTS, t) * F.exp(-x * x)
    return F.when(x < 0, tail - 1.0).otherwise(F.lit(1.0) - tail)


def normal_cdf(z: Column) -> Column:
    """By way of erf."""
    return (F.lit(1.0) + erf(z / F.lit(sqrt(2)))) / 2


def normal_cdf_polynomial(z: Column) -> Column:
    """Abramowitz and Stegun 26.2.17; error below 7.5e-8."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ZS_P) * F.abs(z))
    tail = F.exp(-z * z / 2) / F.lit(sqrt(2 * pi)) * _horner(ZS_COEFFICIENTS, t)
    return F.when(z < 0, tail).otherwise(F.lit(1.0) - tail)


#: Coefficients of the published rational approximation of the normal quantile.
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
QUANTILE_BREAK = 0.02425


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution, p held within [1e-9, 1 - 1e-9]."""
    p = clamp(p, 1e-9, 1 - 1e-9)
    tail = lambda q: _polynomial(QUANTILE_C, q) / (_polynomial(QUANTILE_D, q) * q + 1)
    q = p - 0.5
    r = q * q
    middle = _polynomial(QUANTILE_A, r) * q / (_polynomial(QUANTILE_B, r) * r + 1)
    return (
        F.when(p < QUANTILE_BREAK, tail(F.sqrt(-2 * F.ln(p))))
        .when(p > 1 - QUANTILE_BREAK, -tail(F.sqrt(-2 * F.ln(1 - p))))
        .otherwise(middle)
    )


def lognormal_quantile(median: Column, sigma: Column, p: float) -> Column:
    return median * F.exp(sigma * normal_quantile(F.lit(p)))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters of an ASCII text."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    kept = F.filter(codes, lambda c: c > 0)
    return F.aggregate(kept, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def add_months_overflowing(date: Column, months: Column | int) -> Column:
    """Adds months and keeps the day number, running over into the next month where that is longer than the month."""
    return F.date_add(F.add_months(F.trunc(date, "MM"), months), F.dayofmonth(date) - 1)
