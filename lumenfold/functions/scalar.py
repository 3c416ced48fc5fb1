"""Scalar functions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for the logarithm of numbers that have none, and the kernel's constants.
NO_LOG = -38.0
BFAK = 0.5 * math.pi ** (-5 / 6)
H2SIGMA = 0.5 * math.pi ** (-1 / 6)
RFAC = 0.75


def log10_or(v: Column) -> Column:
    return F.when(v > 0, F.log10(v)).otherwise(NO_LOG)


def asinh(v: Column) -> Column:
    """By sign, as the plain formula cancels for large negative numbers."""
    return F.when(v < 0, -1.0).otherwise(1.0) * F.log(F.abs(v) + F.sqrt(1 + v * v))


def norm_and_clamp(v: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, 1.0).otherwise((F.greatest(low, F.least(high, v)) - low) / (high - low))


def approx(a: Column, b: Column, eps: float = 1e-5) -> Column:
    return F.abs(a - b) <= eps * F.abs(b)


def nearest(v: Column) -> Column:
    return F.floor(v + 0.5)


def sign(v: Column) -> Column:
    """1 for zero."""
    return F.when(v >= 0, 1).otherwise(-1)


def isqrt(v: Column) -> Column:
    return F.floor(F.sqrt(v.cast("double") + 0.5)).cast("long")


def ilog2(v: Column) -> Column:
    return (F.length(F.bin(v)) - 1).cast("int")


def trailing_zeros(v: Column) -> Column:
    return F.bit_count(v.bitwiseAND(-v) - 1).cast("int")


def truncated(v: Column, low: float, high: float) -> Column:
    """To int toward zero, clamped first so that no value is out of an int's range."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v)).cast("int")


def erfc(x: Column) -> Column:
    """Complementary error function, by a rational approximation (error below 2e-7)."""
    a = F.abs(x)
    t = 1 / (1 + 0.3275911 * a)
    y = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-a * a)
    return F.when(x >= 0, y).otherwise(2 - y)


def multiequal(*columns: Column) -> Column:
    """Whether all of them are equal; nulls are equal to each other."""
    out = F.lit(True)
    for c in columns[1:]:
        out = out & columns[0].eqNullSafe(c)
    return out


def safe_cast(v: Column, kind: str) -> Column:
    """``v`` as another type; an error where that changes it."""
    cast = v.try_cast(kind)
    return F.when(v.isNull() | (cast == v), cast).otherwise(F.raise_error(F.concat(F.lit(f"no {kind}: "), v.cast("string"))).cast(kind))
