"""Between two snapshots: particles are paired by id, and moved."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.camera import minimum_image

FIELDS = ("x", "y", "z", "r", "i", "e")


def paired(first: DataFrame, second: DataFrame, tie: list[str] = ("x", "y", "z")) -> DataFrame:
    """A full outer join on id: fields of either side with suffix 1 and 2. Repeated ids pair in order, one with one."""
    extra = [c for c in first.columns if c not in ("id", "type", *FIELDS)]

    def side(df: DataFrame, n: int) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("id").orderBy(*tie))
        return df.withColumn("nth", nth).select("id", "nth", *[F.col(c).alias(f"{c}{n}") for c in ("type", *FIELDS, *extra)])

    return side(first, 1).join(side(second, 2), ["id", "nth"], "full_outer")


def change(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("state", F.when(F.col("x1").isNull(), "appear").when(F.col("x2").isNull(), "disappear").otherwise("stay"))


def linear(pairs: DataFrame, frac: float, box: float | None = None) -> DataFrame:
    """Fields in proportion; one-sided particles fade in or out at their place."""
    both = F.col("x1").isNotNull() & F.col("x2").isNotNull()

    def mix(c: str) -> Column:
        a, b = F.col(f"{c}1"), F.col(f"{c}2")
        if box and c in "xyz":
            b = minimum_image(a, b, box)
        return F.when(both, (1 - frac) * a + frac * b).otherwise(F.coalesce(F.col(f"{c}1"), F.col(f"{c}2"))).alias(c)

    fade = F.when(F.col("x1").isNull(), frac).when(F.col("x2").isNull(), 1 - frac).otherwise(1.0)
    out = pairs.select("id", F.coalesce("type1", "type2").alias("type"), *map(mix, FIELDS), fade.alias("_fade"))
    return out.withColumn("i", F.col("i") * F.col("_fade")).drop("_fade")


def cubic_position(x1: Column, x2: Column, v1: Column, v2: Column, frac: float) -> Column:
    """Hermite's curve through both places with both velocities (as lengths over the step)."""
    f = frac
    return (2 * f**3 - 3 * f**2 + 1) * x1 + (f**3 - 2 * f**2 + f) * v1 + (3 * f**2 - 2 * f**3) * x2 + (f**3 - f**2) * v2


def _curved(pairs: DataFrame, frac: float, unit1: float, unit2: float, box: float | None, curve: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """Fields as in :func:`linear`, and places on ``curve`` of both places and both velocities (as lengths over the step).

    A particle of one side has its velocity at both ends, and its other end ``v / mean(unit)`` away: a quotient where a
    product would be a length; it is kept, as results depend on it.
    """
    one, two = F.col("x2").isNull(), F.col("x1").isNull()
    mean = 0.5 * (unit1 + unit2)

    def place(c: str) -> Column:
        v1, v2 = F.coalesce(f"v{c}1", f"v{c}2"), F.coalesce(f"v{c}2", f"v{c}1")
        x1 = F.when(two, F.col(f"{c}2") - v2 / mean).otherwise(F.col(f"{c}1"))
        x2 = F.when(one, F.col(f"{c}1") + v1 / mean).otherwise(F.col(f"{c}2"))
        if box:
            x2 = F.when(one | two, x2).otherwise(minimum_image(x1, x2, box))
        return curve(x1, x2, v1 * unit1, v2 * unit2).alias(c)

    fade = F.when(two, frac).when(one, 1 - frac).otherwise(1.0)
    mix = lambda c: F.when(one | two, F.coalesce(f"{c}1", f"{c}2")).otherwise((1 - frac) * F.col(f"{c}1") + frac * F.col(f"{c}2"))
    return pairs.select("id", F.coalesce("type1", "type2").alias("type"), *map(place, "xyz"), mix("r").alias("r"), (mix("i") * fade).alias("i"), mix("e").alias("e"))


def cubic(pairs: DataFrame, frac: float, unit1: float, unit2: float, box: float | None = None) -> DataFrame:
    """As :func:`linear`, with places on Hermite's curve."""
    return _curved(pairs, frac, unit1, unit2, box, lambda x1, x2, v1, v2: cubic_position(x1, x2, v1, v2, frac))


def orbital_position(x1: np.ndarray, x2: np.ndarray, v1: np.ndarray, v2: np.ndarray, frac: float) -> np.ndarray:
    """``a0 + a1 cos(w f) + a2 sin(w f)`` with ``w / tan(w / 2) = (v1 + v2) / (x2 - x1)``, at most 1.99; velocities as lengths.

    The left side falls from 2 to minus infinity between 0 and 2 pi, so halving finds ``w``; NaN where there is none.
    """
    with np.errstate(all="ignore"):
        target = np.minimum((v1 + v2) / (x2 - x1), 1.99)
        low, high = np.full(len(x1), 1e-9), np.full(len(x1), 2 * math.pi - 1e-12)
        for _ in range(60):
            mid = (low + high) / 2
            above = mid / np.tan(mid / 2) > target
            low, high = np.where(above, mid, low), np.where(above, high, mid)
        w = (low + high) / 2
        s, c = np.sin(w), np.cos(w)
        a2 = v1 / w
        a1 = np.where(np.abs(s) < 1e-6, (x1 - x2 + a2 * s) / (1 - c), (v1 * c - v2) / (w * s))
        out = x1 - a1 + a1 * np.cos(w * frac) + a2 * np.sin(w * frac)
    return np.where(np.isfinite(target), out, np.nan)


def orbital(pairs: DataFrame, frac: float, unit1: float, unit2: float, box: float | None = None) -> DataFrame:
    """As :func:`cubic`, with places on arcs; halving steps need a vectorised function over Arrow batches."""

    @F.pandas_udf("double")
    def place(x1: pd.Series, x2: pd.Series, v1: pd.Series, v2: pd.Series) -> pd.Series:
        return pd.Series(orbital_position(*(s.to_numpy(float) for s in (x1, x2, v1, v2)), frac))

    return _curved(pairs, frac, unit1, unit2, box, place)


def bracket(frames: DataFrame, spacing: float) -> DataFrame:
    """The two snapshots about each frame's index, and the part of the way between them."""
    low = (F.floor(F.col("fidx") / spacing) * spacing).cast("int")
    out = frames.withColumn("snr1", low).withColumn("snr2", (F.col("snr1") + spacing).cast("int"))
    return out.withColumn("frac", (F.col("fidx") - F.col("snr1")) / (F.col("snr2") - F.col("snr1")))
