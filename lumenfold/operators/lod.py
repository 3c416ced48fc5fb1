"""Level of detail: grid cells, weights by view, stratified samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators.selection import numbered


def grid(df: DataFrame, *, per_cell: float = 5.0, most: int = 32) -> DataFrame:
    """``cell`` of every row: a box padded by 1 %, cells of ``per_cell`` mean spacings, at most ``most`` an axis.

    The box is one row, joined back as a broadcast.
    """
    box = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}_{k}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max))])
    low = lambda c: F.col(f"{c}_lo") - 0.01 * F.abs(f"{c}_lo")
    box = box.select("n", *[low(c).alias(f"{c}_lo") for c in "xyz"], *[(F.col(f"{c}_hi") + 0.01 * F.abs(f"{c}_hi") - low(c)).alias(f"{c}_len") for c in "xyz"])
    box = box.withColumn("side", per_cell * F.pow(F.col("x_len") * F.col("y_len") * F.col("z_len") / F.col("n"), F.lit(1 / 3)))
    number = lambda c: F.ceil(F.col(f"{c}_len") / F.col("side"))
    box = box.withColumns({f"{c}_d": F.when(number(c) > most, F.col(f"{c}_len") / most).otherwise(F.col("side")) for c in "xyz"} | {f"{c}_n": F.least(F.lit(most), number(c)).cast("int") for c in "xyz"})
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"{c}_lo")) / F.col(f"{c}_d")), F.col(f"{c}_n") - 1).cast("int")
    cells = df.crossJoin(F.broadcast(box)).withColumn("cell", at("z") + F.col("z_n") * (at("y") + F.col("y_n") * at("x")))
    return cells.select(*df.columns, "cell")


def offsets(cells: DataFrame) -> DataFrame:
    """Rows of each cell, and of all cells before it; there are at most 32768 cells."""
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("offset", F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))


def gauss(d: Column, sigma: Column | float) -> Column:
    s = F.lit(float(sigma)) if isinstance(sigma, float) else sigma
    return F.exp(-(d * d) / (2 * s * s))


def weights(cells: DataFrame, *, diagonal: float, quality: float, fov: float, dist: float, zmin: float = 0.0, zmax: float = 1e23) -> DataFrame:
    """``active`` and ``weight`` of cells of one ``diagonal`` whose centres are ``x, y, z`` before the camera (z ahead)."""
    side = math.sqrt(2) * F.col("z") * math.tan(math.radians(fov) / 2)
    inner = lambda c: F.col(c) - F.when(F.col(c) < 0, -diagonal).otherwise(diagonal)
    lateral = F.sqrt(inner("x") * inner("x") + inner("y") * inner("y"))
    active = (F.col("z") > max(0.0, zmin)) & (F.col("z") < zmax) & (lateral <= side)
    return cells.withColumn("active", active).withColumn("weight", F.when(active, quality * gauss(lateral, side) * gauss(F.col("z"), float(dist))).otherwise(0.0))


def stratified(df: DataFrame, share: Column | float, order: list[Column]) -> DataFrame:
    """The first ``floor(share * n)`` of every cell in ``order``, a hash or an arithmetic key, and ``boost``: how much brighter
    each is to be, so that a cell stays as bright as all its ``n`` rows are."""
    counts = df.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.floor(share * F.col("_n")))
    return numbered(df, order, ["cell"], "_nth").join(counts, "cell").filter(F.col("_nth") <= F.col("_k")).select(*df.columns, (F.col("_n") / F.col("_k")).alias("boost"))


def boosted(df: DataFrame) -> DataFrame:
    """Intensities of a sample times its ``boost``."""
    return df.withColumn("i", F.col("i") * F.col("boost")).drop("boost")


def octave(r: Column, smallest: float) -> Column:
    """Level of a radius: 0 up to twice the smallest, 1 up to four times, ..."""
    return F.greatest(F.lit(0), F.ceil(F.log2(r / smallest)) - 1).cast("int")
