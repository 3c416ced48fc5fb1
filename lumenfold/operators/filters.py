"""Predicates: species, clips and their masks, culls, samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.geometry import Camera, unit
from lumenfold.operators.selection import numbered


def select_species(df: DataFrame, species: list[str], column: str = "species") -> DataFrame:
    """Rows of the listed species; their place in the list becomes the type."""
    slot = F.create_map(*[F.lit(x) for i, s in enumerate(species) for x in (s, i)])
    return df.filter(F.col(column).isin(*species)).withColumn("type", slot[F.col(column)])


def clipped(df: DataFrame, clips: list[tuple[str, float, float]]) -> DataFrame:
    """Rows within all clips, ends included."""
    for field, low, high in clips:
        df = df.filter(F.col(field).between(low, high))
    return df


def clip_mask(clips: list[tuple[str, float, float]]) -> Column:
    """Bit k is set where the k-th clip drops a row."""
    out = F.lit(0)
    for k, (field, low, high) in enumerate(clips):
        out = out + F.when((F.col(field) < low) | (F.col(field) > high), 1 << k).otherwise(0)
    return out


def depth_cull(df: DataFrame, camera: Camera) -> DataFrame:
    """After the camera's transform: strictly between the near and the far plane."""
    return df.filter((-F.col("z") > max(0.0, camera.zmin)) & (-F.col("z") < camera.zmax))


def far_cull(df: DataFrame, centre: tuple[float, float, float], far: float) -> DataFrame:
    d = sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip("xyz", centre, strict=True)), F.lit(0.0))
    return df.filter(F.sqrt(d) < far)


def cone_reduce(df: DataFrame, normals: list[tuple[float, float, float]]) -> DataFrame:
    """Spheres that reach over none of the side planes, whose normals point outward."""
    keep = F.lit(True)
    for n in normals:
        x, y, z = map(float, unit(n))
        keep = keep & (F.col("r") > F.col("x") * x + F.col("y") * y + F.col("z") * z)
    return df.filter(keep)


def every_kth(df: DataFrame, k: int, order: list[str], by: list[str]) -> DataFrame:
    """A systematic sample: of each group in its order, rows 1, k + 1, ..."""
    return numbered(df, [F.asc(c) for c in order], by, "_nth").filter((F.col("_nth") - 1) % k == 0).drop("_nth")


def box(df: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    for c, a, b in zip("xyz", low, high, strict=True):
        df = df.filter(F.col(c).between(a, b))
    return df


def dome_reduce(df: DataFrame, fov: float) -> DataFrame:
    """Spheres that reach into the cone of half the field of view about +z."""
    away = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    theta = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("z") / F.greatest(away, F.lit(1e-300)))))
    reach = F.asin(F.least(F.lit(1.0), F.col("r") / F.greatest(away, F.lit(1e-300))))
    return df.filter((away <= F.col("r")) | (theta - reach <= math.radians(fov) / 2))
