"""From space to image: periodic boxes, the camera's transform, projection and kernel sizes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.geometry import Camera
from lumenfold.functions.scalar import BFAK, RFAC, truncated


def minimum_image(a: Column, b: Column, box: float) -> Column:
    """``b`` moved by one box, if that is nearer to ``a``."""
    return F.when(b - a > box / 2, b - box).when(b - a < -box / 2, b + box).otherwise(b)


def wrapped(df: DataFrame, centre: tuple[float, float, float], box: float) -> DataFrame:
    """Positions within half a box of ``centre``, by one move."""
    return df.withColumns({c: minimum_image(F.lit(float(v)), F.col(c), box) for c, v in zip("xyz", centre, strict=True)})


def transformed(df: DataFrame, camera: Camera) -> DataFrame:
    m = camera.matrix
    return df.withColumns({c: F.col("x") * float(a) + F.col("y") * float(b) + F.col("z") * float(d) + float(e) for c, (a, b, d, e) in zip("xyz", m, strict=True)})


def projected(df: DataFrame, camera: Camera) -> DataFrame:
    """Pixels ``x, y`` and the size of a unit of length ``f``, of transformed rows in front of the camera."""
    half, tan = camera.xres / 2, math.tan(math.radians(camera.fov) / 2)
    dx, dy = camera.shift
    down = (camera.height - camera.xres) / 2
    if camera.perspective:
        f = -half / (tan * F.col("z"))
    else:
        away = math.dist(camera.center or camera.position, camera.lookat)
        f, dx, dy = F.lit(half / (tan * away)), 0.0, 0.0
    df = df.withColumn("f", f)
    return df.withColumns({"x": half + dx + F.col("x") * F.col("f"), "y": half + dy + down + F.col("y") * F.col("f")})


def kernel_scaled(df: DataFrame, camera: Camera, smooth: dict[int, float] | None = None) -> DataFrame:
    """Radii in pixels, not below the least; intensity is spread over the kernel."""
    smooth = smooth or {}
    by = F.lit(1.0)
    for t, s in smooth.items():
        by = F.when(F.col("type") == t, float(s)).otherwise(by)
    df = df.withColumns({"i": F.col("i") * (0.5 * BFAK) / F.col("r"), "r": F.col("r") * 2 * F.col("f") * by})
    rc = F.sqrt(F.col("r") * F.col("r") + camera.minrad**2) / F.col("r")
    return df.withColumn("rc", rc).withColumns({"r": F.col("r") * F.col("rc"), "i": F.col("i") / F.col("rc")}).drop("rc")


def spans(df: DataFrame, camera: Camera) -> DataFrame:
    """Half-open pixel ranges ``minx..maxx``, ``miny..maxy`` of each disc, cut to the image."""
    w, h = camera.xres, camera.height
    reach = RFAC * F.col("r")
    # cast only what fits an int; beyond the image it doesn't matter how far
    cut = lambda c, n: truncated(c, -2, n + 2)
    return df.withColumns(
        {
            "minx": F.greatest(F.lit(0), cut(F.col("x") - reach + 1, w)),
            "maxx": F.least(F.lit(w), cut(F.col("x") + reach + 1, w)),
            "miny": F.greatest(F.lit(0), cut(F.col("y") - reach + 1, h)),
            "maxy": F.least(F.lit(h), cut(F.col("y") + reach + 1, h)),
        }
    )


def screen_cull(df: DataFrame, camera: Camera) -> DataFrame:
    return spans(df, camera).filter("minx < maxx AND miny < maxy")


def seen(df: DataFrame, camera: Camera, smooth: dict[int, float] | None = None) -> DataFrame:
    """All of the way from space to the pixel ranges of what is seen."""
    from lumenfold.operators.filters import depth_cull

    return screen_cull(kernel_scaled(projected(depth_cull(transformed(df, camera), camera), camera), camera, smooth), camera)
