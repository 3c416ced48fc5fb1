"""Ray renderer: particles as discs on the unit sphere, pixels as directions; flat and dome projections.

Emission adds up, so every task draws its own particles into an image of its own and only these images' pixels meet in a
sum: no particle travels, whatever the size of the image or of a group. Within a task particles are sorted into blocks of
pixels that their discs may touch, so no pair of a particle and a far pixel is formed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.geometry import Camera, unit
from lumenfold.functions.scalar import H2SIGMA

BLOCK = 16


def directions(camera: Camera, dome: bool = False):
    """A function from pixel grids to unit directions (and whether a pixel is in the image)."""
    forward = unit(np.subtract(camera.lookat, camera.position))
    right = unit(np.cross(forward, camera.sky))
    up = np.cross(right, forward)
    w, h, half = camera.xres, camera.height, math.radians(camera.fov) / 2

    def flat(x, y):
        t = math.tan(half) / (w / 2)
        d = forward + ((x - w / 2)[..., None] * right + (y - h / 2)[..., None] * up) * t
        return d / np.linalg.norm(d, axis=-1, keepdims=True), np.ones(x.shape, bool)

    def fish(x, y):
        u, v = (x - w / 2) / (w / 2), (y - h / 2) / (w / 2)
        rho = np.hypot(u, v)
        theta, safe = rho * half, np.maximum(rho, 1e-300)
        d = np.cos(theta)[..., None] * forward + (np.sin(theta) * u / safe)[..., None] * right + (np.sin(theta) * v / safe)[..., None] * up
        return d, rho <= 1

    return fish if dome else flat


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function: its Taylor terms in steps of ``H`` from exact values, good to some 1e-13 of the value at 0."""
    h = 0.0625
    at = np.round(np.clip(x, -6.5, 6.5) / h)
    d = np.clip(x, -6.5, 6.5) - at * h
    known = np.array([math.erfc(k * h) for k in range(-104, 105)])[(at + 104).astype(int)]
    a = at * h
    # derivatives of erfc are exp(-a^2) times Hermite polynomials, by their recursion
    before, poly, term, series = np.zeros_like(a), np.ones_like(a), d.copy(), d.copy()
    for n in range(1, 9):
        before, poly = poly, 2 * a * poly - 2 * (n - 1) * before
        term = term * -d / (n + 1)
        series = series + term * poly
    return known - 2 / math.sqrt(math.pi) * np.exp(-a * a) * series


def render(df: DataFrame, camera: Camera, *, dome: bool = False, overlap: bool = True) -> DataFrame:
    """Optical depth ``x, y, red, green, blue`` from ``x, y, z, r, red, green, blue``, particles not farther than the far plane.

    What holds the camera within it (radius at least the distance) counts by the part of its kernel that lies ahead.
    """
    pos = [F.col(c) - float(v) for c, v in zip("xyz", camera.position, strict=True)]
    away = F.sqrt(pos[0] * pos[0] + pos[1] * pos[1] + pos[2] * pos[2])
    d = df.withColumn("away", away).filter((F.col("away") < camera.zmax) & (F.col("away") > 0))
    d = d.select(*[(p / F.col("away")).alias(f"c{i}") for i, p in enumerate(pos)], (F.col("r") / F.col("away")).alias("r"), "red", "green", "blue")
    pixel = 2 * math.tan(math.radians(camera.fov) / 2) / camera.xres if not dome else math.radians(camera.fov) / camera.xres
    least = camera.minrad * pixel
    d = d.withColumn("wide", F.sqrt(F.col("r") * F.col("r") + least * least))
    thin = F.pow(F.col("r") / F.col("wide"), F.lit(2.0))
    d = d.withColumns({c: F.col(c) * thin for c in ("red", "green", "blue")}).withColumn("r", F.col("wide")).drop("wide")
    w, h = camera.xres, camera.height
    at = directions(camera, dome)
    corners = []
    for bx in range(0, w, BLOCK):
        for by in range(0, h, BLOCK):
            x, y = np.meshgrid(np.arange(bx, min(w, bx + BLOCK)), np.arange(by, min(h, by + BLOCK)), indexing="ij")
            dirs, inside = at(x.astype(float), y.astype(float))
            if inside.any():
                mid = unit(dirs[inside].mean(axis=0))
                corners.append((bx, by, mid, float(np.arccos(np.clip(dirs[inside] @ mid, -1, 1)).max())))
    centres, reach = np.array([c[2] for c in corners]), np.array([c[3] for c in corners])

    def draw(bx: int, by: int, group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = np.meshgrid(np.arange(bx, min(w, bx + BLOCK)), np.arange(by, min(h, by + BLOCK)), indexing="ij")
        dirs, inside = at(x.astype(float), y.astype(float))
        dirs, x, y = dirs[inside], x[inside], y[inside]
        total = np.zeros((len(x), 3))
        for lo in range(0, len(group), 4096):
            g = group.iloc[lo : lo + 4096]
            cos = dirs @ g[["c0", "c1", "c2"]].to_numpy().T
            r = g["r"].to_numpy()
            part = np.exp(-(1 - cos) * (1 + cos) / (r * r * H2SIGMA * H2SIGMA))
            small = r <= 1
            hit = (cos >= 0) & (cos * cos >= (1 - r) * (1 + r))
            weight = np.where(hit & small, part, 0.0)
            if overlap and not small.all():
                weight[:, ~small] = 0.5 * erfc(-cos[:, ~small] / (r[~small] * H2SIGMA)) * part[:, ~small]
            total += weight @ g[["red", "green", "blue"]].to_numpy()
        return x, y, total

    def images(batches):
        """The task's own image, and nothing else; at most as many rows as pixels."""
        image = np.zeros((w, h, 3))
        lit = np.zeros((w, h), bool)
        for b in batches:
            c = b[["c0", "c1", "c2"]].to_numpy()
            for lo in range(0, len(b), 8192):
                some = b.iloc[lo : lo + 8192]
                angle = np.arccos(np.clip(c[lo : lo + 8192] @ centres.T, -1, 1))
                size = np.where(some["r"] >= 1, math.pi, np.arcsin(np.minimum(some["r"], 1.0)))
                j, i = np.nonzero((angle <= size[:, None] + reach[None, :] + 1e-9).T)
                edges = np.searchsorted(j, np.arange(len(corners) + 1))
                for k in np.flatnonzero(np.diff(edges)):
                    x, y, total = draw(*corners[k][:2], some.iloc[i[edges[k] : edges[k + 1]]])
                    image[x, y] += total
                    lit[x, y] = True
        x, y = np.nonzero(lit)
        yield pd.DataFrame({"x": x.astype("int32"), "y": y.astype("int32"), "red": image[x, y, 0], "green": image[x, y, 1], "blue": image[x, y, 2]})

    drawn = d.mapInPandas(images, "x int, y int, red double, green double, blue double")
    return drawn.groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in ("red", "green", "blue")])
