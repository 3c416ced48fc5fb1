"""HDF5 snapshots, where the optional package ``h5py`` is installed on the driver and all executors.

Tasks read ranges of rows of the bound datasets, so paths must be mounted by every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.snapshots import SCHEMA, _ranges, with_mesh_places

#: What ids of stars are raised by.
STAR_ID = 2_000_000_000


def _file(path: str):
    try:
        import h5py
    except ImportError as e:
        raise ImportError("HDF5 snapshots need the package h5py; Parquet tables need none") from e
    return h5py.File(path, "r")


def fields(path: str) -> dict[str, tuple[int, ...]]:
    """The datasets at a file's root and their shapes."""
    with _file(path) as f:
        return {k: tuple(f[k].shape) for k in f.keys() if hasattr(f[k], "shape")}


def flat(spark: SparkSession, path: str, slots: dict[str, str], *, size: float = 1.0, intensity: float = 0.5, threshold: float = 0.0) -> DataFrame:
    """Datasets of one axis, or cubes; a cube's places are its indices, the last axis fastest as ``z``, unless ``x`` is bound.

    ``slots`` gives each slot's dataset; ``threshold`` is added to the first colour.
    """
    shapes = fields(path)
    shape = shapes[slots["c1"]]
    n = int(np.prod(shape))
    fixed = {"x": 0.0, "y": 0.0, "z": 0.0, "r": size, "i": intensity, "c1": 1.0, "c2": 0.0, "c3": 0.0}

    def rows(data, first: int, end: int) -> np.ndarray:
        if len(data.shape) == 1:
            return np.asarray(data[first:end], "f8")
        plane = int(np.prod(data.shape[1:]))  # whole slices of the first axis hold the range
        lo, hi = first // plane, -(-end // plane)
        return np.asarray(data[lo:hi], "f8").reshape(-1)[first - lo * plane : end - lo * plane]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            with _file(path) as f:
                for first, end in zip(b["first"], b["end"], strict=True):
                    first, end = int(first), int(end)
                    out = {s: rows(f[slots[s]], first, end) if s in slots else np.full(end - first, v) for s, v in fixed.items()}
                    out["c1"] = out["c1"] + threshold
                    yield pd.DataFrame({"pid": np.arange(first, end), "type": np.zeros(end - first, "i4"), **out})

    df = _ranges(spark, n).filter("first < end").mapInPandas(read, SCHEMA)
    if len(shape) == 3 and "x" not in slots:
        # in order of the index the last axis is the fastest, so it takes the place of x, and they are swapped
        df = with_mesh_places(df, (shape[2], shape[1], shape[0])).withColumns({"x": F.col("z"), "z": F.col("x")})
    return df


def compound(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """A dataset of records ``x, y, z, C1, C2, C3, r, I, snapshot``; filter it by ``snapshot``, or take its distinct values."""
    with _file(path) as f:
        n = int(f[dataset].shape[0])
    names = {"x": "x", "y": "y", "z": "z", "r": "r", "I": "i", "C1": "c1", "C2": "c2", "C3": "c3"}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            with _file(path) as f:
                for first, end in zip(b["first"], b["end"], strict=True):
                    part = f[dataset][int(first) : int(end)]
                    yield pd.DataFrame({"pid": np.arange(first, end), "type": np.zeros(len(part), "i4"), **{to: part[name].astype("f8") for name, to in names.items()}, "snapshot": part["snapshot"].astype("i4")})

    return _ranges(spark, n).filter("first < end").mapInPandas(read, SCHEMA + ", snapshot int")


def gadget(spark: SparkSession, path: str, species: list[int], *, size_label: str = "", size_fix: float = 1.0, size_fac: float = 1.0, colour_label: str = "", colour_fac: float = 1.0, intensity_label: str = "") -> DataFrame:
    """Groups ``PartTypeN``; the place of a species in ``species`` is its type. ``size_fix`` 0 takes sizes of ``size_label``.

    Missing: colour (1, 1, 1), intensity 1. Ids of stars (4) are raised by ``STAR_ID``.
    """
    frames = []
    for slot, sp in enumerate(species):
        group = f"PartType{sp}"
        with _file(path) as f:
            shape = tuple(f[f"{group}/Coordinates"].shape) if group in f else (0, 3)
        if len(shape) != 2 or shape[1] != 3:
            raise ValueError(f"{path}: {group}/Coordinates is not N x 3")

        def read(batches: Iterator[pd.DataFrame], group=group, slot=slot) -> Iterator[pd.DataFrame]:
            for b in batches:
                with _file(path) as f:
                    for first, end in zip(b["first"], b["end"], strict=True):
                        first, end = int(first), int(end)
                        get = lambda name: np.asarray(f[f"{group}/{name}"][first:end])  # noqa: B023, E731
                        pos, n = get("Coordinates").astype("f8"), end - first
                        rgb = np.ones((n, 3))
                        if colour_label:
                            c = get(colour_label).astype("f8") * colour_fac
                            rgb = c if c.ndim == 2 else np.column_stack([c, np.zeros(n), np.zeros(n)])
                        yield pd.DataFrame(
                            {
                                "pid": get("ParticleIDs").astype("i8"), "type": np.full(n, slot, "i4"), "x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2],
                                "r": np.full(n, float(size_fix)) if size_fix else get(size_label).astype("f8") * size_fac,
                                "i": get(intensity_label).astype("f8") if intensity_label else np.ones(n),
                                "c1": rgb[:, 0], "c2": rgb[:, 1], "c3": rgb[:, 2],
                            }
                        )

        frame = _ranges(spark, shape[0]).filter("first < end").mapInPandas(read, SCHEMA)
        frames.append(frame.withColumn("pid", F.col("pid") + STAR_ID) if sp == 4 else frame)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
