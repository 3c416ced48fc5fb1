"""Snapshots of unlabelled Fortran records: fixed-order and particle files, and their conversion to labelled records.

A record is its bytes between two equal 4-byte lengths. Where each record lies is read on the driver, by jumping from length to
length; the tasks then read only their rows of the columns that are bound.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.sources.snapshots import SCHEMA, _ranges

#: The records of a fixed-order snapshot, and the labels that they get.
ORDER = ("HEAD", "POS ", "VEL ", "ID  ", "HSML", "RHO ", "VDSP")
#: The records before a particle file's arrays, and the arrays.
PARTICLE_HEADER = 8
PARTICLE_ARRAYS = ("x", "y", "z", "vx", "vy", "vz", "mass")


def places(path: str, order: str = "") -> tuple[list[tuple[int, int]], str]:
    """(offset, bytes) of every record, and the byte order; unless given, the order is that in which the first record fits."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        if not order:
            first = f.read(4)
            n = struct.unpack("<i", first)[0]
            order = "<" if 0 <= n <= size - 8 else ">"
        at, out = 0, []
        while at + 8 <= size:
            f.seek(at)
            n = struct.unpack(order + "i", f.read(4))[0]
            f.seek(at + 4 + n)
            if n < 0 or f.read(4) != struct.pack(order + "i", n):
                raise ValueError(f"{path}: the record at {at} does not end with its length")
            out.append((at + 4, n))
            at += n + 8
    return out, order


def gadget1(spark: SparkSession, path: str, species: list[int], *, size_fix: float = 1.0, size_fac: float = 1.0, colour: int = 0, colour_fac: float = 1.0, intensity: int = 0, intensity_fac: float = 1.0, present: dict[str, int] | None = None) -> DataFrame:
    """Header, places, velocities, ids, sizes, densities and velocity dispersions, in this order.

    ``colour``: 0 the velocity's three parts, 1 density, 2 dispersion; ``intensity``: 0 is 1, else as for ``colour``.
    ``size_fix`` other than 0 is every size. ``present``: bits of the species that a record holds, by its label in ``ORDER``.
    """
    if colour not in (0, 1, 2) or intensity not in (0, 1, 2):
        raise ValueError("colour and intensity are 0, 1 or 2")
    found, order = places(path)
    at = dict(zip(ORDER, found, strict=False))
    if not found or found[0][1] != 256:
        raise ValueError(f"{path}: the header is not of 256 bytes")
    with open(path, "rb") as f:
        f.seek(found[0][0])
        npart = struct.unpack(order + "6i", f.read(24))
    total, bits = sum(npart), present or {}
    wide = "i8" if at["ID  "][1] > 4 * total else "u4"
    scalar = {0: "VEL ", 1: "RHO ", 2: "VDSP"}
    for label in {scalar[colour], *([scalar[intensity]] if intensity else []), *(["HSML"] if size_fix == 0 else [])}:
        if label not in at:
            raise ValueError(f"{path}: no record for {label.strip()}")
    frames = []
    for slot, sp in enumerate(species):

        def read(batches: Iterator[pd.DataFrame], sp=sp, slot=slot) -> Iterator[pd.DataFrame]:
            def column(label: str, kind: str, width: int, first: int, size: int) -> np.ndarray:
                before = sum(n for k, n in enumerate(npart[:sp]) if bits.get(label, 63) >> k & 1)
                item = np.dtype(order + kind)
                return np.fromfile(path, item, size * width, offset=at[label][0] + item.itemsize * width * (before + first)).reshape(size, width)

            for b in batches:
                for first, end in zip(b["first"], b["end"], strict=True):
                    first, size = int(first), int(end - first)
                    pos = column("POS ", "f4", 3, first, size).astype("f8")
                    rgb = np.zeros((size, 3))
                    width = 1 if colour else 3
                    rgb[:, :width] = column(scalar[colour], "f4", width, first, size) * colour_fac
                    yield pd.DataFrame(
                        {
                            "pid": column("ID  ", wide, 1, first, size)[:, 0].astype("i8"), "type": np.full(size, slot, "i4"), "x": pos[:, 0], "y": pos[:, 1], "z": pos[:, 2],
                            "r": np.full(size, float(size_fix)) if size_fix else column("HSML", "f4", 1, first, size)[:, 0].astype("f8") * size_fac,
                            "i": column(scalar[intensity], "f4", 1, first, size)[:, 0].astype("f8") * intensity_fac if intensity else np.ones(size),
                            "c1": rgb[:, 0], "c2": rgb[:, 1], "c3": rgb[:, 2],
                        }
                    )

        frames.append(_ranges(spark, npart[sp]).filter("first < end").mapInPandas(read, SCHEMA))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _label_record(label: str, size: int, order: str) -> bytes:
    return struct.pack(order + "i", 8) + label.ljust(4)[:4].encode() + struct.pack(order + "ii", size + 8, 8)


def labelled(source: str, target: str, labels: tuple[str, ...] = ORDER, *, piece: int = 1 << 24) -> None:
    """A fixed-order file as one of labelled records; bytes are copied piece by piece."""
    found, order = places(source)
    with open(source, "rb") as f, open(target, "wb") as out:
        for label, (at, n) in zip(labels, found, strict=False):
            out.write(_label_record(label, n, order) + struct.pack(order + "i", n))
            f.seek(at)
            for done in range(0, n, piece):
                out.write(f.read(min(piece, n - done)))
            out.write(struct.pack(order + "i", n))


def append_block(path: str, label: str, values: np.ndarray) -> None:
    """One more labelled record of float32 at the end of a labelled file, in the file's byte order."""
    with open(path, "rb") as f:
        order = "<" if f.read(4) == struct.pack("<i", 8) else ">"
    data = np.asarray(values).astype(order + "f4").tobytes()
    with open(path, "ab") as out:
        out.write(_label_record(label, len(data), order) + struct.pack(order + "i", len(data)) + data + struct.pack(order + "i", len(data)))


def particle_files(spark: SparkSession, paths: list[str], box: float, *, scale: float = 1.0, smooth: float = 1.0, intensity: str | None = None, colours: tuple[str, str, str] = ("vx", "vy", "vz"), type: int = 0, step: int = 1) -> DataFrame:
    """Particles of a mesh simulation, a file of records per domain; the box is centred on the origin.

    ``intensity`` (else 1) and ``colours`` name arrays of ``PARTICLE_ARRAYS``; of every file each ``step``-th row is kept.
    Floats may have 4 or 8 bytes, which the length of the first array tells.
    """
    ranges, plans, first = [], [], 0
    for path in paths:
        found, order = places(path)
        with open(path, "rb") as f:
            f.seek(found[1][0])
            dims = struct.unpack(order + "i", f.read(4))[0]
            f.seek(found[2][0])
            n = struct.unpack(order + "i", f.read(4))[0]
        if dims != 3:
            raise ValueError(f"{path}: {dims} dimensions")
        width = found[PARTICLE_HEADER][1] // n if n else 4
        if n and width not in (4, 8):
            raise ValueError(f"{path}: floats of {width} bytes")
        plans.append((path, order, width, {name: at for name, (at, _) in zip(PARTICLE_ARRAYS, found[PARTICLE_HEADER:], strict=False)}))
        ranges.append((first, n))
        first += n

    frames = []
    for (path, order, width, at), (base, n) in zip(plans, ranges, strict=True):

        def read(batches: Iterator[pd.DataFrame], path=path, kind=f"{order}f{width}", width=width, at=at, base=base) -> Iterator[pd.DataFrame]:
            for b in batches:
                for lo, hi in zip(b["first"], b["end"], strict=True):
                    lo, size = int(lo), int(hi - lo)
                    keep = (np.arange(lo, lo + size) % step) == 0
                    get = lambda name: np.fromfile(path, kind, size, offset=at[name] + width * lo).astype("f8")[keep]  # noqa: B023, E731
                    xyz = {c: (get(c) - box / 2) * scale for c in "xyz"}
                    rows = int(keep.sum())
                    light = get(intensity) if intensity else np.ones(rows)
                    yield pd.DataFrame({"pid": base + np.arange(lo, lo + size)[keep], "type": np.full(rows, type, "i4"), **xyz, "r": np.full(rows, float(smooth)), "i": light, **{f"c{k}": get(c) for k, c in enumerate(colours, 1)}})

        frames.append(_ranges(spark, n).filter("first < end").mapInPandas(read, SCHEMA))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def hierarchy(text: str) -> list[dict]:
    """Tiles of an adaptive mesh from its hierarchy: starts, ends, edges and file of every grid, axes in the order x, y, z.

    Index ranges count three ghost cells at their start; the file's axes run z, y, x.
    """
    out: list[dict] = []
    for line in text.splitlines():
        key, _, value = line.partition("=")
        key, cells = key.strip(), value.split()
        if key == "Grid":
            out.append({"tile": int(cells[0])})
        elif out and key in ("GridStartIndex", "GridEndIndex"):
            out[-1] |= {f"{'start' if key == 'GridStartIndex' else 'end'}_{c}": int(v) - 3 for c, v in zip("zyx", cells, strict=True)}
        elif out and key in ("GridLeftEdge", "GridRightEdge"):
            out[-1] |= {f"{'left' if key == 'GridLeftEdge' else 'right'}_{c}": float(v) for c, v in zip("zyx", cells, strict=True)}
        elif out and key == "BaryonFileName":
            out[-1]["file"] = os.path.basename(cells[0])
    for t in out:
        t |= {f"n{c}": t[f"end_{c}"] - t[f"start_{c}"] + 1 for c in "xyz"}
    return out


def tiles(spark: SparkSession, text: str) -> DataFrame:
    """The hierarchy as the table that ``snapshots.amr_tiles`` takes; one row a tile."""
    edges = [f"{side}_{c}" for side in ("left", "right") for c in "xyz"]
    counts = ["nx", "ny", "nz"]
    rows = [(t["tile"], t.get("file"), *[t[e] for e in edges], *[t[n] for n in counts]) for t in hierarchy(text)]
    return spark.createDataFrame(rows, "tile int, file string, " + ", ".join(f"{e} double" for e in edges) + ", nx int, ny int, nz int")


def bound(df: DataFrame, slots: dict[str, str], *, size: float = 1.0, intensity: float = 0.5, type: int = 0) -> DataFrame:
    """A table of named columns as particles: ``slots`` gives each slot's column.

    Unbound: the size and intensity given, ``c1`` 1, ``c2`` and ``c3`` 0; without ``pid``, a hash of the bound columns.
    """
    fixed = {"x": 0.0, "y": 0.0, "z": 0.0, "r": size, "i": intensity, "c1": 1.0, "c2": 0.0, "c3": 0.0}
    missing = set(slots.values()) - set(df.columns)
    if missing:
        raise ValueError(f"no columns {sorted(missing)}; there are {df.columns}")
    pid = F.col(slots["pid"]).cast("long") if "pid" in slots else F.xxhash64(*slots.values())
    return df.select(pid.alias("pid"), F.lit(type).alias("type"), *[(F.col(slots[s]).cast("double") if s in slots else F.lit(float(v))).alias(s) for s, v in fixed.items()])
