"""Binary snapshots as particle DataFrames.

Fixed-width formats are read in ranges of rows: one task a range, and only the bound columns of it. The readers seek in
files, so paths must be those of a file system that every executor mounts; on other stores, convert to Parquet first.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a task.
RANGE = 1_000_000
SLOTS = ("x", "y", "z", "r", "i", "c1", "c2", "c3")
SCHEMA = "pid long, type int, x double, y double, z double, r double, i double, c1 double, c2 double, c3 double"


def _ranges(spark: SparkSession, n: int) -> DataFrame:
    parts = max(1, -(-n // RANGE))
    return spark.range(0, parts, 1, parts).select((F.col("id") * RANGE).alias("first"), F.least(F.lit(n), (F.col("id") + 1) * RANGE).alias("end"))


def _float(swap: bool) -> str:
    return ">f4" if swap else "<f4"


def raw(spark: SparkSession, path: str, columns: int, bound: dict[str, int], *, block: bool = False, swap: bool = False, smooth: float = 1.0) -> DataFrame:
    """A table of float32, row after row, or column after column with ``block``; ``bound`` gives slots' columns from 1.

    Unbound: ``r`` is ``smooth``, ``i`` 0.5, ``c1`` 1, ``c2`` and ``c3`` 0 (in a row table, unless both are bound).
    """
    n = os.path.getsize(path) // (4 * columns)
    kind = _float(swap)
    use = {s: c for s, c in bound.items() if c > 0}
    if not block and ("c2" in use) != ("c3" in use):
        use = {s: c for s, c in use.items() if s not in ("c2", "c3")}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, end in zip(b["first"], b["end"], strict=True):
                size = int(end - first)
                if block:
                    get = lambda c: np.fromfile(path, kind, size, offset=4 * ((c - 1) * n + int(first)))  # noqa: B023, E731
                else:
                    rows = np.fromfile(path, kind, size * columns, offset=4 * columns * int(first)).reshape(size, columns)
                    get = lambda c: rows[:, c - 1]  # noqa: B023, E731
                fixed = {"x": 0.0, "y": 0.0, "z": 0.0, "r": smooth, "i": 0.5, "c1": 1.0, "c2": 0.0, "c3": 0.0}
                out = {s: get(use[s]).astype("f8") * (smooth if s == "r" else 1.0) if s in use else np.full(size, v) for s, v in fixed.items()}
                yield pd.DataFrame({"pid": np.arange(first, end), "type": np.zeros(size, "i4"), **out})

    return _ranges(spark, n).mapInPandas(read, SCHEMA)


def mesh(spark: SparkSession, path: str, shape: tuple[int, int, int], blocks: dict[str, int], *, fortran: bool = False, swap: bool = False, radius: float = 1.0) -> DataFrame:
    """Blocks of float32 over a grid; places come from the running index."""
    n = shape[0] * shape[1] * shape[2]
    kind = _float(swap)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for first, end in zip(b["first"], b["end"], strict=True):
                size = int(end - first)
                get = {s: np.fromfile(path, kind, size, offset=4 * ((c - 1) * n + int(first))).astype("f8") for s, c in blocks.items()}
                yield pd.DataFrame({"pid": np.arange(first, end), **{s: get.get(s, np.full(size, v)) for s, v in (("i", 0.5), ("c1", 1.0), ("c2", 0.0), ("c3", 0.0))}})

    values = _ranges(spark, n).mapInPandas(read, "pid long, i double, c1 double, c2 double, c3 double")
    return with_mesh_places(values, shape, fortran=fortran).withColumns({"r": F.lit(float(radius)), "type": F.lit(0)}).select("pid", "type", *SLOTS)


def with_mesh_places(df: DataFrame, shape: tuple[int, int, int], *, fortran: bool = False) -> DataFrame:
    """``x, y, z`` from ``pid``: x runs fastest; in Fortran's order the first and the last axis are swapped."""
    dx, dy = (shape[2] if fortran else shape[0]), shape[1]
    i = F.col("pid")
    return df.withColumns({"x": F.pmod(i, F.lit(dx)).cast("double"), "y": F.floor(F.pmod(i, F.lit(dx * dy)) / dx).cast("double"), "z": F.floor(i / (dx * dy)).cast("double")})


HEADER = struct.Struct("6i6dddii6iiiddddii")


def gadget_blocks(path: str) -> tuple[dict[str, tuple[int, int]], str]:
    """Where each labelled block's data lie (offset, bytes), and the file's byte order."""
    with open(path, "rb") as f:
        order = "<" if f.read(4) == struct.pack("<i", 8) else ">"
        size, at, out = os.path.getsize(path), 0, {}
        while at + 16 <= size:
            f.seek(at + 4)
            label = f.read(4).decode("latin1")
            f.seek(at + 16)
            n = struct.unpack(order + "i", f.read(4))[0]
            out[label] = (at + 20, n)
            at += 16 + 8 + n
    return out, order


def gadget_header(path: str) -> dict:
    blocks, order = gadget_blocks(path)
    with open(path, "rb") as f:
        f.seek(blocks["HEAD"][0])
        v = struct.unpack(order + HEADER.format.lstrip("<>="), f.read(HEADER.size))
    return {"npart": v[:6], "mass": v[6:12], "time": v[12], "redshift": v[13], "total": v[16:22], "files": v[23], "boxsize": v[24], "omega": v[25], "lambda": v[26], "hubble": v[27]}


def gadget2(spark: SparkSession, path: str, species: list[int], *, size_label: str = "HSML", size_fix: float = 1.0, size_fac: float = 1.0, colour_label: str = "", colour_fac: float = 1.0, intensity_label: str = "", present: dict[str, int] | None = None, ids: bool = True, velocities: bool = False) -> DataFrame:
    """Labelled records; the place of a species in ``species`` becomes its type. ``present``: bits of the species in a block.

    Missing blocks: size ``size_fix``, colour (1, 1, 1), intensity 1. Ids of gas lose their high bits, stars get one.
    """
    blocks, order = gadget_blocks(path)
    npart = gadget_header(path)["npart"]
    present = present or {}
    total = sum(npart)

    def start(label: str, sp: int) -> int | None:
        """The place of the species' first row among the block's rows."""
        bits = present.get(label, 63)
        return sum(n for k, n in enumerate(npart[:sp]) if bits >> k & 1) if bits >> sp & 1 else None

    frames = []
    for slot, sp in enumerate(species):
        n = npart[sp]

        def read(batches: Iterator[pd.DataFrame], sp=sp, slot=slot) -> Iterator[pd.DataFrame]:
            def column(label: str, width: int, first: int, size: int, kind: str = "f4") -> np.ndarray | None:
                if label not in blocks or start(label, sp) is None:
                    return None
                item = np.dtype(order + kind)
                at = blocks[label][0] + item.itemsize * width * (start(label, sp) + first)
                return np.fromfile(path, item, size * width, offset=at).reshape(size, width)

            for b in batches:
                for first, end in zip(b["first"], b["end"], strict=True):
                    first, size = int(first), int(end - first)
                    pos = column("POS ", 3, first, size)
                    hsml = None if size_fix else column(size_label.ljust(4), 1, first, size)
                    pick = colour_label.ljust(4)
                    width = 3 if pick in blocks and blocks[pick][1] == 12 * total else 1
                    col = column(pick, width, first, size) if colour_label else None
                    inten = column(intensity_label.ljust(4), 1, first, size) if intensity_label else None
                    wide = "i8" if "ID  " in blocks and blocks["ID  "][1] == 8 * total else "u4"
                    key = column("ID  ", 1, first, size, wide) if ids else None
                    vel = column("VEL ", 3, first, size) if velocities else None
                    ones = np.ones(size)
                    colours = [ones * 1.0] * 3 if col is None else [col[:, min(k, width - 1)] * colour_fac if k < width else ones * 0 for k in range(3)]
                    yield pd.DataFrame(
                        {
                            "pid": np.arange(first, first + size) if key is None else key[:, 0].astype("i8"),
                            "type": np.full(size, slot, "i4"),
                            "x": pos[:, 0].astype("f8"), "y": pos[:, 1].astype("f8"), "z": pos[:, 2].astype("f8"),
                            "r": np.full(size, size_fix) if hsml is None else hsml[:, 0].astype("f8") * size_fac,
                            "i": ones if inten is None else inten[:, 0].astype("f8"),
                            "c1": colours[0].astype("f8"), "c2": colours[1].astype("f8"), "c3": colours[2].astype("f8"),
                        }
                        | ({f"v{c}": vel[:, k].astype("f8") for k, c in enumerate("xyz")} if velocities else {})
                    )

        frame = _ranges(spark, n).filter("first < end").mapInPandas(read, SCHEMA + ", vx double, vy double, vz double" * velocities)
        wide = "ID  " in blocks and blocks["ID  "][1] == 8 * total
        frames.append(frame.withColumn("pid", patched_id(F.col("pid"), sp, wide)) if ids and "ID  " in blocks else frame)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def patched_id(pid: F.Column, species: int, wide: bool = False) -> F.Column:
    """Gas (0) keeps the low 30 or 60 bits; stars (4) get bit 29 or 60."""
    if species == 0:
        return pid.bitwiseAND(F.lit((1 << (60 if wide else 30)) - 1))
    if species == 4:
        return pid + F.lit(1 << (60 if wide else 29))
    return pid


def packed_id(pid: F.Column) -> tuple[F.Column, F.Column]:
    """The low 48 bits, and the 16 above them."""
    return pid.bitwiseAND(F.lit((1 << 48) - 1)), F.shiftrightunsigned(pid, 48)


def suggested(df: DataFrame) -> dict:
    """Camera and size for a first look: from the box of all places and how many there are."""
    r = df.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{k}") for c in "xyz" for k, f in (("0", F.min), ("1", F.max))]).first()
    mid = [(r[f"{c}0"] + r[f"{c}1"]) / 2 for c in "xyz"]
    span = [r[f"{c}1"] - r[f"{c}0"] for c in "xyz"]
    return {"lookat": mid, "camera": [mid[0], mid[1] - 1.5 * max(span), mid[2]], "size_fix": (span[0] * span[1] * span[2] / r["n"]) ** (1 / 3) / 5}


def tipsy(spark: SparkSession, path: str, bound: dict[int, dict[str, int]] | None = None, *, order: str = ">") -> DataFrame:
    """Gas, dark matter and stars of 12, 9 and 11 float32; ``bound`` gives each type's slots' columns from 1. x, y, z are 2 to 4."""
    with open(path, "rb") as f:
        _, _, _, *n = struct.unpack(order + "d5i", f.read(28))
    widths, bound = (12, 9, 11), bound or {}
    frames, at = [], 32
    for t in range(3):
        offset, width, use = at, widths[t], {"x": 2, "y": 3, "z": 4} | {s: c for s, c in bound.get(t, {}).items() if c > 0}

        def read(batches: Iterator[pd.DataFrame], t=t, offset=offset, width=width, use=use) -> Iterator[pd.DataFrame]:
            for b in batches:
                for first, end in zip(b["first"], b["end"], strict=True):
                    size = int(end - first)
                    rows = np.fromfile(path, order + "f4", size * width, offset=offset + 4 * width * int(first)).reshape(size, width)
                    fixed = {"x": 0.0, "y": 0.0, "z": 0.0, "r": 1.0, "i": 0.5, "c1": 1.0, "c2": 0.0, "c3": 0.0}
                    out = {s: rows[:, use[s] - 1].astype("f8") if s in use else np.full(size, v) for s, v in fixed.items()}
                    yield pd.DataFrame({"pid": np.arange(first, end) + sum(n[:t]), "type": np.full(size, t, "i4"), **out})  # noqa: B023

        if n[t]:
            frames.append(_ranges(spark, n[t]).mapInPandas(read, SCHEMA))
        at += 4 * width * n[t]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def fits(spark: SparkSession, path: str, first: int = 0, last: int | None = None, *, radius: float = 1.0) -> DataFrame:
    """A cube of float32; slices from ``first`` up to before ``last``; places are pixels' indices, NaN becomes 0."""
    with open(path, "rb") as f:
        cards, blocks = {}, 0
        while "END" not in cards:
            page = f.read(2880).decode("ascii")
            blocks += 1
            for i in range(0, len(page), 80):
                key, _, value = page[i : i + 80].partition("=")
                cards.setdefault(key.strip(), value.split("/")[0].strip())
    nx, ny, nz = (int(cards[f"NAXIS{i}"]) for i in (1, 2, 3))
    last = nz if last is None else min(last, nz)
    start = 2880 * blocks + 4 * nx * ny * first
    n = nx * ny * max(0, last - first)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo, hi in zip(b["first"], b["end"], strict=True):
                v = np.nan_to_num(np.fromfile(path, ">f4", int(hi - lo), offset=start + 4 * int(lo)).astype("f8"), nan=0.0)
                yield pd.DataFrame({"pid": np.arange(lo, hi) + nx * ny * first, "c1": v})

    values = _ranges(spark, n).mapInPandas(read, "pid long, c1 double")
    cube = with_mesh_places(values, (nx, ny, nz))
    return cube.withColumns({"r": F.lit(float(radius)), "i": F.lit(0.5), "c2": F.lit(0.0), "c3": F.lit(0.0), "type": F.lit(0)}).select("pid", "type", *SLOTS)


def bonsai(stars: DataFrame, dark: DataFrame, *, r: tuple[float, float] = (1.0, 1.0), i: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Stars, then dark matter, from ``pid, x, y, z, h, rho``."""
    def side(df: DataFrame, t: int) -> DataFrame:
        return df.select("pid", F.lit(t).alias("type"), "x", "y", "z", (F.col("h") * r[t]).alias("r"), F.when(F.col("h") > 0, i[t] * F.log10("h")).alias("i"), F.log10(F.col("rho") + 1e-7).alias("c1"), F.lit(0.0).alias("c2"), F.lit(0.0).alias("c3"))

    return side(stars, 0).unionByName(side(dark, 1))


#: Columns (from 1) of the survey catalogue.
CATALOGUE = {"x": 16, "y": 17, "z": 18, "g": 29, "r_band": 31, "i_band": 33, "z_band": 35}


def catalogue(spark: SparkSession, path: str, code: int = 5, *, radius: float = 1.0) -> DataFrame:
    """Lines of at least 39 columns by white space; colour 1 to 4 is a band, 5 to 7 the green band less red, infrared and z."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.size(cells) >= 39)
    rows = rows.select(*[F.element_at(cells, at).cast("double").alias(name) for name, at in CATALOGUE.items()])
    g, r, i, z = (F.col(c) for c in ("g", "r_band", "i_band", "z_band"))
    colour = {1: g, 2: r, 3: i, 4: z, 5: g - r, 6: g - i, 7: g - z}[code]
    return rows.select(F.monotonically_increasing_id().alias("pid"), F.lit(0).alias("type"), "x", "y", "z", F.lit(float(radius)).alias("r"), F.lit(1.0).alias("i"), colour.alias("c1"), F.lit(0.0).alias("c2"), F.lit(0.0).alias("c3"))


def amr_tiles(tiles: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float], levels: int, base: float) -> DataFrame:
    """Tiles (``left_x.. right_x.., nx, ny, nz``) that meet a box, not finer than ``levels``, exploded to cells within the box."""
    dx = (F.col("right_x") - F.col("left_x")) / F.col("nx")
    kept = tiles.withColumn("dx", dx).withColumn("level", F.floor(F.log2(F.lit(float(base)) / F.col("dx")) + 1e-9).cast("int")).filter(F.col("level") <= levels - 1)
    for c, a, b in zip("xyz", low, high, strict=True):
        kept = kept.filter((F.col(f"left_{c}") < b) & (F.col(f"right_{c}") > a))
    for c in "xyz":
        kept = kept.withColumn(f"i{c}", F.explode(F.sequence(F.lit(0), F.col(f"n{c}") - 1)))
    cells = kept.select("tile", "level", "dx", *[(F.col(f"left_{c}") + F.col("dx") * F.col(f"i{c}")).alias(c) for c in "xyz"])
    for c, a, b in zip("xyz", low, high, strict=True):
        cells = cells.filter((F.col(c) >= a) & (F.col(c) < b))
    return cells


def amr_leaves(cells: DataFrame, *, seed: int = 0, scale: float = 1.0, smooth: float = 1.0) -> DataFrame:
    """Leaf cells (``son = 0``) of their own domain, jittered within the cell by a hash, so that reruns agree."""
    part = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "pid"), F.lit(1 << 30)) / float(1 << 30) - 0.5
    dx = F.pow(F.lit(0.5), F.col("level"))
    leaf = cells.filter((F.col("son") == 0) & (F.col("domain") == F.col("file")))
    return leaf.withColumns({c: (F.col(c) + part(k) * dx) * scale for k, c in enumerate("xyz")} | {"r": dx * scale * smooth})
