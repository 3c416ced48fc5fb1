"""Image files, on the driver: as many pixels as the image has."""

from __future__ import annotations

import struct
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame


def dense(image: DataFrame, width: int, height: int) -> np.ndarray:
    """Quantised ``x, y, red, green, blue`` as rows of pixels."""
    out = np.zeros((height, width, 3), np.uint8)
    rows = image.select("x", "y", "red", "green", "blue").filter(f"x BETWEEN 0 AND {width - 1} AND y BETWEEN 0 AND {height - 1}").toPandas()
    out[rows["y"], rows["x"]] = rows[["red", "green", "blue"]].to_numpy()
    return out


def _header(kind: int, width: int, height: int) -> bytes:
    return struct.pack("<BBBHHBHHHHBB", 0, 0, kind, 0, 0, 0, 0, 0, width, height, 24, 0)


def tga(pixels: np.ndarray) -> bytes:
    """True colour, blue first, the row y = 0 first."""
    return _header(2, pixels.shape[1], pixels.shape[0]) + pixels[:, :, ::-1].tobytes()


def tga_rle(pixels: np.ndarray) -> bytes:
    """Packets of up to 128 equal, or of up to 128 unequal pixels; none goes over a row's end."""
    out = [_header(10, pixels.shape[1], pixels.shape[0])]
    for row in pixels[:, :, ::-1]:
        edges = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]).any(axis=1), [True]]))
        raw: list[bytes] = []

        def flush(raw=raw):
            for i in range(0, len(raw), 128):
                part = raw[i : i + 128]
                out.append(bytes([len(part) - 1]) + b"".join(part))
            raw.clear()

        for a, b in zip(edges, edges[1:], strict=False):
            if b - a == 1:
                raw.append(row[a].tobytes())
                continue
            flush()
            for i in range(a, b, 128):
                out.append(bytes([127 + min(128, b - i)]) + row[a].tobytes())
        flush()
    return b"".join(out)


def ppm(pixels: np.ndarray) -> bytes:
    """Binary, the top row first."""
    return f"P6\n{pixels.shape[1]} {pixels.shape[0]}\n255\n".encode() + pixels[::-1].tobytes()


def read_tga(blob: bytes) -> np.ndarray:
    kind, width, height, bits = blob[2], *struct.unpack_from("<HH", blob, 12), blob[16]
    if bits != 24 or kind not in (2, 10):
        raise ValueError("only 24-bit true colour")
    body = blob[18 + blob[0] :]
    if kind == 2:
        flat = body[: 3 * width * height]
    else:
        parts, at, n = [], 0, 0
        while n < width * height:
            k = (body[at] & 127) + 1
            if body[at] & 128:
                parts.append(body[at + 1 : at + 4] * k)
                at += 4
            else:
                parts.append(body[at + 1 : at + 1 + 3 * k])
                at += 1 + 3 * k
            n += k
        flat = b"".join(parts)
    return np.frombuffer(flat, np.uint8).reshape(height, width, 3)[:, :, ::-1]


def write(image: DataFrame, path: str, width: int, height: int, pictype: int = 0) -> None:
    """Picture types: 0 TGA, 2 PPM, 3 TGA with run lengths."""
    kinds = {0: (".tga", tga), 2: (".ppm", ppm), 3: (".tga", tga_rle)}
    if pictype not in kinds:
        raise ValueError(f"unknown picture type {pictype}")
    end, encode = kinds[pictype]
    Path(path if path.endswith(end) else path + end).write_bytes(encode(dense(image, width, height)))
