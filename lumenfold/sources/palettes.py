"""Palette files: a name, ``0100``, a number of colours, and as many lines of red, green and blue of 0..255."""

from __future__ import annotations

import re
from pathlib import Path

COLOUR = re.compile(r"\s*(\d{1,3})\s+(\d{1,3})\s+(\d{1,3})\s*")


def parse(text: str) -> list[tuple[float, float, float]]:
    lines = [x for x in text.replace("\r", "").split("\n") if x.strip()]
    if len(lines) < 3 or lines[1].strip() != "0100" or not lines[2].strip().isdigit():
        raise ValueError("not a palette")
    n, rows = int(lines[2]), [COLOUR.fullmatch(x) for x in lines[3:]]
    if len(rows) != n or not n or not all(rows) or any(int(c) > 255 for m in rows for c in m.groups()):
        raise ValueError("a palette's colours are not as it says")
    return [tuple(int(c) / 255 for c in m.groups()) for m in rows]


def load(path: str) -> list[tuple[float, float, float]]:
    return parse(Path(path).read_text())


def text(name: str, colours: list[tuple[float, float, float]]) -> str:
    rows = "".join(f"{' '.join(str(round(255 * c)) for c in colour)}\n" for colour in colours)
    return f"{name}\n0100\n{len(colours)}\n{rows}"
