"""Parameter and scene files."""

from __future__ import annotations

import warnings
from pathlib import Path

#: Words for truth, and the columns of a scene file without a header.
TRUE, FALSE = {"t", "y", "true", ".true."}, {"f", "n", "false", ".false."}
PLAIN_SCENE = "camera_x camera_y camera_z lookat_x lookat_y lookat_z sky_x sky_y sky_z fidx".split()


class Params(dict):
    """``key = value`` pairs; a default that was asked for stays, and unread keys can be told."""

    def __init__(self, *args, **kw) -> None:
        super().__init__(*args, **kw)
        self.read: set[str] = set()

    def find(self, key: str, kind: type = str, default=None):
        self.read.add(key)
        if key not in self:
            if default is None:
                raise KeyError(key)
            self[key] = str(default)
        value = self[key]
        if kind is bool:
            low = value.lower()
            if low not in TRUE | FALSE:
                raise ValueError(f"{key}: {value!r} is neither true nor false")
            return low in TRUE
        return kind(value)

    def unread(self) -> set[str]:
        return set(self) - self.read

    def log(self) -> str:
        return "".join(f"{k}={v}\n" for k, v in sorted(self.items()))


def parse(text: str) -> Params:
    out = Params()
    for line in text.replace("\r", "").split("\n"):
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        key, eq, value = (x.strip() for x in line.partition("="))
        if not eq or not key:
            warnings.warn(f"not a parameter: {line!r}", stacklevel=2)
            continue
        if key in out:
            warnings.warn(f"{key} is given twice; the last holds", stacklevel=2)
        out[key] = value
    return out


def load(path: str) -> Params:
    return parse(Path(path).read_text())


def arguments(args: list[str]) -> Params:
    """``key=value`` or ``-key value``."""
    out, rest = Params(), iter(args)
    for a in rest:
        if a.startswith("-"):
            out[a[1:]] = next(rest)
        else:
            key, eq, value = a.partition("=")
            if not eq:
                raise ValueError(f"not an argument: {a!r}")
            out[key] = value
    return out


def scenes(text: str, start: int = 0, step: int = 1, last: int = 1_000_000) -> list[dict[str, str]]:
    """One dict a frame, with ``reuse`` where a frame needs the same data as the one before."""
    lines = [x.split() for x in text.replace("\r", "").split("\n") if x.strip() and not x.lstrip().startswith("#")]
    if not lines:
        return []

    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    plain = len(lines[0]) == len(PLAIN_SCENE) and all(map(number, lines[0]))
    head, rows = (PLAIN_SCENE, lines) if plain else (lines[0], lines[1:])
    out: list[dict[str, str]] = []
    for i in range(start, min(last + 1, len(rows)), step):
        if len(rows[i]) != len(head):
            raise ValueError(f"scene {i} has {len(rows[i])} values, not {len(head)}")
        frame = dict(zip(head, rows[i], strict=True))
        if out and "fidx" in frame:
            a, b = float(frame["fidx"]), float(out[-1]["fidx"])
            frame["reuse"] = "true" if abs(a - b) <= 1e-5 * abs(b) else "false"
        out.append(frame)
    return out
