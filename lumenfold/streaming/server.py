"""The interactive commands: a session, a camera and palettes, changed by requests and rendered when asked."""

from __future__ import annotations

import base64
from dataclasses import asdict, replace
from pathlib import Path

from pyspark.sql import DataFrame

from lumenfold.functions import images
from lumenfold.functions.geometry import Camera
from lumenfold.operators import camera as cam
from lumenfold.operators import palette, ranges, splat
from lumenfold.operators.session import OPERATIONS, Clip, Combine, Rebind, Session
from lumenfold.sources import palettes as palette_files
from lumenfold.streaming import commands

#: Which parameters of a camera a request may change.
IMAGE = ("fov", "xres", "yres", "perspective", "zmin", "zmax", "minrad")


class Controller:
    """State between requests. The data are never changed: steps are kept, and every render derives its plan from them."""

    def __init__(self, session: Session, camera: Camera, palettes: dict[int, palette.Palette]):
        self.session, self.camera, self.palettes = session, camera, dict(palettes)
        self.normalise: str | None = None
        self.users: list[str] = []
        self._next = 0

    def answer(self, request: str) -> str | None:
        return commands.handle(request, self.methods())

    def methods(self) -> dict:
        return {n: getattr(self, n) for n in dir(self) if n.startswith("cmd_")}

    # ---- parameters
    def cmd_set(self, **params) -> dict:
        """Known keys only: those of the session, and the camera's of ``IMAGE``."""
        own = {k: v for k, v in params.items() if k not in IMAGE}
        changed = self.session.set(**own)
        self.camera = replace(self.camera, **{k: v for k, v in params.items() if k in IMAGE})
        self.session = changed
        return params

    def cmd_get(self, name: str):
        return self.cmd_state()[name]

    def cmd_state(self) -> dict:
        seen = asdict(self.camera)
        return {**self.session.params, **{k: seen[k] for k in IMAGE}}

    def cmd_update_image_params(self, xres: int | None = None, yres: int | None = None) -> dict:
        for v in (xres, yres):
            if v is not None and v <= 0:
                raise ValueError("an image has at least one pixel")
        self.camera = replace(self.camera, xres=xres or self.camera.xres, yres=yres or self.camera.yres)
        return {"xres": self.camera.xres, "yres": self.camera.height}

    def cmd_user(self, name: str) -> int:
        """The number of a user, the same for the same name."""
        if name not in self.users:
            self.users.append(name)
        return self.users.index(name)

    def cmd_interface_desc(self) -> dict:
        """What there is to set and to filter, and each field's range under the steps so far."""
        frame = self.session.frame()
        fields = [c for c, t in frame.dtypes if t in ("double", "float", "int", "bigint")]
        r = ranges.overall(frame, fields).first()
        return {"parameters": self.cmd_state(), "fields": {c: [r[f"{c}_min"], r[f"{c}_max"]] for c in fields}, "filters": {n: asdict(s) for n, s in self.session.steps}, "types": sorted(self.palettes)}

    # ---- data
    def cmd_load(self, path: str) -> list[str]:
        """Another table of particles; steps that name a column it lacks go."""
        base = self.session.base.sparkSession.read.parquet(path)
        keep = tuple((n, s) for n, s in self.session.steps if set(map(str, (getattr(s, a) for a in ("field", "other", "slot", "column") if hasattr(s, a)))) <= set(base.columns))
        self.session = replace(self.session, base=base, steps=keep)
        return base.columns

    def cmd_reload_field(self, slot: str, column: str) -> str:
        if column not in self.session.base.columns:
            raise ValueError(f"no column {column}")
        self.session = self.session.put(f"slot-{slot}", Rebind(slot, column))
        return slot

    def cmd_replace_colourmap(self, type: int, text: str) -> int:
        """A palette file's text; a text that is none leaves the palettes as they are."""
        self.palettes[int(type)] = palette_files.parse(text)
        return len(self.palettes[int(type)])

    # ---- filters
    def _step(self, kind: str, field: str, **more):
        if field not in self.session.base.columns:
            raise ValueError(f"no column {field}")
        if kind == "clip":
            return Clip(field, float(more["low"]), float(more["high"]))
        if kind == "combine" and more["op"] in OPERATIONS:
            return Combine(field, more["op"], more["other"])
        raise ValueError(f"no filter {kind} {more.get('op', '')}".strip())

    def cmd_create_filter(self, kind: str, field: str, **more) -> str:
        """``clip`` with ``low, high``, ``combine`` with ``op, other``, or ``norm``, which always comes last."""
        if kind == "norm":
            self.normalise = field
            return "norm"
        name = f"filter-{self._next}"
        self.session = self.session.put(name, self._step(kind, field, **more))
        self._next += 1
        return name

    def cmd_update_filter(self, name: str, **changes) -> str:
        steps = dict(self.session.steps)
        if name not in steps:
            raise KeyError(name)
        self.session = self.session.put(name, replace(steps[name], **changes))
        return name

    def cmd_remove_filter(self, name: str) -> str:
        if name == "norm" and self.normalise:
            self.normalise = None
        elif name in dict(self.session.steps):
            self.session = self.session.drop(name)
        else:
            raise KeyError(name)
        return name

    def cmd_save_filtered_data(self, path: str) -> str:
        self.session.save(path)
        return path

    # ---- images
    def frame(self) -> DataFrame:
        """Quantised pixels of what the steps keep."""
        df = self.session.normalised(self.normalise) if self.normalise else self.session.frame()
        seen = palette.colourised(cam.seen(ranges.normalised(df, ["i", "e"]), self.camera), self.palettes)
        return splat.quantised(splat.tone_mapped(splat.additive(seen)))

    def cmd_get_image(self) -> dict:
        """A PPM file in base64, with its size."""
        w, h = self.camera.xres, self.camera.height
        return {"width": w, "height": h, "data": base64.b64encode(images.ppm(images.dense(self.frame(), w, h))).decode()}

    def cmd_save_image(self, path: str, pictype: int = 0) -> str:
        images.write(self.frame(), path, self.camera.xres, self.camera.height, pictype)
        return str(Path(path))
