"""The batch run: a parameter file becomes scenes, scenes become pictures and logs.

Parameters, scenes and cameras are the driver's; each frame is one plan from its source to at most ``xres * yres`` rows. What
scenes share (the same ``fidx``) is read, normalised and written once.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import geometry, images
from lumenfold.functions.geometry import Camera
from lumenfold.operators import camera as cam
from lumenfold.operators import interpolate, lod, palette, ranges, splat
from lumenfold.plans.tables import cut, dropped
from lumenfold.sources import palettes, params, records, snapshots
from lumenfold.sources.params import Params

RGB = ("red", "green", "blue")


@dataclass(frozen=True)
class Scene:
    """A frame: its parameters, the name of its files, and whether it shows what the frame before it shows."""

    params: Params
    name: str
    reuse: bool = False


def _three(p: Params, name: str, default: tuple | None = None) -> tuple[float, float, float]:
    return tuple(p.find(f"{name}_{c}", float, default[k] if default else None) for k, c in enumerate("xyz"))


def camera_of(p: Params) -> Camera:
    """The camera that a frame's parameters describe."""
    xres = p.find("xres", int, 800)
    sides = {"fov": p.find("fov", float, 45.0), "xres": xres, "yres": p.find("yres", int, xres), "perspective": p.find("projection", bool, "true")}
    depth = {"zmin": p.find("zmin", float, 0.0), "zmax": p.find("zmax", float, 1e23), "minrad": p.find("minrad_pix", float, 1.0)}
    centre = _three(p, "center") if "center_x" in p else None
    return Camera(position=_three(p, "camera"), lookat=_three(p, "lookat"), sky=_three(p, "sky", (0.0, 0.0, 1.0)), center=centre, **sides, **depth)


def _with(p: Params, c: Camera) -> Params:
    """Parameters with another camera."""
    out = Params(p)
    for name, v in (("camera", c.position), ("lookat", c.lookat), ("sky", c.sky), ("center", c.center)):
        if v is not None:
            out |= {f"{name}_{k}": repr(float(x)) for k, x in zip("xyz", v, strict=True)}
    out["fov"] = repr(float(c.fov))
    return out


def scenes(p: Params) -> list[Scene]:
    """All frames in order: those of the scene file, or one; two of each for two eyes, six for a panorama."""
    out = p.find("outfile")
    rows = [{}]
    first, step = p.find("scene_start", int, 0), p.find("scene_incr", int, 1)
    if p.find("scene_file", str, ""):
        with open(p["scene_file"]) as f:
            rows = params.scenes(f.read(), first, step, p.find("last_scene", int, 1_000_000) - 1)
    found = []
    for i, row in enumerate(rows):
        same = row.pop("reuse", "false" if not i or "fidx" in row else "true") == "true"
        found.append(Scene(Params({**p, **row}), f"{out}{first + i * step:04d}", same))
    eyes = {s.params.find("EyeSeparation", float, 0.0) for s in found} != {0.0}
    faces = any(s.params.find("panorama", bool, "false") for s in found)
    if eyes and faces:
        raise ValueError("two eyes and a panorama exclude each other")
    if not (eyes or faces):
        return found
    more = []
    for s in found:
        c = camera_of(s.params)
        views = geometry.stereo(c, s.params.find("EyeSeparation", float, 0.0)) if eyes else geometry.panorama(c)
        more += [Scene(_with(s.params, v), name + s.name, s.reuse or k > 0) for k, (name, v) in enumerate(views.items())]
    return more


def bracket_of(p: Params) -> tuple[int, int, float]:
    """The numbers of the two snapshots about a frame, and the part of the way between them."""
    fidx, spacing = p.find("fidx", float, 0.0), int(p.find("snapshot_spacing", float, 1.0))
    one = p.find("snapshot_base1", int, int(fidx / spacing) * spacing)
    two = p.find("snapshot_base2", int, one + spacing)
    return one, two, p.find("frac", float, (fidx - one) / (two - one))


def snapshot_files(p: Params, number: int) -> list[str]:
    """The files of a numbered snapshot, in order."""
    parts = [p.find("datadir", str, ""), p.find("snapdir", str, "") and f"{p['snapdir']}{number:03d}"]
    stem = os.path.join(*[x for x in parts if x], f"{p.find('infile')}{number:03d}")
    n = p.find("numfiles", int, 1)
    return [stem] if n == 1 else [f"{stem}.{i}" for i in range(n)]


def _species(p: Params) -> list[int]:
    return [p.find(f"ptype{t}", int, t) for t in range(p.find("ptypes", int, 1))]


def _gadget(spark: SparkSession, p: Params, number: int) -> DataFrame:
    """All types of a labelled snapshot of one or more files, each type with its own labels and sizes."""
    out = None
    velocities = p.find("interpolation_mode", int, 0) > 1
    for path in snapshot_files(p, number):
        for t, sp in enumerate(_species(p)):
            get = lambda name, kind, default, t=t: p.find(f"{name}{t}", kind, default)
            own = snapshots.gadget2(
                spark, path, [sp], size_label=get("size_label", str, "XXXX"), size_fix=get("size_fix", float, 1.0), size_fac=get("size_fac", float, 1.0),
                colour_label=get("color_label", str, "XXXX"), colour_fac=get("color_fac", float, 1.0), intensity_label=get("intensity_label", str, "XXXX"),
                present={get("size_label", str, "XXXX").ljust(4): get("size_present", int, 1 << sp), get("color_label", str, "XXXX").ljust(4): get("color_present", int, 1 << sp), get("intensity_label", str, "XXXX").ljust(4): get("intensity_present", int, 1 << sp)},
                velocities=velocities,
            )
            own = own.withColumn("type", F.lit(t))
            out = own if out is None else out.unionByName(own)
    return out


def _columns(p: Params) -> dict[str, int]:
    return {s: p.find(k, int, -1) for s, k in (("x", "x"), ("y", "y"), ("z", "z"), ("r", "r"), ("i", "I"), ("c1", "C1"), ("c2", "C2"), ("c3", "C3"))}


def _raw(block: bool) -> Callable[[SparkSession, Params], DataFrame]:
    def read(spark: SparkSession, p: Params) -> DataFrame:
        return snapshots.raw(spark, p.find("infile"), p.find("num_blocks", int, 1), _columns(p), block=block, swap=p.find("swap_endian", bool, "true"), smooth=p.find("smooth_factor", float, 1.0))

    return read


def _tipsy(spark: SparkSession, p: Params) -> DataFrame:
    bound = {t: {s: p.find(f"{k}_{t}", int, -1) for s, k in (("r", "r"), ("i", "I"), ("c1", "C1"), ("c2", "C2"), ("c3", "C3"))} for t in range(3)}
    return snapshots.tipsy(spark, p.find("infile"), bound)


def _millennium(spark: SparkSession, p: Params) -> DataFrame:
    return records.gadget1(spark, p.find("infile"), _species(p))


def _fits(spark: SparkSession, p: Params) -> DataFrame:
    return snapshots.fits(spark, p.find("infile"))


def _catalogue(spark: SparkSession, p: Params) -> DataFrame:
    return snapshots.catalogue(spark, p.find("infile"))


#: The readers by the number that parameter files give them; other numbers are taken by ``readers`` of :func:`run`.
READERS: dict[int, Callable[[SparkSession, Params], DataFrame]] = {0: _raw(False), 1: _raw(True), 4: _millennium, 5: _raw(True), 11: _tipsy, 15: _catalogue, 16: _fits}


def read(spark: SparkSession, p: Params, readers: dict[int, Callable[[SparkSession, Params], DataFrame]] | None = None) -> DataFrame:
    """What a frame shows: one snapshot, or what lies between two."""
    kind, mode = p.find("simtype", int), p.find("interpolation_mode", int, 0)
    one, two, frac = bracket_of(p)
    known = READERS | (readers or {})
    if kind != 2:
        if kind not in known:
            raise ValueError(f"no reader for simtype {kind}")
        if mode:
            raise ValueError(f"simtype {kind} is not interpolated")
        return known[kind](spark, p)
    if not mode:
        return _gadget(spark, p, int(p.find("fidx", float, 0.0)))
    box = snapshots.gadget_header(snapshot_files(p, one)[0])["boxsize"] if p.find("periodic", bool, "true") else None
    side = [_gadget(spark, p, n).withColumnsRenamed({"pid": "id", "c1": "e"}) for n in (one, two)]
    pairs = interpolate.paired(*side)
    if mode == 1:
        return interpolate.linear(pairs, frac, box).withColumnsRenamed({"id": "pid", "e": "c1"})
    times = [snapshots.gadget_header(snapshot_files(p, n)[0])["time"] for n in (one, two)]
    _, unit1, unit2 = geometry.cosmic_step(*times, omega=p.find("omega", float, 0.3), lam=p.find("lambda", float, 0.7), hubble=p.find("hubble", float, 0.7), v_unit=p.find("v_unit", float, 1e5), l_unit=p.find("l_unit", float, 3.085678e21))
    way = interpolate.cubic if mode == 2 else interpolate.orbital
    return way(pairs, frac, unit1, unit2, box).withColumnsRenamed({"id": "pid", "e": "c1"})


def prepared(df: DataFrame, p: Params) -> DataFrame:
    """``pid, type, x, y, z, r, i, c1, c2, c3`` with intensities and colours of each type over their ranges.

    Vector colours share one range; ends that the parameters give replace a range's own.
    """
    out = None
    for c in ("c2", "c3"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(0.0))
    for t in range(p.find("ptypes", int, 1)):
        own, flag = df.filter(F.col("type") == t), lambda name, t=t: p.find(f"{name}{t}", bool, "false")
        vector = flag("color_is_vector")
        colours = ["c1", "c2", "c3"] if vector else ["c1"]
        end = lambda name, t=t: p.find(f"{name}{t}", float) if f"{name}{t}" in p else None
        limits = {"i": (end("intensity_min"), end("intensity_max"))}
        logs = ["i"] * flag("intensity_log") + (colours if flag("color_log") else [])
        bent = colours if flag("color_asinh") else []
        if vector and (end("color_min") is None or end("color_max") is None):
            held = ranges.transformed(own, log=[c for c in logs if c != "i"], arsinh=bent)
            r = held.agg(F.min(F.least(*colours)), F.max(F.greatest(*colours))).first()
            limits |= {c: (end("color_min") if end("color_min") is not None else r[0], end("color_max") if end("color_max") is not None else r[1]) for c in colours}
        else:
            limits |= {c: (end("color_min"), end("color_max")) for c in colours}
        own = ranges.normalised(own, ["i", *colours], log=logs, arsinh=bent, limits=limits)
        out = own if out is None else out.unionByName(own)
    return out.select("pid", "type", "x", "y", "z", "r", "i", "c1", "c2", "c3")


def palettes_of(p: Params) -> dict[int, palette.Palette]:
    """Each scalar type's palette."""
    types = [t for t in range(p.find("ptypes", int, 1)) if not p.find(f"color_is_vector{t}", bool, "false")]
    return {t: palettes.load(p.find(f"palette{t}")) for t in types}


def picture(df: DataFrame, p: Params, colours: dict[int, palette.Palette] | None = None) -> DataFrame:
    """``x, y, red, green, blue`` of one frame of prepared particles, tone mapped and adjusted."""
    c, colours = camera_of(p), palettes_of(p) if colours is None else colours
    types = range(p.find("ptypes", int, 1))
    share = p.find("boost_share", float, 1.0)
    if p.find("boost", bool, "false") and share < 1.0:
        df = lod.boosted(lod.stratified(lod.grid(df), share, [F.xxhash64("pid"), F.col("pid")]))
    near = cam.seen(df.withColumn("e", F.col("c1")), c, {t: p.find(f"smooth_factor{t}", float, 1.0) for t in types})
    bright = {t: p.find(f"brightness{t}", float, 1.0) for t in types}
    lit = palette.colourised(near, colours, bright)
    for t in types:
        if t not in colours:  # a vector is its own colour
            own = {n: F.when(F.col("type") == t, F.col(k) * F.col("i") * bright[t]).otherwise(F.col(n)) for n, k in zip(RGB, ("c1", "c2", "c3"), strict=True)}
            lit = lit.withColumns(own)
    image = splat.tone_mapped(splat.additive(lit, split_wide=True)) if p.find("a_eq_e", bool, "true") else splat.absorbing(lit, p.find("gray_absorption", float, 0.2))
    image = splat.adjusted(image, p.find("pic_gamma", float, 1.0), p.find("pic_contrast", float, 1.0), p.find("pic_brightness", float, 0.0))
    if p.find("colorbar", bool, "false") and colours:
        image = palette.with_bar(image, palette.colour_bar(df.sparkSession, colours, c.xres))
    return image


def octaves(df: DataFrame, p: Params, colours: dict[int, palette.Palette], smallest: float = 1.0, most: int = 6) -> DataFrame:
    """Optical depths of a frame whose large discs are drawn on coarser images: a disc of ``2 ** k`` times ``smallest`` pixels on
    one of ``2 ** k`` times fewer, which is then enlarged. Costs a disc's pixels only while it is small; edges get softer."""
    c = camera_of(p)
    lit = palette.colourised(cam.seen(df.withColumn("e", F.col("c1")), c), colours).withColumn("level", F.least(lod.octave(F.col("r"), smallest), F.lit(most)))
    total = None
    for k in reversed(range(most + 1)):
        half = 1 << k
        small = lit.filter(F.col("level") == k).withColumns({n: F.col(n) / half for n in ("x", "y", "r")})
        own = splat.additive(cam.spans(small, geometry.replace(c, xres=-(-c.xres // half), yres=-(-c.height // half))))
        if total is not None:
            own = own.unionByName(splat.upsampled(total))
            own = own.groupBy("x", "y").agg(*[F.sum(n).alias(n) for n in RGB])
        total = own
    return total.filter((F.col("x") < c.xres) & (F.col("y") < c.height))


def run(spark: SparkSession, p: Params, folder: str = ".", readers: dict[int, Callable[[SparkSession, Params], DataFrame]] | None = None) -> list[str]:
    """Draw all scenes into ``folder``; the names of the pictures written. Ends before the next frame if there is a file ``stop``.

    With ``AnalyzeSimulationOnly`` nothing is drawn: a log tells a camera and a size to begin with.
    """
    stop = os.path.join(folder, "stop")
    if os.path.exists(stop):  # left over from an earlier run
        os.remove(stop)
    if "geometry_file" in p:
        raise ValueError("geometry_file is gone; scenes are in scene_file")
    done, shown = [], None
    if p.find("AnalyzeSimulationOnly", bool, "false"):
        with open(os.path.join(folder, f"{p.find('outfile')}0000.log"), "w") as f:
            f.write("".join(f"{k}={v}\n" for k, v in snapshots.suggested(read(spark, p, readers)).items()))
        return done
    for s in scenes(p):
        if shown is None or not s.reuse:
            if shown is not None:
                dropped(shown)
            shown = cut(prepared(read(spark, s.params, readers), s.params), "particles")
        c, near = camera_of(s.params), shown
        box = s.params.find("boxsize", float, 0.0)
        if s.params.find("periodic", bool, "true") and box:
            near = cam.wrapped(near, c.lookat, box)
        kind = s.params.find("pictype", int, 0)
        images.write(splat.quantised(picture(near, s.params)), os.path.join(folder, s.name), c.xres, c.height, kind)
        done.append(s.name)
        if s.params.find("print_logfile", bool, "true"):
            with open(os.path.join(folder, f"{s.name}.log"), "w") as f:
                f.write(s.params.log())
        if os.path.exists(stop):
            break
    return done

