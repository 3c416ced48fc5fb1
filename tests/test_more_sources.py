"""Fixed-order records, particle files, hierarchies, HDF5 through a stand-in, selection, the command controller."""

import base64
import json
import struct
from importlib.util import find_spec

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions.geometry import Camera
from lumenfold.operators import selection, session
from lumenfold.plans import views
from lumenfold.sources import hdf5, palettes, records, snapshots
from lumenfold.streaming import server


def record(data: bytes, order: str = "<") -> bytes:
    return struct.pack(order + "i", len(data)) + data + struct.pack(order + "i", len(data))


@pytest.mark.parametrize("order", ["<", ">"])
def test_fixed_order(spark, tmp_path, order):
    npart = [3, 4, 0, 0, 0, 0]
    n = sum(npart)
    f4 = lambda a: np.asarray(a).astype(order + "f4").tobytes()
    pos, vel = np.arange(3 * n), np.arange(3 * n) + 100
    ids = np.arange(n).astype(order + "u4").tobytes()
    path, new = str(tmp_path / "old"), str(tmp_path / "new")
    parts = [struct.pack(order + "6i", *npart).ljust(256, b"\0"), f4(pos), f4(vel), ids, f4(np.arange(n) + 1), f4(np.arange(n) + 10), f4(np.arange(n) + 20)]
    with open(path, "wb") as f:
        f.write(b"".join(record(p, order) for p in parts))
    got = records.gadget1(spark, path, [1], size_fix=0.0, size_fac=2.0, colour=0, colour_fac=0.5, intensity=1).orderBy("pid").toPandas()
    assert list(got["pid"]) == [3, 4, 5, 6] and list(got["x"]) == [9, 12, 15, 18] and list(got["r"]) == [8, 10, 12, 14]
    assert list(got["c3"]) == [(111 + 3 * k) / 2 for k in range(4)] and list(got["i"]) == [13, 14, 15, 16]
    assert [r.c1 for r in records.gadget1(spark, path, [0], colour=2).orderBy("pid").collect()] == [20, 21, 22]
    with pytest.raises(ValueError):
        records.gadget1(spark, path, [0], colour=3)
    # the same rows after conversion to labelled records, and one more block
    records.labelled(path, new, piece=5)
    records.append_block(new, "AGE ", np.arange(n))
    blocks, found = snapshots.gadget_blocks(new)
    assert found == order and list(blocks) == [*records.ORDER, "AGE "]
    same = snapshots.gadget2(spark, new, [1], size_fix=0.0, colour_label="RHO ", intensity_label="AGE ").orderBy("x").toPandas()
    assert list(same["x"]) == [9, 12, 15, 18] and list(same["c1"]) == [13, 14, 15, 16] and list(same["i"]) == [3, 4, 5, 6]


def test_broken_record(tmp_path):
    (tmp_path / "b").write_bytes(struct.pack("<i", 4) + b"abcd" + struct.pack("<i", 5))
    with pytest.raises(ValueError):
        records.places(str(tmp_path / "b"))


def test_particle_files(spark, tmp_path):
    paths = []
    for k, kind in enumerate(("<f8", "<f4")):
        head = [struct.pack("<i", v) for v in (2, 3, 5)] + [struct.pack("<4i", 0, 0, 0, 0)] + [struct.pack("<i", 0)] * 4
        arrays = [(np.arange(5) + 10 * c).astype(kind).tobytes() for c in range(7)]
        paths.append(str(tmp_path / f"part{k}"))
        (tmp_path / f"part{k}").write_bytes(b"".join(map(record, head + arrays)))
    got = records.particle_files(spark, paths, 4.0, scale=2.0, intensity="mass").orderBy("pid").toPandas()
    assert list(got["pid"]) == list(range(10)) and list(got["x"][5:]) == [-4, -2, 0, 2, 4] and list(got["c1"][:2]) == [30, 31] and got["i"][0] == 60
    assert [r.pid for r in records.particle_files(spark, paths, 4.0, step=2).orderBy("pid").collect()] == [0, 2, 4, 5, 7, 9]


def test_hierarchy(spark):
    text = """
Grid = 1
GridStartIndex       = 3 3 3
GridEndIndex         = 6 10 18
GridLeftEdge         = 0 0 0
GridRightEdge        = 1 2 4
BaryonFileName = /far/away/DD0001.grid0001
Pointer: Grid[1]->NextGridThisLevel = 2
Grid = 2
GridStartIndex       = 3 3 3
GridEndIndex         = 6 6 6
GridLeftEdge         = 0 0 0
GridRightEdge        = 0.5 0.5 0.5
"""
    a, b = records.tiles(spark, text).orderBy("tile").collect()
    assert (a.nx, a.ny, a.nz, a.right_x, a.right_z, a.file) == (16, 8, 4, 4.0, 1.0, "DD0001.grid0001") and b.file is None
    cells = snapshots.amr_tiles(records.tiles(spark, text), (0.0, 0.0, 0.0), (0.5, 0.5, 0.5), 4, 0.25)
    assert {r["tile"]: r["count"] for r in cells.groupBy("tile").count().collect()} == {1: 8, 2: 64}


def test_named_columns(spark):
    t = spark.createDataFrame([(5, 1.0)], "k long, v double")
    assert tuple(records.bound(t, {"pid": "k", "i": "v"}).first()) == (5, 0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        records.bound(t, {"x": "no"})


#: What is used of the package: groups by path, shapes, slices.
STAND_IN = '''
import os
import numpy as np

class File:
    def __init__(self, path, mode="r"):
        self.path = path
    def keys(self):
        return [n[:-4] for n in sorted(os.listdir(self.path)) if n.endswith(".npy")]
    def __contains__(self, name):
        return os.path.isdir(os.path.join(self.path, name))
    def __getitem__(self, name):
        return np.load(os.path.join(self.path, name + ".npy"))
    def __enter__(self):
        return self
    def __exit__(self, *a):
        return False
'''


@pytest.mark.skipif(find_spec("h5py") is not None, reason="the package itself is there")
def test_hdf5_without_its_package(tmp_path):
    with pytest.raises(ImportError, match="h5py"):
        hdf5.fields(str(tmp_path / "x"))


@pytest.mark.skipif(find_spec("h5py") is not None, reason="the package itself is there")
def test_hdf5(spark, tmp_path, monkeypatch):
    """Datasets as folders of arrays, read through a module that stands in for the package."""
    import sys

    (tmp_path / "h5py.py").write_text(STAND_IN)
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    monkeypatch.syspath_prepend(str(tmp_path))
    store = tmp_path / "store"
    (store / "PartType4").mkdir(parents=True)
    cube = np.arange(24.0).reshape(2, 3, 4)
    np.save(store / "rho.npy", cube)
    np.save(store / "flat.npy", np.arange(24.0) * 2)
    monkeypatch.setattr(snapshots, "RANGE", 7)
    assert hdf5.fields(str(store)) == {"flat": (24,), "rho": (2, 3, 4)}
    got = hdf5.flat(spark, str(store), {"c1": "rho", "i": "flat"}, threshold=1.0).orderBy("pid").toPandas()
    assert list(got["c1"]) == list(cube.ravel() + 1) and list(got["i"]) == list(np.arange(24.0) * 2)
    where = got[["x", "y", "z"]].to_numpy().astype(int)
    assert (cube[where[:, 0], where[:, 1], where[:, 2]] + 1 == got["c1"]).all()
    whole = np.zeros(9, [(n, "f4") for n in ("x", "y", "z", "C1", "C2", "C3", "r", "I")] + [("snapshot", "i4")])
    whole["x"], whole["snapshot"] = np.arange(9), np.arange(9) % 3
    np.save(store / "all.npy", whole)
    df = hdf5.compound(spark, str(store), "all")
    assert [r.x for r in df.filter("snapshot = 1").orderBy("x").collect()] == [1, 4, 7] and df.select("snapshot").distinct().count() == 3
    np.save(store / "PartType4" / "Coordinates.npy", np.arange(30.0).reshape(10, 3))
    np.save(store / "PartType4" / "ParticleIDs.npy", np.arange(10))
    np.save(store / "PartType4" / "Metals.npy", np.arange(10.0))
    stars = hdf5.gadget(spark, str(store), [0, 4], colour_label="Metals", colour_fac=3.0).orderBy("pid").toPandas()
    assert list(stars["pid"]) == [hdf5.STAR_ID + k for k in range(10)] and set(stars["type"]) == {1} and list(stars["c1"]) == [3.0 * k for k in range(10)]
    sys.modules.pop("h5py", None)


@pytest.mark.parametrize("values", [list(range(1000)), [7] * 500 + [8] * 500, [1, None, 3], []])
def test_nth(spark, monkeypatch, values):
    monkeypatch.setattr(selection, "LAST", 20)
    df = spark.createDataFrame([(v,) for v in values], "v long")
    known = sorted(v for v in values if v is not None)
    for n in {0, len(known) // 3, len(known) // 2, len(known) - 1, len(known)}:
        assert selection.nth_smallest(df, "v", n) == (known[n] if 0 <= n < len(known) else None)


def test_orders(spark, data):
    p = views.particles(spark, data)
    assert selection.ordered(p, 0) is p
    r = [x.r for x in selection.ordered(p, 4).select("r").limit(50).collect()]
    assert r == sorted(r, reverse=True)
    assert selection.ordered(p, 1).select("z").first()[0] == p.agg(F.min("z")).first()[0]


@pytest.mark.parametrize(("total", "parts"), [(10, 3), (9, 3), (2, 5), (0, 4)])
def test_shares(spark, total, parts):
    starts = [r[0] for r in spark.range(parts + 1).select(selection.share_start(F.col("id"), total, parts)).collect()]
    assert starts[0] == 0 and starts[-1] == total and all(0 <= b - a - total // parts <= 1 for a, b in zip(starts, starts[1:], strict=False))
    got = [r[0] for r in spark.range(total).select(selection.share_of(F.col("id"), total, parts)).collect()]
    assert got == [max(k for k in range(parts) if starts[k] <= i) for i in range(total)]


def test_controller(spark, data, tmp_path):
    colours = [(0.0, 0.0, 1.0), (1.0, 0.0, 0.0)]
    look = Camera(position=(25.0, 25.0, 80.0), lookat=(25.0, 25.0, 0.0), sky=(0.0, 1.0, 0.0), xres=16, perspective=False)
    c = server.Controller(session.Session(views.particles(spark, data), params={"quality": 1}), look, dict.fromkeys((0, 1, 2), colours))

    def ask(method, **params):
        reply = json.loads(c.answer(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))
        return reply.get("result", reply.get("error", {}).get("code"))

    assert ask("cmd_set", quality=2, fov=30.0) == {"quality": 2, "fov": 30.0} and ask("cmd_get", name="fov") == 30.0
    assert ask("cmd_set", nothing=1, fov=99.0) == -32000 and ask("cmd_state")["fov"] == 30.0 and ask("cmd_none") == -32601
    assert ask("cmd_user", name="a") == 0 and ask("cmd_user", name="b") == 1 and ask("cmd_user", name="a") == 0
    clip = ask("cmd_create_filter", kind="clip", field="x", low=1, high=20)
    ask("cmd_create_filter", kind="combine", field="i", op="add", other="y")
    assert ask("cmd_update_filter", name=clip, high=10) == clip and ask("cmd_interface_desc")["fields"]["x"][1] <= 10
    assert ask("cmd_create_filter", kind="combine", field="i", op="pow", other="y") == -32000 and ask("cmd_update_filter", name="no") == -32000
    ask("cmd_save_filtered_data", path=str(tmp_path / "kept"))
    assert ask("cmd_load", path=str(tmp_path / "kept")) and ask("cmd_remove_filter", name=clip) == clip and ask("cmd_interface_desc")["fields"]["x"][1] <= 10
    assert ask("cmd_create_filter", kind="norm", field="e") == "norm" and ask("cmd_reload_field", slot="r", column="x") == "r" and ask("cmd_reload_field", slot="r", column="no") == -32000
    assert ask("cmd_replace_colourmap", type=1, text=palettes.text("t", colours)) == 2 and ask("cmd_replace_colourmap", type=1, text="x") == -32000
    assert ask("cmd_update_image_params", xres=8) == {"xres": 8, "yres": 8} and ask("cmd_update_image_params", xres=-1) == -32000
    image = ask("cmd_get_image")
    assert base64.b64decode(image["data"]).startswith(b"P6\n8 8\n255\n") and any(base64.b64decode(image["data"])[11:])
    ask("cmd_save_image", path=str(tmp_path / "shot"))
    assert (tmp_path / "shot.tga").exists()
