"""The batch run: scenes, snapshots of several files, frames between snapshots, pictures and logs."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import geometry, images, scalar
from lumenfold.operators import camera as cam
from lumenfold.operators import lod, palette, splat
from lumenfold.plans import frames
from lumenfold.sources import palettes
from lumenfold.sources.params import Params


def block(label, data):
    return struct.pack("<i4sii", 8, label.encode(), len(data) + 8, 8) + struct.pack("<i", len(data)) + data + struct.pack("<i", len(data))


def snapshot(path, ids, pos, vel, time, files=1):
    npart = [len(ids), 0, 0, 0, 0, 0]
    head = struct.pack("<6i6dddii6iiiddddii", *npart, *[0.0] * 6, time, 1.0, 0, 0, *npart, 0, files, 100.0, 0.3, 0.7, 0.7, 0, 0).ljust(256, b"\0")
    u = np.linspace(1, 2, len(ids)).astype("<f4")
    path.write_bytes(block("HEAD", head) + block("POS ", pos.astype("<f4").tobytes()) + block("VEL ", vel.astype("<f4").tobytes()) + block("ID  ", ids.astype("<u4").tobytes()) + block("U   ", u.tobytes()))


BASE = {
    "simtype": "2", "ptypes": "1", "ptype0": "0", "infile": "snap_", "size_fix0": "4", "color_label0": "U", "intensity_label0": "XXXX", "outfile": "pic", "xres": "24", "yres": "16", "periodic": "F",
    "camera_x": "50", "camera_y": "-20", "camera_z": "50", "lookat_x": "50", "lookat_y": "50", "lookat_z": "50", "fov": "60",
}


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    ids, pos = np.arange(40), rng.uniform(20, 80, (40, 3))
    for n, keep in ((0, slice(0, 38)), (2, slice(3, 40))):
        snapshot(tmp_path / f"snap_{n:03d}", ids[keep], (pos + n)[keep], np.ones((40, 3))[keep], 0.5 + n / 10)
    for i in range(2):
        snapshot(tmp_path / f"many_000.{i}", ids[i::2], pos[i::2], np.ones((20, 3)), 0.5, 2)
    (tmp_path / "p.pal").write_text(palettes.text("p", [(0.0, 0.0, 1.0), (1.0, 0.0, 0.0)]))
    return tmp_path


def given(folder, **more):
    return Params(BASE | {"datadir": str(folder), "palette0": str(folder / "p.pal")} | more)


def test_scenes(folder):
    (folder / "scenes").write_text("camera_x fidx\n1 0\n2 0\n3 1\n4 1\n5 2\n")
    p = given(folder, scene_file=str(folder / "scenes"))
    found = frames.scenes(p)
    assert [(s.name, s.reuse, s.params["camera_x"]) for s in found] == [("pic0000", False, "1"), ("pic0001", True, "2"), ("pic0002", False, "3"), ("pic0003", True, "4"), ("pic0004", False, "5")]
    some = frames.scenes(Params({**p, "scene_start": "1", "scene_incr": "2", "last_scene": "4"}))
    assert [s.name for s in some] == ["pic0001", "pic0003"]
    eyes = frames.scenes(given(folder, EyeSeparation="3"))
    assert [(s.name, s.reuse) for s in eyes] == [("right_pic0000", False), ("left_pic0000", True)]
    assert frames.camera_of(eyes[0].params).center == (50.0, -20.0, 50.0)
    faces = frames.scenes(given(folder, panorama="T"))
    assert [s.name for s in faces] == [f"{i}_pic0000" for i in range(1, 7)] and all(frames.camera_of(s.params).fov == 90 for s in faces)
    with pytest.raises(ValueError):
        frames.scenes(given(folder, EyeSeparation="3", panorama="T"))


def test_run_writes_pictures_and_logs(spark, folder):
    (folder / "scenes").write_text("camera_y fidx\n-20 0\n-30 0\n-20 2\n")
    p = given(folder, scene_file=str(folder / "scenes"), pictype="2", colorbar="T")
    assert frames.run(spark, p, str(folder)) == ["pic0000", "pic0001", "pic0002"]
    shots = [(folder / f"pic000{k}.ppm").read_bytes() for k in range(3)]
    assert len(set(shots)) == 3 and "camera_y=-30" in (folder / "pic0001.log").read_text()
    # the first picture is what the operators give, step by step
    shown = frames.prepared(frames.read(spark, p), p)
    c, colours = frames.camera_of(frames.scenes(p)[0].params), {0: palettes.load(p["palette0"])}
    image = splat.tone_mapped(splat.additive(palette.colourised(cam.seen(shown.withColumn("e", F.col("c1")), c), colours)))
    image = palette.with_bar(image, palette.colour_bar(spark, colours, 24))
    assert images.ppm(images.dense(splat.quantised(image), 24, 16)) == shots[0]
    (folder / "stop").write_text("")
    assert len(frames.run(spark, p, str(folder))) == 3 and not (folder / "stop").exists()
    alone = frames.run(spark, given(folder, AnalyzeSimulationOnly="T"), str(folder))
    assert alone == [] and "size_fix" in (folder / "pic0000.log").read_text()


def test_snapshots_of_several_files(spark, folder):
    p = given(folder, infile="many_", numfiles="2")
    assert frames.snapshot_files(p, 0) == [str(folder / f"many_000.{i}") for i in range(2)]
    rows = frames.read(spark, p).toPandas()
    assert sorted(rows["pid"]) == list(range(40)) and set(rows["type"]) == {0}


@pytest.mark.parametrize("mode", [1, 2, 3])
def test_frames_between_snapshots(spark, folder, mode):
    p = given(folder, interpolation_mode=str(mode), fidx="1", snapshot_spacing="2")
    rows = frames.read(spark, p).toPandas().set_index("pid")
    one = frames.read(spark, given(folder, fidx="0")).toPandas().set_index("pid")
    assert sorted(rows.index) == list(range(40)) and frames.bracket_of(p) == (0, 2, 0.5)
    if mode == 1:  # half of the way is one further along each axis
        both = rows.index[3:38]
        assert np.allclose(rows.loc[both, "x"], one.loc[both, "x"] + 1, atol=1e-4)
    assert (rows.loc[[38, 39], "i"] == 0.5).all() and (rows.loc[[0, 1, 2], "i"] == 0.5).all()


def test_vector_colours_and_absorption(spark, folder):
    reader = {77: lambda s, p: s.createDataFrame([(i, 0, 45.0 + i, 50.0, 50.0, 4.0, 1.0 + i, 0.1 * i, 0.5, 0.9) for i in range(9)], "pid long, type int, x double, y double, z double, r double, i double, c1 double, c2 double, c3 double")}
    p = given(folder, simtype="77", color_is_vector0="T", a_eq_e="F", gray_absorption="0.3", pic_gamma="0.8")
    shown = frames.prepared(frames.read(spark, p, reader), p)
    r = {x.pid: x for x in shown.collect()}
    assert math.isclose(r[8].c1, 0.8 / 0.9) and math.isclose(r[0].c3, 1.0) and math.isclose(r[4].c2, 0.5 / 0.9)
    image = frames.picture(shown, p).collect()
    assert image and all(0 <= x.red <= 1 and 0 <= x.blue <= 1 for x in image) and max(x.blue for x in image) > max(x.green for x in image)


def test_boost_keeps_brightness(spark):
    df = spark.range(5000).select(F.col("id").alias("pid"), (F.col("id") % 17).cast("double").alias("x"), (F.col("id") % 13).cast("double").alias("y"), (F.col("id") % 11).cast("double").alias("z"), F.lit(1.0).alias("i"))
    some = lod.boosted(lod.stratified(lod.grid(df), 0.4, [F.xxhash64("pid")]))
    cells = lod.grid(df).groupBy("cell").count().filter("floor(0.4 * count) > 0")
    assert math.isclose(some.agg(F.sum("i")).first()[0], cells.agg(F.sum("count")).first()[0]) and some.count() < 2500


def test_octaves_are_near_the_whole_image(spark, folder):
    reader = {77: lambda s, p: s.createDataFrame([(i, 0, 40.0 + 2 * i, 50.0, 40.0 + i, 1.0 + i, 1.0 + i, 0.1 * i, 0.0, 0.0) for i in range(9)], "pid long, type int, x double, y double, z double, r double, i double, c1 double, c2 double, c3 double")}
    p = given(folder, simtype="77", xres="96", yres="64")
    shown, colours = frames.prepared(frames.read(spark, p, reader), p), {0: palettes.load(p["palette0"])}
    total = lambda image: np.array([[r.red, r.blue] for r in image.collect()]).sum(axis=0)
    whole = splat.additive(palette.colourised(cam.seen(shown.withColumn("e", F.col("c1")), frames.camera_of(p)), colours))
    assert np.allclose(total(frames.octaves(shown, p, colours)), total(whole), rtol=0.1)


def test_matrices():
    m = geometry.perspective(60.0, 1.5, 1.0, 10.0)
    t = math.tan(math.radians(30))
    assert np.allclose(geometry.applied(m, (1.5 * t, t, -1.0)), (1, 1, -1)) and np.allclose(geometry.applied(m, (0, 0, -10.0)), (0, 0, 1))
    assert np.allclose(geometry.applied(geometry.orthographic(-2, 4, -1, 1, 1, 5), (4, -1, -5)), (1, -1, 1))


def test_equal_and_safe(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (None, None, None)], "a int, b int, c int")
    assert [r[0] for r in df.select(scalar.multiequal(F.col("a"), F.col("b"), F.col("c"))).collect()] == [True, False, True]
    assert [r[0] for r in df.select(scalar.safe_cast(F.col("a").cast("long"), "tinyint")).collect()] == [1, 1, None]
    with pytest.raises(Exception, match="no tinyint"):
        spark.range(300, 301).select(scalar.safe_cast(F.col("id"), "tinyint")).collect()
