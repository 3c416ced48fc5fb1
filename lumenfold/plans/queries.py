"""Queries of the particle engine over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import geometry, scalar
from lumenfold.functions import vectors as vec
from lumenfold.functions.geometry import Camera
from lumenfold.operators import camera as cam
from lumenfold.operators import filters, interpolate, lod, palette, ranges, rays, selection, session, splat
from lumenfold.plans import frames
from lumenfold.plans.tables import cut
from lumenfold.plans.views import commands, particles, snapshot, table, vectors
from lumenfold.sources import records, snapshots
from lumenfold.streaming import commands as stream

Query = Callable[[SparkSession, str], DataFrame]

COLOURS = [(0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0)]
PALETTES = dict.fromkeys((0, 1, 2), COLOURS)
FLAT = Camera(position=(25.0, 25.0, 80.0), lookat=(25.0, 25.0, 0.0), sky=(0.0, 1.0, 0.0), fov=45.0, xres=64, perspective=False)
DEEP = Camera(position=(70.0, -40.0, 60.0), lookat=(25.0, 25.0, 15.0), fov=40.0, xres=64, yres=48)
CLIPS = [("i", 10000.0, 60000.0), ("z", 2.0, 30.0), ("e", 950.0, 2000.0)]
FINE = 6

_all: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        _all[f.__name__] = (f, sql)
        return f

    return keep


def fixed(df: DataFrame, *keys: str, digits: int = FINE) -> DataFrame:
    """Floats rounded, so that another order of sums shows nowhere."""
    return df.select(*[F.round(F.col(c).cast("double"), digits).alias(c) + 0.0 if t in ("double", "float") and c not in keys else F.col(c) for c, t in df.dtypes]).toDF(*df.columns)


def r6(expr: str, name: str) -> str:
    return f"round({expr}, {FINE}) + 0.0 AS {name}"


# ---- the views in SQL
P = """p AS (SELECT ((l_orderkey * 262144 + l_partkey) * 16384 + l_suppkey) * 8 + l_linenumber AS pid,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS type, l_quantity AS x, l_discount * 500 + 0.0 AS y, l_tax * 500 + 0.0 AS z,
  0.5 + l_quantity / 50 AS r, l_extendedprice AS i, l_extendedprice / l_quantity AS e, l_returnflag AS species FROM lineitem)"""
NORM = """n0 AS (SELECT *, CASE WHEN i > 0 THEN log10(i) ELSE -38 END AS li FROM p),
nr AS (SELECT type, min(CASE WHEN li > -38 THEN li END) AS i0, max(CASE WHEN li > -38 THEN li END) AS i1, min(e) AS e0, max(e) AS e1 FROM n0 GROUP BY type),
nn AS (SELECT pid, n0.type, x, y, z, r, CASE WHEN i1 = i0 THEN 1 ELSE (greatest(i0, least(i1, li)) - i0) / (i1 - i0) END AS i,
  CASE WHEN e1 = e0 THEN 1 ELSE (greatest(e0, least(e1, e)) - e0) / (e1 - e0) END AS e FROM n0 JOIN nr USING (type))"""


def _seen_sql(c: Camera, source: str = "nn") -> str:
    """The way from space to pixel ranges and colours, in SQL."""
    m, half, tan = c.matrix, c.xres / 2, float(np.tan(np.radians(c.fov) / 2))
    down = (c.height - c.xres) / 2
    line = lambda row: " + ".join(f"{n} * {float(v)!r}" for n, v in zip("xyz", row[:3], strict=True)) + f" + {float(row[3])!r}"
    f = f"{-half!r} / ({tan!r} * z)" if c.perspective else repr(half / (tan * float(np.linalg.norm(np.subtract(c.position, c.lookat)))))
    reach = f"{scalar.RFAC} * r"
    cut = lambda v, n: f"trunc(greatest(-2, least({n + 2}, {v})))::INT"
    return f"""v1 AS (SELECT pid, type, r, i, e, {line(m[0])} AS x, {line(m[1])} AS y, {line(m[2])} AS z FROM {source}),
v2 AS (SELECT *, {f} AS f FROM v1 WHERE -z > 0 AND -z < 1e23),
v3 AS (SELECT pid, type, e, z, {half} + x * f AS x, {half + down} + y * f AS y, i * {0.5 * scalar.BFAK!r} / r AS i, r * 2 * f AS r FROM v2),
v4 AS (SELECT *, sqrt(r * r + {c.minrad**2}) / r AS rc FROM v3),
v5 AS (SELECT pid, type, e, z, x, y, i / rc AS i, r * rc AS r FROM v4),
v6 AS (SELECT *, greatest(0, {cut(f"x - {reach} + 1", c.xres)}) AS minx, least({c.xres}, {cut(f"x + {reach} + 1", c.xres)}) AS maxx,
  greatest(0, {cut(f"y - {reach} + 1", c.height)}) AS miny, least({c.height}, {cut(f"y + {reach} + 1", c.height)}) AS maxy FROM v5),
seen AS (SELECT * FROM v6 WHERE minx < maxx AND miny < maxy),
pal AS (SELECT *, greatest(0, least(1, e)) * 2 AS pos FROM seen),
lit AS (SELECT *, greatest(0, pos - 1) * i AS red, (1 - abs(pos - 1)) * i AS green, greatest(0, 1 - pos) * i AS blue FROM pal),
s1 AS (SELECT *, -1 / ({scalar.H2SIGMA**2!r} * r * r) AS stp, {scalar.RFAC} * r AS reach, unnest(range(minx, maxx)) AS px FROM lit),
s2 AS (SELECT *, sqrt(reach * reach - (px - x) * (px - x)) AS dy FROM s1 WHERE reach * reach - (px - x) * (px - x) > 0),
s3 AS (SELECT *, unnest(range(greatest(miny, trunc(y - dy + 1)::INT), least(maxy, trunc(y + dy + 1)::INT))) AS py FROM s2),
hit AS (SELECT px, py, pid, z, red, green, blue, exp(stp * (px - x) * (px - x)) * exp(stp * (py - y) * (py - y)) AS att FROM s3)"""


SEEN = f"WITH {P}, {NORM}, {_seen_sql(FLAT)}"
SEEN_DEEP = f"WITH {P}, {NORM}, {_seen_sql(DEEP)}"
IMAGE = SEEN + ", img AS (SELECT px::INT AS x, py::INT AS y, sum(att * red) AS red, sum(att * green) AS green, sum(att * blue) AS blue FROM hit GROUP BY 1, 2)"
TONED = IMAGE + ", tone AS (SELECT x, y, 1 - exp(-red) AS red, 1 - exp(-green) AS green, 1 - exp(-blue) AS blue FROM img)"
RGB = ("red", "green", "blue")


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.normalised(particles(spark, sf_dir, dealt=True), ["i", "e"], log=["i"], of=particles(spark, sf_dir))


def coloured(spark: SparkSession, sf_dir: str, c: Camera = FLAT) -> DataFrame:
    return palette.colourised(cam.seen(normal(spark, sf_dir), c), PALETTES)


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splat.additive(coloured(spark, sf_dir))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from a table to an image: ranges, normalisation, projection, palette, splatting, tone mapping."""
    return fixed(splat.tone_mapped(image(spark, sf_dir)))


# ---- ranges and scalar transforms
@query(f"WITH {P} SELECT type, " + ", ".join(f"{r6(f'{f}({c})', f'{c}_{f}')}" for c in "ier" for f in ("min", "max")) + " FROM p GROUP BY type")
def range_by_type(spark, d):
    return fixed(ranges.by_type(particles(spark, d)))


@query(f"WITH {P} SELECT " + ", ".join(f"{r6(f'{f}({c})', f'{c}_{f}')}" for c in "xyzrie" for f in ("min", "max")) + " FROM p")
def field_ranges(spark, d):
    return fixed(ranges.overall(particles(spark, d), list("xyzrie")))


@query(f"WITH {P} SELECT " + ", ".join(f"{r6(f'{f}({c})', f'{c}_{f}')}" for c in "xyz" for f in ("min", "max")) + " FROM p")
def bbox(spark, d):
    return fixed(ranges.bounding_box(particles(spark, d)))


@query(f"WITH {P} SELECT count(*) AS n, count(*) FILTER (r < 1) AS small, " + ", ".join(f"count(*) FILTER (r >= 1 AND r < {k} * 0.3) AS below_{k}" for k in (1, 2, 4, 8)) + ", count(*) FILTER (r >= 8 * 0.3) AS large FROM p")
def radius_histogram(spark, d):
    return ranges.radius_histogram(particles(spark, d), 0.3)


@query(f"WITH {P}, {NORM} SELECT pid, type, {r6('i', 'i')}, {r6('e', 'e')} FROM nn")
def log_normalize(spark, d):
    return fixed(normal(spark, d).select("pid", "type", "i", "e"))


@query(f"""WITH {P}, a AS (SELECT *, CASE WHEN y - 25 < 0 THEN -1 ELSE 1 END * ln(abs(y - 25) + sqrt(1 + (y - 25) * (y - 25))) AS v FROM p),
s AS (SELECT type, min(v) AS lo, max(v) AS hi FROM a GROUP BY type)
SELECT pid, {r6("CASE WHEN hi = lo THEN 1 ELSE (v - lo) / (hi - lo) END", "y")} FROM a JOIN s USING (type)""")
def asinh_normalize(spark, d):
    df = particles(spark, d).withColumn("y", F.col("y") - 25)
    return fixed(ranges.normalised(df, ["y"], arsinh=["y"]).select("pid", "y"))


@query(f"WITH {P} SELECT pid, {r6('(greatest(5000, least(50000, i)) - 5000) / 45000.0', 'i')} FROM p")
def minmax_override(spark, d):
    return fixed(ranges.normalised(particles(spark, d), ["i"], limits={"i": (5000.0, 50000.0)}).select("pid", "i"))


@query("SELECT vec_id AS pid, " + ", ".join(r6(f"CASE WHEN embedding[{k}] > 0 THEN log10(embedding[{k}]::DOUBLE) ELSE -38 END", f"c{k - 3}") for k in (4, 5, 6)) + " FROM embeddings")
def vector_log(spark, d):
    return fixed(ranges.transformed(vectors(spark, d), log=["c1", "c2", "c3"]).select("pid", "c1", "c2", "c3"))


@query("SELECT label AS type, " + ", ".join(f"{r6(f'{g}({f}(embedding[4]::DOUBLE), {f}(embedding[5]::DOUBLE), {f}(embedding[6]::DOUBLE))', f'c_{f}')}" for f, g in (("min", "least"), ("max", "greatest"))) + " FROM embeddings GROUP BY label")
def vector_range(spark, d):
    v = ranges.by_type(vectors(spark, d), ["c1", "c2", "c3"])
    return fixed(v.select("type", F.least("c1_min", "c2_min", "c3_min").alias("c_min"), F.greatest("c1_max", "c2_max", "c3_max").alias("c_max")))


@query("""SELECT o_orderkey AS k, CASE WHEN o_totalprice >= 100000 THEN 1 ELSE -1 END AS sign, floor(o_totalprice / 7 + 0.5)::BIGINT AS nearest, floor(sqrt(o_orderkey + 0.5))::BIGINT AS isqrt,
floor(log2(o_orderkey + 0.25))::INT AS ilog2, bit_count((o_orderkey & -o_orderkey) - 1)::INT AS zeros, abs(o_totalprice - o_totalprice * 1.000001) <= 1e-5 * abs(o_totalprice * 1.000001) AS close,
round(((o_totalprice - 1e5) % 360 + 360) % 360, 6) + 0.0 AS modulo FROM orders WHERE o_orderkey > 0""")
def scalar_functions(spark, d):
    o = table(spark, d, "orders").filter("o_orderkey > 0")
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    return fixed(o.select(k.alias("k"), scalar.sign(v - 100000).alias("sign"), scalar.nearest(v / 7).alias("nearest"), scalar.isqrt(k).alias("isqrt"), scalar.ilog2(k).alias("ilog2"), scalar.trailing_zeros(k).alias("zeros"), scalar.approx(v, v * 1.000001).alias("close"), F.pmod(v - 1e5, F.lit(360.0)).alias("modulo")))


_A, _B = (tuple(f"embedding[{k}]::DOUBLE" for k in ks) for ks in ((1, 2, 3), (4, 5, 6)))
_DOT = " + ".join(f"{a} * {b}" for a, b in zip(_A, _B, strict=True))
_CROSS = tuple(f"({_A[i]} * {_B[j]} - {_A[j]} * {_B[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


@query(
    "WITH v AS (SELECT vec_id AS pid, " + ", ".join(f"{e} AS {n}" for e, n in zip((*_A, *_B), ("ax", "ay", "az", "px", "py", "pz"), strict=True)) + f", {_DOT} AS dot, sqrt({' + '.join(f'{c} * {c}' for c in _CROSS)}) AS area FROM embeddings), "
    "n AS (SELECT *, -ay AS ex, ax AS ey, ay * 0 - az * ax AS nx, az * -ay - ax * 0 AS ny, ax * ax + ay * ay AS nz FROM v) "
    f"SELECT pid, {r6('dot', 'dot')}, {r6('area', 'area')}, {r6('atan2(area, dot)', 'angle')}, {r6('atan2(-(px * ex + py * ey), px * nx + py * ny + pz * nz)', 'orientation')}, "
    f"{r6('sin(ax) * sin(px) + cos(ay - py) * sqrt((1 - sin(ax) * sin(ax)) * (1 - sin(px) * sin(px)))', 'cosine')} FROM n WHERE ax <> 0 OR ay <> 0"
)
def vector_functions(spark, d):
    e = [F.col("embedding")[k].cast("double") for k in range(6)]
    a, b = tuple(e[:3]), tuple(e[3:])
    v = table(spark, d, "embeddings").filter((e[0] != 0) | (e[1] != 0))
    cosine = vec.cosine_between(F.sin(a[0]), a[1], F.sin(b[0]), b[1])
    return fixed(v.select(F.col("vec_id").alias("pid"), vec.dot(a, b).alias("dot"), vec.length(vec.cross(a, b)).alias("area"), vec.angle(a, b).alias("angle"), vec.orientation(a, b).alias("orientation"), cosine.alias("cosine")))


@query("""SELECT p_partkey AS k, trim(p_name) AS trimmed, upper(p_brand) = p_brand OR lower(p_brand) = lower(upper(p_brand)) AS same, len(list_filter(string_split(p_type, ' '), lambda x: x <> ''))::INT AS n_words,
array_to_string(list_filter(string_split(p_brand, '#'), lambda x: x <> ''), '|') AS parts, CASE WHEN length(p_size::VARCHAR) >= 4 THEN p_size::VARCHAR ELSE lpad(p_size::VARCHAR, 4, '0') END AS padded FROM part""")
def string_functions(spark, d):
    brand = F.col("p_brand")
    parts = F.array_join(vec.tokens(brand, "#"), "|")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("k"), vec.trimmed(F.col("p_name")).alias("trimmed"), vec.equal_nocase(brand, F.upper(brand)).alias("same"),
        F.size(vec.words(F.col("p_type"))).alias("n_words"), parts.alias("parts"), vec.zero_padded(F.col("p_size"), 4).alias("padded"),
    )


@query("SELECT c_custkey AS pid, 0 AS type, c_custkey::DOUBLE AS x, c_nationkey::DOUBLE AS y, 0.0::DOUBLE AS z, 2.0::DOUBLE AS r, c_acctbal AS i, 1.0::DOUBLE AS c1, 0.0::DOUBLE AS c2, 0.0::DOUBLE AS c3 FROM customer")
def named_columns(spark, d):
    return records.bound(table(spark, d, "customer"), {"pid": "c_custkey", "x": "c_custkey", "y": "c_nationkey", "i": "c_acctbal"}, size=2.0)


# ---- predicates
@query(f"WITH {P} SELECT pid, CASE species WHEN 'R' THEN 0 ELSE 1 END AS type FROM p WHERE species IN ('R', 'A')")
def species_select(spark, d):
    return filters.select_species(particles(spark, d), ["R", "A"]).select("pid", "type")


@query(f"WITH {P} SELECT pid FROM p WHERE i BETWEEN 10000 AND 60000 AND z BETWEEN 2 AND 30 AND e BETWEEN 950 AND 2000")
def clip_filter(spark, d):
    return filters.clipped(particles(spark, d), CLIPS).select("pid")


@query(f"WITH {P} SELECT pid, (CASE WHEN i < 10000 OR i > 60000 THEN 1 ELSE 0 END + CASE WHEN z < 2 OR z > 30 THEN 2 ELSE 0 END + CASE WHEN e < 950 OR e > 2000 THEN 4 ELSE 0 END)::INT AS mask FROM p")
def clip_mask_bits(spark, d):
    return particles(spark, d).select("pid", filters.clip_mask(CLIPS).alias("mask"))


def _combine(op: str, sql: str) -> None:
    def f(spark, d):
        return fixed(session.Session(particles(spark, d)).put("c", session.Combine("i", op, "y")).frame().select("pid", "i"))

    f.__name__ = f"comb_field_{op}"
    query(f"WITH {P} SELECT pid, {r6(sql, 'i')} FROM p")(f)


for _op, _sql in (("add", "i + y"), ("sub", "i - y"), ("mul", "i * y"), ("div", "i / nullif(y, 0)")):
    _combine(_op, _sql)


@query(f"WITH {P}, c AS (SELECT * FROM p WHERE x BETWEEN 5 AND 45), s AS (SELECT min(e) AS lo, max(e) AS hi FROM c) SELECT pid, {r6('(e - lo) / nullif(hi - lo, 0)', 'e')} FROM c, s")
def norm_unclamped(spark, d):
    s = session.Session(particles(spark, d)).put("clip", session.Clip("x", 0.0, 1.0)).put("clip", session.Clip("x", 5.0, 45.0))
    return fixed(s.normalised("e").select("pid", "e"))


@query(f"WITH {P} SELECT pid, {r6('y', 'e')} FROM p")
def field_rebind(spark, d):
    return fixed(session.Session(particles(spark, d)).put("a", session.Rebind("e", "y")).put("b", session.Clip("x", 0, 1)).drop("b").frame().select("pid", "e"))


@query(f"WITH {P} SELECT pid FROM p WHERE sqrt((x - 25) * (x - 25) + (y - 25) * (y - 25) + (z - 20) * (z - 20)) < 18.5")
def far_cull(spark, d):
    return filters.far_cull(particles(spark, d), (25.0, 25.0, 20.0), 18.5).select("pid")


@query(f"WITH {P} SELECT pid FROM p WHERE x BETWEEN 10 AND 30 AND y BETWEEN 5 AND 25 AND z BETWEEN 0 AND 20")
def spatial_box(spark, d):
    return filters.box(particles(spark, d), (10, 5, 0), (30, 25, 20)).select("pid")


@query(f"WITH {P}, n AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY pid) AS nth FROM p) SELECT type, pid FROM n WHERE (nth - 1) % 10 = 0")
def systematic_sample(spark, d):
    return filters.every_kth(particles(spark, d), 10, ["pid"], ["type"]).select("type", "pid")


@query(f"WITH {P} SELECT pid FROM p WHERE r > ((x - 25) * 0.6 + (z - 20) * 0.8) AND r > ((x - 25) * -0.6 + (z - 20) * 0.8)")
def cone_reduce(spark, d):
    moved = particles(spark, d).withColumns({"x": F.col("x") - 25, "z": F.col("z") - 20})
    return filters.cone_reduce(moved, [(0.6, 0.0, 0.8), (-0.6, 0.0, 0.8)]).select("pid")


# ---- space to image
def _wrap(c: str, at: float, box: float) -> str:
    return r6(f"CASE WHEN {c} - {at} > {box / 2} THEN {c} - {box} WHEN {c} - {at} < {-box / 2} THEN {c} + {box} ELSE {c} END", c)


@query(f"WITH {P} SELECT pid, {_wrap('x', 40.0, 50.0)}, {_wrap('y', 5.0, 50.0)}, {_wrap('z', 25.0, 50.0)} FROM p")
def periodic_wrap(spark, d):
    return fixed(cam.wrapped(particles(spark, d), (40.0, 5.0, 25.0), 50.0).select("pid", "x", "y", "z"))


@query(f"WITH {P} SELECT pid, {r6('CASE WHEN y - x > 25 THEN y - 50 WHEN y - x < -25 THEN y + 50 ELSE y END', 'y')} FROM p")
def min_image_delta(spark, d):
    return fixed(particles(spark, d).select("pid", cam.minimum_image(F.col("x"), F.col("y"), 50.0).alias("y")))


@query(f"{SEEN_DEEP} SELECT pid, {r6('x', 'x')}, {r6('y', 'y')}, {r6('z', 'z')} FROM v1")
def camera_transform(spark, d):
    return fixed(cam.transformed(particles(spark, d), DEEP).select("pid", "x", "y", "z"))


@query(f"{SEEN_DEEP} SELECT pid, {r6('x', 'x')}, {r6('y', 'y')} FROM v3")
def perspective_project(spark, d):
    return fixed(cam.projected(filters.depth_cull(cam.transformed(normal(spark, d), DEEP), DEEP), DEEP).select("pid", "x", "y"))


@query(f"{SEEN} SELECT pid, {r6('x', 'x')}, {r6('y', 'y')} FROM v3")
def ortho_project(spark, d):
    return fixed(cam.projected(cam.transformed(normal(spark, d), FLAT), FLAT).select("pid", "x", "y"))


@query(f"{SEEN_DEEP} SELECT pid FROM v1 WHERE -z > 60 AND -z < 90")
def depth_cull(spark, d):
    near = geometry.replace(DEEP, zmin=60.0, zmax=90.0)
    return filters.depth_cull(cam.transformed(particles(spark, d), DEEP), near).select("pid")


@query(f"{SEEN_DEEP} SELECT pid, minx, maxx, miny, maxy FROM seen")
def screen_cull(spark, d):
    return cam.seen(normal(spark, d), DEEP).select("pid", "minx", "maxx", "miny", "maxy")


@query(f"{SEEN_DEEP} SELECT pid, {r6('r', 'r')}, {r6('i', 'i')} FROM v5")
def kernel_scale(spark, d):
    p = cam.projected(filters.depth_cull(cam.transformed(normal(spark, d), DEEP), DEEP), DEEP)
    return fixed(cam.kernel_scaled(p, DEEP).select("pid", "r", "i"))


# ---- colours and pixels
@query(f"WITH {P}, {NORM} SELECT pid, {r6('greatest(0, 2 * e - 1)', 'red')}, {r6('1 - abs(2 * e - 1)', 'green')}, {r6('greatest(0, 1 - 2 * e)', 'blue')} FROM nn")
def palette_lookup(spark, d):
    return fixed(normal(spark, d).select("pid", *[c.alias(n) for c, n in zip(palette.lookup(F.col("e"), COLOURS), RGB, strict=True)]))


@query(f"{SEEN_DEEP} SELECT pid, {r6('red', 'red')}, {r6('green', 'green')}, {r6('blue', 'blue')} FROM lit")
def colorize(spark, d):
    return fixed(coloured(spark, d, DEEP).select("pid", *RGB))


TILES = SEEN_DEEP + f""", t1 AS (SELECT *, unnest(range(minx // 16, (maxx - 1) // 16 + 1)) AS tx FROM seen), t2 AS (SELECT *, unnest(range(miny // 16, (maxy - 1) // 16 + 1)) AS ty FROM t1),
tile AS (SELECT pid, tx::INT AS tx, ty::INT AS ty FROM t2 WHERE (x - (tx + 0.5) * 16) ** 2 + (y - (ty + 0.5) * 16) ** 2 < (16 * sqrt(0.5) + {scalar.RFAC} * r) ** 2)"""


@query(TILES + " SELECT pid, tx, ty FROM tile")
def tile_join(spark, d):
    return splat.tiles(cam.seen(normal(spark, d), DEEP), 16).select("pid", "tx", "ty")


@query(TILES + ", c AS (SELECT tx, ty, count(*) AS n FROM tile GROUP BY tx, ty) SELECT tx, ty, n, sum(n) OVER (ORDER BY tx, ty ROWS UNBOUNDED PRECEDING)::BIGINT AS up_to FROM c")
def tile_histogram_scan(spark, d):
    return splat.tile_counts(cam.seen(normal(spark, d), DEEP), 16)


@query(f"{SEEN} SELECT px::INT AS x, py::INT AS y, count(*) AS n FROM hit GROUP BY px, py")
def pixel_coverage(spark, d):
    return splat.covered(cam.seen(normal(spark, d), FLAT), ["pid"]).groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{IMAGE} SELECT x, y, " + ", ".join(r6(c, c) for c in RGB) + " FROM img")
def splat_a_eq_e(spark, d):
    return fixed(image(spark, d))


@query(f"{IMAGE} SELECT x, y, " + ", ".join(r6(c, c) for c in RGB) + " FROM img")
def splat_a_eq_e_split_wide(spark, d):
    return fixed(splat.additive(coloured(spark, d), split_wide=True))


@query(
    SEEN + ", w AS (SELECT *, " + ", ".join(f"coalesce(sum({c} * att) OVER (PARTITION BY px, py ORDER BY z, pid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS f_{c}" for c in RGB)
    + " FROM hit) SELECT px::INT AS x, py::INT AS y, " + ", ".join(r6(f"sum({c} / ({c} + 0.2) * (1 - exp(-{c} * att)) * exp(-f_{c}))", c) for c in RGB) + " FROM w GROUP BY px, py"
)
def splat_a_neq_e(spark, d):
    return fixed(splat.absorbing(coloured(spark, d)))


@query(_all["splat_a_neq_e"][1])
def depth_composite(spark, d):
    """Three layers of depth, drawn apart and put together, are the image drawn at once."""
    z = F.col("z")
    layered = coloured(spark, d).withColumn("layer", F.when(z >= -50, 0).when(z >= -65, 1).otherwise(2))
    return fixed(splat.composited(splat.layer_images(layered)).select("x", "y", *RGB))


@query(f"{TONED} SELECT x, y, " + ", ".join(r6(c, c) for c in RGB) + " FROM tone")
def tone_map(spark, d):
    return fixed(splat.tone_mapped(image(spark, d)))


@query(f"{TONED} SELECT x, y, " + ", ".join(r6(f"1.3 * pow({c}, 0.7) + 0.05", c) for c in RGB) + " FROM tone")
def gamma_contrast(spark, d):
    return fixed(splat.adjusted(splat.tone_mapped(image(spark, d)), 0.7, 1.3, 0.05))


@query(f"{TONED} SELECT x, y, " + ", ".join(f"greatest(0, least(255, trunc(round({c}, {FINE}) * 256)::INT)) AS {c}" for c in RGB) + " FROM tone")
def quantize(spark, d):
    return splat.quantised(fixed(splat.tone_mapped(image(spark, d))))


BARS = "b AS (SELECT x::INT AS x, y::INT AS y, x / 64.0 AS v FROM range(64) t(x), range(10) u(y))"


@query(f"{TONED}, {BARS} SELECT x, y, {r6('greatest(0, 2 * v - 1)', 'red')}, {r6('1 - abs(2 * v - 1)', 'green')}, {r6('greatest(0, 1 - 2 * v)', 'blue')} FROM b UNION ALL SELECT x, y, " + ", ".join(r6(c, c) for c in RGB) + " FROM tone WHERE y >= 10")
def colorbar(spark, d):
    return fixed(palette.with_bar(splat.tone_mapped(image(spark, d)), palette.colour_bar(spark, {0: COLOURS}, 64)))


@query(
    f"{TONED}, q AS (SELECT x, y, " + ", ".join(f"trunc(round({c}, {FINE}) * 8)::INT AS {c}" for c in RGB) + """ FROM tone),
g AS (SELECT *, CASE WHEN red = lag(red) OVER w AND green = lag(green) OVER w AND blue = lag(blue) OVER w AND x = lag(x) OVER w + 1 THEN 0 ELSE 1 END AS new FROM q WINDOW w AS (PARTITION BY y ORDER BY x)),
h AS (SELECT *, sum(new) OVER (PARTITION BY y ORDER BY x) AS island FROM g), k AS (SELECT *, (row_number() OVER (PARTITION BY y, island ORDER BY x) - 1) // 128 AS packet FROM h)
SELECT y, min(x) AS start, count(*) AS n, red, green, blue FROM k GROUP BY y, island, packet, red, green, blue"""
)
def rle_runs(spark, d):
    q = fixed(splat.tone_mapped(image(spark, d)))
    return splat.runs(q.withColumns({c: (F.col(c) * 8).cast("int") for c in RGB}))


@query(f"""{TONED}, o AS (SELECT * FROM (VALUES (-1, 0.5), (0, 1.0), (1, 0.5)) t(o, w)),
f AS (SELECT 2 * x + a.o AS x, 2 * y + b.o AS y, a.w * b.w AS w, red, green, blue FROM tone, o a, o b) SELECT x, y, """ + ", ".join(r6(f"sum(w * {c})", c) for c in RGB) + " FROM f WHERE x >= 0 AND y >= 0 GROUP BY x, y")
def pyramid_upsample(spark, d):
    return fixed(splat.upsampled(splat.tone_mapped(image(spark, d))))


# ---- snapshots
def _snap(day: int) -> str:
    return f"""SELECT user_id AS id, CASE WHEN event_type < 'm' THEN 0 ELSE 1 END AS type, hour(ts)::DOUBLE AS x, value AS y, minute(ts)::DOUBLE AS z, 1.0 AS r, value AS i, value / 10 AS e,
  value / 100 AS vx, 0.5 AS vy, hour(ts) / 24.0 AS vz, row_number() OVER (PARTITION BY user_id ORDER BY hour(ts), value, minute(ts), event_id) AS nth
  FROM events WHERE ts >= '2024-01-{day:02d}'::TIMESTAMP AND ts < '2024-01-{day + 1:02d}'::TIMESTAMP"""


PAIRS = f"a AS ({_snap(5)}), b AS ({_snap(6)}), j AS (SELECT coalesce(a.id, b.id) AS id, coalesce(a.nth, b.nth) AS nth, coalesce(a.type, b.type) AS type, " + ", ".join(f"{s}.{c} AS {c}{n}" for s, n in (("a", 1), ("b", 2)) for c in ("x", "y", "z", "r", "i", "e", "vx", "vy", "vz")) + " FROM a FULL JOIN b ON a.id = b.id AND a.nth = b.nth)"
_FADE = "CASE WHEN x1 IS NULL THEN 0.3 WHEN x2 IS NULL THEN 0.7 ELSE 1 END"


def pairs(spark, d):
    return interpolate.paired(snapshot(spark, d, 5), snapshot(spark, d, 6), ["x", "y", "z", "eid"])


def _mix(c: str) -> str:
    return f"CASE WHEN x1 IS NOT NULL AND x2 IS NOT NULL THEN 0.7 * {c}1 + 0.3 * {c}2 ELSE coalesce({c}1, {c}2) END"


@query(f"WITH {PAIRS} SELECT id, nth::INT AS nth, type, x1, x2, y1, y2 FROM j")
def snapshot_full_outer(spark, d):
    return pairs(spark, d).select("id", "nth", F.coalesce("type1", "type2").alias("type"), "x1", "x2", "y1", "y2")


@query(f"WITH {PAIRS} SELECT CASE WHEN x1 IS NULL THEN 'appear' WHEN x2 IS NULL THEN 'disappear' ELSE 'stay' END AS state, count(*) AS n FROM j GROUP BY 1")
def appear_disappear(spark, d):
    return interpolate.change(pairs(spark, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAIRS} SELECT id, type, " + ", ".join(r6(_mix(c), c) for c in "xyzre") + f", {r6(f'({_mix("i")}) * {_FADE}', 'i')} FROM j")
def interp_linear(spark, d):
    return fixed(interpolate.linear(pairs(spark, d), 0.3))


def _cubic(c: str) -> str:
    x1 = f"CASE WHEN x1 IS NULL THEN {c}2 - v{c}2 / 1.2 ELSE {c}1 END"
    x2 = f"CASE WHEN x2 IS NULL THEN {c}1 + v{c}1 / 1.2 ELSE {c}2 END"
    v1, v2 = f"coalesce(v{c}1, v{c}2) * 1.0", f"coalesce(v{c}2, v{c}1) * 1.4"
    return f"(2 * 0.027 - 3 * 0.09 + 1) * ({x1}) + (0.027 - 2 * 0.09 + 0.3) * {v1} + (3 * 0.09 - 2 * 0.027) * ({x2}) + (0.027 - 0.09) * {v2}"


@query(f"WITH {PAIRS} SELECT id, type, " + ", ".join(r6(_cubic(c), c) for c in "xyz") + ", " + ", ".join(r6(_mix(c), c) for c in "re") + f", {r6(f'({_mix("i")}) * {_FADE}', 'i')} FROM j")
def interp_cubic(spark, d):
    return fixed(interpolate.cubic(pairs(spark, d), 0.3, 1.0, 1.4))


@query()
def interp_orbital(spark, d):
    return interpolate.orbital(pairs(spark, d), 0.3, 1.0, 1.4)


@query("SELECT event_id AS frame, round(value / 10, 6) + 0.0 AS fidx, (floor(value / 10 / 4) * 4)::INT AS snr1, (floor(value / 10 / 4) * 4)::INT + 4 AS snr2, round((value / 10 - (floor(value / 10 / 4) * 4)::INT) / 4, 6) + 0.0 AS frac FROM events")
def snapshot_bracket(spark, d):
    return fixed(interpolate.bracket(table(spark, d, "events").select(F.col("event_id").alias("frame"), (F.col("value") / 10).alias("fidx")), 4))


@query("SELECT DISTINCT ts::DATE AS day FROM events")
def distinct_snapshots(spark, d):
    return table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()


@query(f"WITH {P} SELECT 0 AS type, pid, e FROM p WHERE species = 'N' UNION ALL SELECT 1, pid, e FROM p WHERE species = 'A'")
def union_species(spark, d):
    p = particles(spark, d)
    one = lambda s, t: p.filter(F.col("species") == s).select(F.lit(t).alias("type"), "pid", "e")
    return one("N", 0).unionByName(one("A", 1))


# ---- grids and level of detail
@query("SELECT i AS pid, (i % 16)::DOUBLE AS x, (i // 16 % 12)::DOUBLE AS y, (i // 192)::DOUBLE AS z FROM range(16 * 12 * 8) t(i)")
def mesh_coords(spark, d):
    return snapshots.with_mesh_places(spark.range(16 * 12 * 8).select(F.col("id").alias("pid")), (16, 12, 8))


CELLS = f"""WITH {P}, g0 AS (SELECT count(*) AS n, """ + ", ".join(f"min({c}) - 0.01 * abs(min({c})) AS {c}_lo, max({c}) + 0.01 * abs(max({c})) AS {c}_hi" for c in "xyz") + " FROM p), g1 AS (SELECT *, 5 * pow((x_hi - x_lo) * (y_hi - y_lo) * (z_hi - z_lo) / n, 1.0 / 3) AS side FROM g0), g2 AS (SELECT *, " + ", ".join(f"CASE WHEN ceil(({c}_hi - {c}_lo) / side) > 32 THEN ({c}_hi - {c}_lo) / 32 ELSE side END AS {c}_d, least(32, ceil(({c}_hi - {c}_lo) / side))::INT AS {c}_n" for c in "xyz") + " FROM g1), c AS (SELECT p.*, (" + "least(floor((z - z_lo) / z_d), z_n - 1) + z_n * (least(floor((y - y_lo) / y_d), y_n - 1) + y_n * least(floor((x - x_lo) / x_d), x_n - 1)))::INT AS cell FROM p, g2)"


@query(CELLS + " SELECT pid, cell FROM c")
def grid_cells(spark, d):
    return lod.grid(particles(spark, d)).select("pid", "cell")


@query(CELLS + ", k AS (SELECT cell, count(*) AS n FROM c GROUP BY cell) SELECT cell, n, (sum(n) OVER (ORDER BY cell ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS \"offset\" FROM k")
def cell_offsets(spark, d):
    return lod.offsets(lod.grid(particles(spark, d)))


_SIDE = f"{2**0.5!r} * (z + 1) * {float(np.tan(np.radians(45) / 2))!r}"
_LAT = "sqrt((x - 25 - CASE WHEN x - 25 < 0 THEN -0.8 ELSE 0.8 END) ** 2 + (y - 25 - CASE WHEN y - 25 < 0 THEN -0.8 ELSE 0.8 END) ** 2)"


@query(f"WITH {P}, l AS (SELECT pid, z + 1 AS z, {_LAT} AS lat, {_SIDE} AS side FROM p) SELECT pid, lat <= side AND z > 0 AS active, {r6('CASE WHEN lat <= side AND z > 0 THEN 0.9 * exp(-lat * lat / (2 * side * side)) * exp(-z * z / (2 * 30.0 * 30.0)) ELSE 0 END', 'weight')} FROM l")
def lod_weight(spark, d):
    cells = particles(spark, d).select("pid", (F.col("x") - 25).alias("x"), (F.col("y") - 25).alias("y"), (F.col("z") + 1).alias("z"))
    return fixed(lod.weights(cells, diagonal=0.8, quality=0.9, fov=45.0, dist=30.0).select("pid", "active", "weight"))


@query(CELLS + ", k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY (pid * 2654435761) % 4294967296, pid) AS nth, count(*) OVER (PARTITION BY cell) AS n FROM (SELECT pid % 1000003 AS pid, cell FROM c)) SELECT pid, cell, round(n / floor(0.3 * n), 6) AS boost FROM k WHERE nth <= floor(0.3 * n)")
def lod_sample(spark, d):
    cells = lod.grid(particles(spark, d)).select((F.col("pid") % 1000003).alias("pid"), "cell")
    return fixed(lod.stratified(cells, 0.3, [(F.col("pid") * 2654435761) % 4294967296, F.col("pid")]))


@query(f"WITH {P} SELECT pid, greatest(0, ceil(log2(r / 0.55)) - 1)::INT AS level FROM p")
def lod_octaves(spark, d):
    return particles(spark, d).select("pid", lod.octave(F.col("r"), 0.55).alias("level"))


# ---- orders and selection
def _sorted(name: str, order: str, kind: int) -> None:
    def f(spark, d):
        return selection.ranked(particles(spark, d), kind).select("pid", "rank")

    f.__name__ = f"sort_{name}"
    query(f"WITH {P} SELECT pid, row_number() OVER (ORDER BY {order}) AS rank FROM p")(f)


_sorted("z", "z, pid", 1)
_sorted("value", "e DESC, pid", 2)
_sorted("value_rev", "e, pid", 3)
_sorted("size", "r DESC, pid", 4)


@query(f"WITH {P} SELECT {r6('e', 'value')} FROM p ORDER BY e LIMIT 1 OFFSET 2345")
def nth_element(spark, d):
    value = selection.nth_smallest(particles(spark, d), "e", 2345)
    return fixed(spark.createDataFrame([(value,)], "value double"))


@query(f"""WITH {P}, b AS (SELECT count(*) AS n, max(x) - min(x) AS dx, max(y) - min(y) AS dy, max(z) - min(z) AS dz FROM p),
a AS (SELECT n, CASE WHEN dx >= dy AND dx >= dz THEN 'x' WHEN dy >= dz THEN 'y' ELSE 'z' END AS axis FROM b),
v AS (SELECT axis, n, CASE axis WHEN 'x' THEN x WHEN 'y' THEN y ELSE z END AS v FROM p, a), r AS (SELECT *, row_number() OVER (ORDER BY v) - 1 AS nth FROM v),
m AS (SELECT axis, v AS middle FROM r WHERE nth = n // 2)
SELECT m.axis, {r6('middle', 'middle')}, count(*) FILTER (v < middle) AS low, count(*) FILTER (v >= middle) AS high FROM v, m GROUP BY m.axis, middle""")
def longest_axis_split(spark, d):
    axis, pivot, low, high = selection.halves(particles(spark, d))
    return fixed(spark.createDataFrame([(axis, pivot, low.count(), high.count())], "axis string, middle double, low long, high long"))


@query("SELECT o_orderkey AS k, o_orderkey % 10007 AS item, (CASE WHEN o_orderkey % 10007 < 5720 THEN (o_orderkey % 10007) // 1430 ELSE (o_orderkey % 10007 - 5720) // 1429 + 4 END)::INT AS share FROM orders")
def share_of_items(spark, d):
    item = F.col("o_orderkey") % 10007
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), item.alias("item"), selection.share_of(item, 10007, 7).alias("share"))


@query(f"WITH {P} SELECT type, {r6('quantile_cont(e, 0.5)', 'median')} FROM p GROUP BY type")
def median_split(spark, d):
    return fixed(selection.medians(particles(spark, d), "e", ["type"]))


@query(f"WITH {P} SELECT pid, x < 25 AS low, (CASE WHEN x < 25 AND x + r > 25 THEN 2 WHEN x >= 25 AND x - r < 25 THEN 1 ELSE 0 END)::INT AS ghost FROM p")
def kd_ghosts(spark, d):
    x, r = F.col("x"), F.col("r")
    return particles(spark, d).select("pid", (x < 25).alias("low"), F.when((x < 25) & (x + r > 25), 2).when((x >= 25) & (x - r < 25), 1).otherwise(0).alias("ghost"))


@query("SELECT o_orderkey AS k, (o_orderkey * 1000003) & 1073741823 AS gas, o_orderkey + 536870912 AS star, o_orderkey & 281474976710655 AS low, (o_orderkey * 1000003) >> 48 AS high FROM orders")
def id_patch(spark, d):
    k = F.col("o_orderkey")
    low, _ = snapshots.packed_id(k)
    _, high = snapshots.packed_id(k * 1000003)
    return table(spark, d, "orders").select(k.alias("k"), snapshots.patched_id(k * 1000003, 0).alias("gas"), snapshots.patched_id(k, 4).alias("star"), low.alias("low"), high.alias("high"))


# ---- frames and commands
@query("SELECT event_type AS key, max_by(json_extract_string(props, '$.k'), (ts, event_id)) AS value FROM events GROUP BY event_type")
def latest_params(spark, d):
    return stream.latest(commands(spark, d))


@query("WITH f AS (SELECT event_id, user_id, round(value, 0) AS fidx, lag(round(value, 0)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT event_id, user_id, fidx + 0.0 AS fidx, coalesce(abs(fidx - before) <= 1e-5 * abs(before), false) AS reuse FROM f")
def frame_reuse_lag(spark, d):
    """Each user's events are a list of scenes."""
    f = table(spark, d, "events").select("event_id", "user_id", F.round("value", 0).alias("fidx"))
    return selection.previous(f, "fidx", ["event_id"], ["user_id"]).withColumn("reuse", F.coalesce(scalar.approx(F.col("fidx"), F.col("before")), F.lit(False))).drop("before")


def _frames_sql(frames: dict[str, Camera]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS name, " + ", ".join(f"round({float(v)!r}, 6) + 0.0 AS {k}" for k, v in zip(("cx", "cy", "cz", "lx", "ly", "lz"), (*c.position, *c.lookat), strict=True)) for n, c in frames.items())


def _frames(spark, frames):
    return fixed(spark.createDataFrame([(n, *map(float, c.position), *map(float, c.lookat)) for n, c in frames.items()], "name string, cx double, cy double, cz double, lx double, ly double, lz double"))


@query("SELECT 'right_' AS name, round(70 + 32.5 * k, 6) AS cx, round(-40 + 22.5 * k, 6) AS cy, 60.0::DOUBLE AS cz, 25.0::DOUBLE AS lx, 25.0::DOUBLE AS ly, 15.0::DOUBLE AS lz FROM (SELECT sqrt(8275.0) * radians(3) / sqrt(65.0 * 65 + 45 * 45) AS k)"
       " UNION ALL SELECT 'left_', round(70 - 32.5 * k, 6), round(-40 - 22.5 * k, 6), 60, 25, 25, 15 FROM (SELECT sqrt(8275.0) * radians(3) / sqrt(65.0 * 65 + 45 * 45) AS k)")  # fmt: skip
def stereo_frames(spark, d):
    return _frames(spark, geometry.stereo(DEEP, 3.0))


@query("SELECT name, 70.0::DOUBLE AS cx, -40.0::DOUBLE AS cy, 60.0::DOUBLE AS cz, (70 + dx)::DOUBLE AS lx, (-40 + dy)::DOUBLE AS ly, (60 + dz)::DOUBLE AS lz FROM (VALUES ('1_', 1, 0, 0), ('2_', 0, 1, 0), ('3_', -1, 0, 0), ('4_', 0, -1, 0), ('5_', 0, 0, 1), ('6_', 0, 0, -1)) t(name, dx, dy, dz)")
def panorama_frames(spark, d):
    return _frames(spark, geometry.panorama(DEEP))


@query("SELECT vec_id AS pid, " + ", ".join(f"round(embedding[1]::DOUBLE - embedding[{k}]::DOUBLE, 6) + 0.0 AS c{k + 3}" for k in (2, 3, 4)) + " FROM embeddings")
def derived_colours(spark, d):
    e = lambda k: F.col("embedding")[k].cast("double")
    return fixed(table(spark, d, "embeddings").select(F.col("vec_id").alias("pid"), *[(e(0) - e(k)).alias(f"c{k + 4}") for k in (1, 2, 3)]))


PLANE, DOME = geometry.replace(DEEP, fov=60.0), geometry.replace(DEEP, fov=150.0, yres=64)


def _rays_sql(c: Camera, dome: bool) -> str:
    """Every pixel's direction with every particle whose disc holds it; no disc here holds the camera."""
    forward = geometry.unit(np.subtract(c.lookat, c.position))
    right = geometry.unit(np.cross(forward, c.sky))
    up = np.cross(right, forward)
    half, w, h = float(np.radians(c.fov) / 2), c.xres, c.height
    if dome:
        pixel = 2 * half / w
        polar = f"SELECT x, y, (x - {w / 2}) / {w / 2} AS u, (y - {h / 2}) / {w / 2} AS v FROM g"
        polar = f"SELECT *, sqrt(u * u + v * v) AS rho FROM ({polar})"
        parts = [f"cos(rho * {half!r}) * {float(f)!r} + sin(rho * {half!r}) / greatest(rho, 1e-300) * (u * {float(a)!r} + v * {float(b)!r}) AS d{k}" for k, (f, a, b) in enumerate(zip(forward, right, up, strict=True))]
        px = f"SELECT x, y, {', '.join(parts)} FROM ({polar}) WHERE rho <= 1"
    else:
        pixel = 2 * float(np.tan(half)) / w
        t = float(np.tan(half)) / (w / 2)
        parts = [f"{float(f)!r} + ((x - {w / 2}) * {float(a)!r} + (y - {h / 2}) * {float(b)!r}) * {t!r} AS d{k}" for k, (f, a, b) in enumerate(zip(forward, right, up, strict=True))]
        px = f"SELECT x, y, d0 / n AS d0, d1 / n AS d1, d2 / n AS d2 FROM (SELECT *, sqrt(d0 * d0 + d1 * d1 + d2 * d2) AS n FROM (SELECT x, y, {', '.join(parts)} FROM g))"
    away = " + ".join(f"({n} - {float(v)!r}) ** 2" for n, v in zip("xyz", c.position, strict=True))
    least = c.minrad * pixel
    return f"""WITH {P}, {NORM}, q0 AS (SELECT *, sqrt({away}) AS away, greatest(0, least(1, e)) * 2 AS pos FROM nn),
q AS (SELECT {', '.join(f"({n} - {float(v)!r}) / away AS c{k}" for k, (n, v) in enumerate(zip("xyz", c.position, strict=True)))}, sqrt(r * r / (away * away) + {least * least!r}) AS w, r / away AS r, i, pos FROM q0),
p2 AS (SELECT c0, c1, c2, w, greatest(0, pos - 1) * i * (r / w) ** 2 AS red, (1 - abs(pos - 1)) * i * (r / w) ** 2 AS green, greatest(0, 1 - pos) * i * (r / w) ** 2 AS blue FROM q),
g AS (SELECT a.i::DOUBLE AS x, b.i::DOUBLE AS y FROM range({w}) a(i), range({h}) b(i)), px AS ({px}),
hit AS (SELECT x, y, red, green, blue, w, c0 * d0 + c1 * d1 + c2 * d2 AS co FROM px JOIN p2 ON c0 * d0 + c1 * d1 + c2 * d2 >= 0 AND (c0 * d0 + c1 * d1 + c2 * d2) ** 2 >= (1 - w) * (1 + w))
SELECT x::INT AS x, y::INT AS y, {", ".join(r6(f"sum({n} * exp(-(1 - co) * (1 + co) / (w * w * {scalar.H2SIGMA**2!r})))", n) for n in RGB)} FROM hit GROUP BY hit.x, hit.y"""


def _lit(image: DataFrame) -> DataFrame:
    """Pixels that a disc touched."""
    return fixed(image.filter("red + green + blue > 0"))


def _lit_sql(sql: str) -> str:
    return sql + " HAVING sum((red + green + blue) * exp(-(1 - co) * (1 + co) / (w * w * " + repr(scalar.H2SIGMA**2) + "))) > 0"


@query(_lit_sql(_rays_sql(PLANE, False)))
def plane_render(spark, d):
    return _lit(rays.render(palette.colourised(normal(spark, d), PALETTES), PLANE))


@query(_lit_sql(_rays_sql(DOME, True)))
def dome_render(spark, d):
    return _lit(rays.render(palette.colourised(normal(spark, d), PALETTES), DOME, dome=True))


@query(_all["latest_params"][1])
def stream_latest_state(spark, d):
    """The same as ``latest_params``, through a stream that takes what there is."""
    import uuid

    from lumenfold.plans.tables import shared_dir

    ev = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    log = ev.select("ts", F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.get_json_object("props", "$.k").alias("value"))
    name, base = f"latest_{uuid.uuid4().hex}", shared_dir(spark)
    run = stream.latest(log).writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/{name}"))
    run.option("checkpointLocation", f"{base}/{name}-log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("key string, value string").parquet(f"{base}/{name}")


def _frame_sql(k: int, c: Camera) -> str:
    toned = ", ".join(r6(f"1 - exp(-sum(att * {n}))", n) for n in RGB)
    return f"SELECT {k} AS frame, * FROM (WITH {P}, {NORM}, {_seen_sql(c)} SELECT px::INT AS x, py::INT AS y, {toned} FROM hit GROUP BY px, py)"


@query(" UNION ALL ".join(_frame_sql(k, c) for k, c in enumerate((FLAT, DEEP))))
def scene_frames(spark, d):
    """Two frames of one scene list, by the batch run's own way from parameters to pictures."""
    base = frames.Params({"ptypes": "3", "simtype": "99", "outfile": "frame"} | {f"intensity_log{t}": "T" for t in range(3)})
    shown, out = None, None
    for k, c in enumerate((FLAT, DEEP)):
        p = frames._with(frames.Params({**base, "xres": str(c.xres), "yres": str(c.height), "projection": str(c.perspective)}), c)
        if shown is None:
            shown = cut(frames.prepared(frames.read(spark, p, {99: lambda s, _: particles(s, d, dealt=True).withColumn("c1", F.col("e"))}), p), "particles")
        own = frames.picture(shown, p, PALETTES).withColumn("frame", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return fixed(out)


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in _all.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _all.items() if s}
