"""Splatting: discs become pixels, pixels become colours.

A disc is exploded to columns, then each column to its rows, so the factor of a column is computed once a column. Additive
emission is a grouped sum with partial sums in the map tasks. Ordered absorption is a running sum within a pixel of a layer
of depth, front to back. With ``split_wide``, discs wider than ``TILE`` pixels are dealt to tiles first, so no task explodes one of them alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.scalar import H2SIGMA, RFAC
from lumenfold.plans.tables import cut, parts

TILE = 50
COLOURS = ("red", "green", "blue")


def tiles(df: DataFrame, side: int = TILE) -> DataFrame:
    """One row for each tile (``tx, ty``) that a disc may touch: a circle about the tile meets the disc."""
    first = df.withColumn("tx", F.explode(F.sequence(F.floor(F.col("minx") / side).cast("int"), F.floor((F.col("maxx") - 1) / side).cast("int"))))
    both = first.withColumn("ty", F.explode(F.sequence(F.floor(F.col("miny") / side).cast("int"), F.floor((F.col("maxy") - 1) / side).cast("int"))))
    dx, dy = F.col("x") - (F.col("tx") + 0.5) * side, F.col("y") - (F.col("ty") + 0.5) * side
    reach = F.lit(side * 0.5**0.5) + RFAC * F.col("r")
    return both.filter(dx * dx + dy * dy < reach * reach)


def tile_counts(df: DataFrame, side: int = TILE) -> DataFrame:
    """Discs of every tile, and of all tiles up to it."""
    counts = tiles(df, side).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as the image has tiles
    return counts.withColumn("up_to", F.sum("n").over(Window.orderBy("tx", "ty").rowsBetween(Window.unboundedPreceding, 0)))


def covered(df: DataFrame, keep: list[str]) -> DataFrame:
    """``px, py, att`` and ``keep`` of every pixel that a disc covers; ``att`` is the kernel at the pixel."""
    reach = RFAC * F.col("r")
    stp = F.lit(-1.0) / (F.lit(H2SIGMA * H2SIGMA) * F.col("r") * F.col("r"))
    cols = df.select("x", "y", "r", "miny", "maxy", *keep, stp.alias("stp"), F.explode(F.sequence("minx", F.col("maxx") - 1)).alias("px"))
    dx = F.col("px") - F.col("x")
    cols = cols.withColumn("d2", reach * reach - dx * dx).filter("d2 > 0").withColumn("dy", F.sqrt("d2")).withColumn("pre", F.exp(F.col("stp") * dx * dx))
    low, high = F.greatest("miny", (F.col("y") - F.col("dy") + 1).cast("int")), F.least("maxy", (F.col("y") + F.col("dy") + 1).cast("int"))
    cols = cols.withColumns({"low": low, "high": high}).filter("low < high")
    rows = cols.select(*keep, "px", "y", "pre", "stp", F.explode(F.sequence("low", F.col("high") - 1)).alias("py"))
    dy = F.col("py") - F.col("y")
    return rows.select("px", "py", (F.col("pre") * F.exp(F.col("stp") * dy * dy)).alias("att"), *keep)


def additive(df: DataFrame, split_wide: bool = False) -> DataFrame:
    """Optical depth of every pixel, where absorption equals emission."""
    if split_wide:
        wide = tiles(df.filter(F.col("maxx") - F.col("minx") > TILE)).repartition("tx", "ty")
        ends = {"minx": F.greatest("minx", F.col("tx") * TILE), "maxx": F.least("maxx", (F.col("tx") + 1) * TILE), "miny": F.greatest("miny", F.col("ty") * TILE), "maxy": F.least("maxy", (F.col("ty") + 1) * TILE)}
        wide = wide.withColumns(ends).drop("tx", "ty")
        df = df.filter(F.col("maxx") - F.col("minx") <= TILE).unionByName(wide)
    rows = covered(df, ["red", "green", "blue"])
    return rows.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(*[F.sum(F.col("att") * F.col(c)).alias(c) for c in ("red", "green", "blue")])


def absorbing(df: DataFrame, gray: float = 0.2, nearest_first: list[Column] | None = None, per_layer: int = 50_000) -> DataFrame:
    """Colours of every pixel, discs drawn one over the other, the farthest first.

    Discs are dealt out by depth, in layers of about ``per_layer``; a layer becomes an image in one task, without its pixels
    ever travelling, and the images of all layers are put together. So a pixel that holds many discs is many tasks.
    """
    order = nearest_first or [F.desc("z"), F.desc("pid")]
    discs = cut(df, "discs")
    layers = parts(df.sparkSession, discs.count(), per_layer)
    # a range's number is its place in the order
    dealt = discs.repartitionByRange(layers, *order).withColumn("layer", F.spark_partition_id())
    return composited(layer_images(dealt, gray, order, layers)).select("x", "y", *COLOURS)


def layer_images(df: DataFrame, gray: float = 0.2, nearest_first: list[Column] | None = None, layers: int | None = None) -> DataFrame:
    """An image of every ``layer``, with its optical depths ``t_red, t_green, t_blue``.

    Drawing a disc is ``p -> p T + q (1 - T)`` with ``T = exp(-e att)`` and ``q = e / (e + gray)``, so a disc counts by what
    is drawn after it. Running sums go from near to far: a frame that only grows is summed once. Discs of a layer are in one
    partition before they are exploded, so sums over its pixels need no exchange.
    """
    order = nearest_first or [F.desc("z"), F.desc("pid")]
    together = df.repartition(layers, "layer") if layers else df.repartition("layer")
    rows = covered(together, ["z", "pid", "red", "green", "blue", "layer"])
    front = Window.partitionBy("layer", "px", "py").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tau = {c: F.col(c) * F.col("att") for c in COLOURS}
    rows = rows.select("layer", "px", "py", "z", "pid", *[t.alias(f"t_{c}") for c, t in tau.items()], *[(F.col(c) / (F.col(c) + gray)).alias(f"q_{c}") for c in tau])
    rows = rows.select("layer", "px", "py", *[f"t_{c}" for c in tau], *[f"q_{c}" for c in tau], *[F.coalesce(F.sum(f"t_{c}").over(front), F.lit(0.0)).alias(f"f_{c}") for c in tau])
    add = lambda c: F.sum(-F.col(f"q_{c}") * F.expm1(-F.col(f"t_{c}")) * F.exp(-F.col(f"f_{c}"))).alias(c)
    images = rows.groupBy("layer", "px", "py").agg(*map(add, tau), *[F.sum(f"t_{c}").alias(f"t_{c}") for c in tau])
    return images.withColumnsRenamed({"px": "x", "py": "y"})


def composited(layers: DataFrame, layer: str = "layer") -> DataFrame:
    """One image of layers, 0 the nearest: what lies behind is dimmed by the optical depths before it, which add up."""
    front = Window.partitionBy("x", "y").orderBy(layer).rowsBetween(Window.unboundedPreceding, -1)
    dim = layers.select("x", "y", *COLOURS, *[f"t_{c}" for c in COLOURS], *[F.coalesce(F.sum(f"t_{c}").over(front), F.lit(0.0)).alias(f"f_{c}") for c in COLOURS])
    return dim.groupBy("x", "y").agg(*[F.sum(F.col(c) * F.exp(-F.col(f"f_{c}"))).alias(c) for c in COLOURS], *[F.sum(f"t_{c}").alias(f"t_{c}") for c in COLOURS])


def tone_mapped(image: DataFrame) -> DataFrame:
    return image.withColumns({c: -F.expm1(-F.col(c)) for c in COLOURS})


def adjusted(image: DataFrame, gamma: float = 1.0, contrast: float = 1.0, brightness: float = 0.0) -> DataFrame:
    if (gamma, contrast, brightness) == (1.0, 1.0, 0.0):
        return image
    return image.withColumns({c: contrast * F.pow(F.col(c), F.lit(gamma)) + brightness for c in COLOURS})


def quantised(image: DataFrame) -> DataFrame:
    return image.withColumns({c: F.greatest(F.lit(0), F.least(F.lit(255), F.greatest(F.lit(-1.0), F.least(F.lit(256.0), F.col(c) * 256)).cast("int"))) for c in COLOURS})


def runs(image: DataFrame, most: int = 128) -> DataFrame:
    """Run-length packets ``y, start, n, red, green, blue`` of a dense quantised image, at most ``most`` pixels long."""
    row = Window.partitionBy("y").orderBy("x")
    same = F.lit(True)
    for c in COLOURS:
        same = same & (F.col(c) == F.lag(c).over(row))
    island = F.sum(F.when(same & (F.col("x") == F.lag("x").over(row) + 1), 0).otherwise(1)).over(row.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(Window.partitionBy("y", "island").orderBy("x")) - 1
    marked = image.withColumn("island", island).withColumn("packet", F.floor(nth / most))
    return marked.groupBy("y", "island", "packet", *COLOURS).agg(F.min("x").alias("start"), F.count(F.lit(1)).alias("n")).select("y", "start", "n", *COLOURS)


def upsampled(coarse: DataFrame) -> DataFrame:
    """Twice the pixels along each axis: pixel ``x`` is the mean of coarse pixels ``x >> 1`` and ``(x + 1) >> 1``, so for ``y``."""
    steps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in ((-1, 0.5), (0, 1.0), (1, 0.5))])
    fine = coarse.withColumn("sx", F.explode(steps)).withColumn("sy", F.explode(steps))
    fine = fine.withColumn("w", F.col("sx.w") * F.col("sy.w"))
    fine = fine.select((2 * F.col("x") + F.col("sx.o")).alias("x"), (2 * F.col("y") + F.col("sy.o")).alias("y"), *[(F.col(c) * F.col("w")).alias(c) for c in COLOURS])
    return fine.filter("x >= 0 AND y >= 0").groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in COLOURS])
