"""Connected components by alternating star contractions, as joins and sums of written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.plans.tables import cut, dropped


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to its least neighbour, or to the node itself."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them; ``u > v`` in ``edges``."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (its least node) of every node of ``links`` (``u, v`` of one type), but for least nodes.

    Null ends and links of a node with itself don't count; repeated links count once; no links give no rows. Raises if the
    contractions haven't settled after ``most_rounds`` (they take about the square of the logarithm of the nodes).
    """
    edges = cut(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state, before = _state(edges), None
    for _ in range(most_rounds):
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        new = cut(_small_star(_large_star(edges)), "stars", rows=state[0])
        dropped(edges)
        edges, before, state = new, state, _state(new)
    raise RuntimeError(f"components haven't settled after {most_rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
