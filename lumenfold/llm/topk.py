"""Exact top-k by inner product: dual-tree search over cover trees.

A node of a cover tree is a point of its own at a level ``l``: all its rows lie within ``2 ** l`` of it (covering), its
children at the next level are itself (nesting) and others more than ``2 ** (l - 1)`` from it and each other (separation),
until each of its rows lies that near to a child. Levels at which a node would be its only child are left out. A node of
few rows, or one whose rows lie so far from each other that it would have more than ``FAN`` children, or half as many as rows,
holds its rows itself.

For a query node at ``q`` with radius ``r`` and a data node at ``d`` with radius ``s``, no inner product
exceeds ``q.d + r|d| + s|q| + rs``. Pairs of nodes are searched best bound first and dropped if that is below the worst k-th
score of the query node's queries.

The top of both trees is shared by all tasks: up to ``PIVOTS`` points of a bounded sample, spread by farthest-first traversal.
Every row, query or data, belongs to the cell of its nearest pivot, with a covering radius over all its rows, apart for
queries and data. Cells that are near each other share a block of data, or a share of queries, of up to ``ROWS`` rows; a
larger cell is dealt out by a hash over several, so a cell that holds a third of all vectors is many tasks. First each query
meets one block of its own cell; its k-th score there is a bound that goes with it, and pairs of cells below their group's
worst bound are never formed: data go only to the shares, and queries only to the blocks, of cells that are left. What a
task finds below a query's bound stays there.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; shorter vectors are padded with
zeros to the longest; a row is never its own candidate, nor is another row of the same id; repeated rows of other ids are
candidates each on its own, repeated queries of one id have one answer (that of the first vector in order); equal scores rank by the smaller id; fewer than k
candidates give fewer rows; other columns are not looked at, whatever their names; an empty table gives an empty table. Products are exact while they stay below 2^53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.plans.tables import cut

PIVOTS, SAMPLE, ROWS, LEAF, FAN, WIDTH = 256, 4096, 65_536, 32, 96, 1024


def _stack(blobs: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f8") for b in blobs]) if len(blobs) else np.zeros((0, 0))


def spread_points(x: np.ndarray, n: int, first: int = 0, radius: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of up to ``n`` rows by farthest-first traversal, until all lie within ``radius`` of one; each row's nearest of them, and how far."""
    chosen = [first]
    near, owner = np.linalg.norm(x - x[first], axis=1), np.zeros(len(x), np.int64)
    while len(chosen) < min(n, len(x)):
        far = int(near.argmax())
        if near[far] <= radius:
            break
        away = np.linalg.norm(x - x[far], axis=1)
        closer = away < near
        near, owner = np.where(closer, away, near), np.where(closer, len(chosen), owner)
        chosen.append(far)
    return np.array(chosen), owner, near


class Node:
    """A cover tree's node: the row ``centre``, its ``level``, all ``rows`` below it and the ``radius`` that they reach."""

    __slots__ = ("centre", "children", "level", "norm", "radius", "rows")

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: int, away: np.ndarray, leaf: int = LEAF) -> None:
        self.centre, self.rows, self.radius, self.children = centre, rows, float(away.max()), []
        self.norm = float(np.linalg.norm(x[centre]))
        self.level = math.ceil(math.log2(self.radius)) if self.radius > 0 else -math.inf
        if len(rows) <= leaf or self.radius == 0:
            return
        most = min(FAN, len(rows) // 2)
        own, cover = x[rows], 2.0 ** (self.level - 1)
        at, owner, near = spread_points(own, most, int(np.flatnonzero(rows == centre)[0]), cover)
        if near.max() > cover or len(at) < 2:
            return
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(len(at) + 1))
        for i, c in enumerate(at.tolist()):
            mine = order[edges[i] : edges[i + 1]]
            self.children.append(Node(x, rows[mine], int(rows[c]), near[mine], leaf))


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """The tree of all rows; its root is the row nearest to their mean."""
    centre = int(np.linalg.norm(x - x.mean(axis=0), axis=1).argmin())
    return Node(x, np.arange(len(x)), centre, np.linalg.norm(x - x[centre], axis=1), leaf)


def bounds(x: np.ndarray, a: Node, y: np.ndarray, nodes: list[Node]) -> np.ndarray:
    """No inner product of the rows of ``a`` with those of each node is above; with room for rounding."""
    norm, radius = np.array([b.norm for b in nodes]), np.array([b.radius for b in nodes])
    value = y[[b.centre for b in nodes]] @ x[a.centre] + a.radius * norm + radius * a.norm + a.radius * radius
    return value + 1e-9 * (np.abs(value) + (a.norm + a.radius) * (norm + radius)) + 1e-9


def dual_search(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's k best of ``d``, best first, ties by id; nothing below ``least`` need be found.

    Absent places have a score of -inf.
    """
    none = np.iinfo(np.int64).max
    top, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), none)
    if not len(q) or not len(d):
        return top, ids
    kth = least.copy()

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        """A block of the product: only scores that reach a query's k-th are looked at."""
        s = q[a] @ d[b].T
        floor = kth[a]
        if len(b) > k + 1 and np.isneginf(floor).any():  # k others and the row itself reach this
            floor = np.maximum(floor, np.partition(s, len(b) - k - 1, axis=1)[:, len(b) - k - 1])
        i, j = np.nonzero(s >= floor[:, None])
        other = q_ids[a[i]] != d_ids[b[j]]
        i, j = i[other], j[other]
        if not len(i):
            return
        rows, new = np.unique(i, return_inverse=True)
        row = np.concatenate([new, np.repeat(np.arange(len(rows)), k)])
        score, name = np.concatenate([s[i, j], top[a[rows]].ravel()]), np.concatenate([d_ids[b[j]], ids[a[rows]].ravel()])
        order = np.lexsort((name, -score, row))
        row, score, name = row[order], score[order], name[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(rows)))[row]
        best = place < k
        top[a[rows[row[best]]], place[best]] = score[best]
        ids[a[rows[row[best]]], place[best]] = name[best]
        kth[a[rows]] = np.maximum(kth[a[rows]], top[a[rows], -1])

    def search(a: Node, nodes: list[Node]) -> None:
        """All data ``nodes`` for the query node ``a``: they split together."""
        value = bounds(q, a, d, nodes)
        for n in np.argsort(-value, kind="stable"):
            b = nodes[n]
            if value[n] < kth[a.rows].min():
                break
            if not a.children and not b.children:
                for lo in range(0, len(a.rows), WIDTH):
                    for to in range(0, len(b.rows), WIDTH):
                        meet(a.rows[lo : lo + WIDTH], b.rows[to : to + WIDTH])
            elif a.children and (not b.children or a.radius >= b.radius):
                for child in a.children:
                    search(child, [b])
            else:
                search(a, b.children)

    search(cover_tree(q, leaf), [cover_tree(d, leaf)])
    return top, ids


def _dealt(sizes: dict[int, int], order: list[int], rows: int) -> dict[int, tuple[int, int]]:
    """For each cell the first of the parts that it is dealt to, and to how many: small cells share one, in ``order``."""
    out, part, held = {}, 0, 0
    for c in order:
        n = sizes.get(c, 0)
        if n > rows:
            part, held = part + (held > 0), 0
            out[c] = (part, math.ceil(n / rows))
            part += out[c][1]
            continue
        if held + n > rows:
            part, held = part + 1, 0
        out[c] = (part, 1)
        held += n
    return out


def _prepared(vectors: DataFrame, vec_id: str, embedding: str, scale: float, every: int) -> tuple[DataFrame, int]:
    """``vec_id, query, v``: whole-number components as bytes; rows that take no part are gone."""
    x = F.col("_x")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("_x")).filter(x.isNotNull() & F.col("vec_id").isNotNull() & ~odd)
    width = rows.agg(F.max(F.size("_x"))).first()[0] or 0
    rows = rows.select("vec_id", (F.pmod("vec_id", F.lit(every)) == 0).alias("query"), "_x")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            blobs = []
            for v in b["_x"]:
                out = np.zeros(width, "<f8")
                out[: len(v)] = np.floor(scale * np.asarray(v, "float64"))
                blobs.append(out.tobytes())
            yield pd.DataFrame({"vec_id": b["vec_id"], "query": b["query"], "v": blobs})

    return rows.mapInPandas(run, "vec_id long, query boolean, v binary"), width


def search(vectors: DataFrame, *, k: int = 20, every: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k highest scores of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows, _ = _prepared(vectors, vec_id, embedding, scale, every)
    rows = cut(rows, "vectors")
    sample = [bytes(r["v"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).select("v").collect()]
    n = rows.count()
    answer = "query_id long, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    x = _stack(sample)
    pivots = x[spread_points(x, max(1, min(PIVOTS, n // LEAF)))[0]]
    norms = (pivots**2).sum(axis=1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = _stack(b["v"].tolist())
            if not len(v):
                continue
            away = np.maximum((v**2).sum(axis=1)[:, None] - 2 * v @ pivots.T + norms, 0)
            cell = away.argmin(axis=1)
            far = np.linalg.norm(v - pivots[cell], axis=1)
            yield pd.DataFrame({"vec_id": b["vec_id"], "query": b["query"], "cell": cell.astype("int32"), "far": far, "v": b["v"]})

    placed = cut(rows.mapInPandas(assign, "vec_id long, query boolean, cell int, far double, v binary"), "cells")
    stats = placed.groupBy("cell").agg(  # at most PIVOTS rows
        F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.max(F.when(F.col("query"), F.col("far"))).alias("q_far"), F.count(F.when(F.col("query"), 1)).alias("q_n")
    )
    stats = {r["cell"]: r for r in stats.collect()}
    # cells in a chain, each followed by the nearest that is left
    chain, left = [], set(stats)
    while left:
        c = min(left, key=lambda c: (float(np.linalg.norm(pivots[c] - pivots[chain[-1]])) if chain else 0.0, c))
        chain.append(c)
        left.remove(c)
    each = min(ROWS, max(LEAF, math.ceil(n / int(spark.conf.get("spark.sql.shuffle.partitions")))))
    blocks = _dealt({c: r["n"] for c, r in stats.items()}, chain, each)
    shares = _dealt({c: r["q_n"] for c, r in stats.items()}, chain, ROWS)

    def part(of: dict[int, tuple[int, int]], *key: F.Column | str) -> F.Column:
        """The part that a row of ``cell`` is dealt to; at most PIVOTS entries."""
        at = lambda i: F.create_map(*[F.lit(x) for c, p in of.items() for x in (c, p[i])])[F.col("cell")]
        return (at(0) + F.pmod(F.xxhash64(*key), at(1))).cast("int")

    data = placed.select("cell", part(blocks, "vec_id", "v").alias("block"), "vec_id", "v")
    # rows of one id are one query, that of the first vector
    queries = placed.filter("query").groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("first")).select("vec_id", "first.v", "first.cell")

    def first_bound(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        q, ids = _stack(left["v"].tolist()), left["vec_id"].to_numpy("int64")
        top, _ = dual_search(q, ids, np.full(len(ids), -np.inf), _stack(right["v"].tolist()), right["vec_id"].to_numpy("int64"), k)
        return pd.DataFrame({"vec_id": ids, "cell": left["cell"].to_numpy("int32"), "least": top[:, -1] if len(ids) else np.zeros(0), "v": left["v"]})

    own = queries.withColumn("block", part(blocks, "vec_id")).groupBy("block").cogroup(data.groupBy("block"))
    bounded = cut(own.applyInPandas(first_bound, "vec_id long, cell int, least double, v binary"), "bounded")
    worst = {r["cell"]: r["least"] for r in bounded.groupBy("cell").agg(F.min("least").alias("least")).collect()}  # at most PIVOTS rows
    length = np.sqrt(norms)
    to_blocks: dict[int, set[tuple[int, int]]] = {}
    to_shares: dict[int, set[tuple[int, int]]] = {}
    for c, least in worst.items():
        r = stats[c]["q_far"]
        for d, s in stats.items():
            b = pivots[c] @ pivots[d] + r * length[d] + s["far"] * length[c] + r * s["far"]
            if b + 1e-6 * (1 + abs(b)) >= least:
                to_blocks.setdefault(c, set()).add(blocks[d])
                to_shares.setdefault(d, set()).add(shares[c])

    def sent(df: DataFrame, to: dict[int, set[tuple[int, int]]], name: str) -> DataFrame:
        """Rows with each part that their cell meets; at most PIVOTS squared entries in all, an array for each cell."""
        lists = spark.createDataFrame([(c, sorted(p)) for c, p in to.items()], "cell int, _to array<struct<at:int,n:int>>")
        far = df.join(F.broadcast(lists), "cell").withColumn("_p", F.explode("_to"))
        return far.withColumn(name, F.explode(F.expr("sequence(_p.at, _p.at + _p.n - 1)"))).drop("_to", "_p", "cell")

    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, "int64"), "vec_id": np.zeros(0, "int64"), "score": np.zeros(0, "int64")})
        q_ids, least = left["vec_id"].to_numpy("int64"), left["least"].to_numpy("float64")
        top, ids = dual_search(_stack(left["v"].tolist()), q_ids, least, _stack(right["v"].tolist()), right["vec_id"].to_numpy("int64"), k)
        kept = np.isfinite(top) & (top >= least[:, None])  # what is below the bound isn't among the k best
        at = np.nonzero(kept)[0]
        return pd.DataFrame({"query_id": q_ids[at], "vec_id": ids[kept], "score": top[kept].astype("int64")})

    asked = sent(bounded.withColumn("share", part(shares, "vec_id")), to_blocks, "block")
    met = asked.groupBy("share", "block").cogroup(sent(data, to_shares, "share").groupBy("share", "block")).applyInPandas(found, answer)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
