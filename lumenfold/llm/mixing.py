"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies that each of its documents should get on average. The whole part
is given to all; what is left is a copy probability. Documents meet in pairs in an order that a hash fixes: mass (words)
moves from one to the other, in a direction drawn so that each keeps its expected copies, until one of the two
probabilities is 0 or 1. All pairs of a chunk meet at once, what is left of them pairs up again, and so on: a reduction
tree. Chunks of a source run apart from each other; each leaves one document with a fraction, and these meet in chunks
again, until a source has one left, which goes to the nearer integer. A source's taken words so differ from its target by
half of one document at most.

Defined results: null and empty texts have size 0 and take 0; the null source is a source of its own, last in the order;
repeated rows are documents of their own, and among equal rows (id, size, source) it doesn't matter which gets a copy; null
ids are ids like others; other columns are not looked at, whatever their names; very long texts are counted whole; an empty
table gives an empty table. Reruns agree whatever the partitions, as chunks and draws come from hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.plans.tables import cut, small

#: Documents of a chunk.
CHUNK = 8192

WORD = r"[^\x20\x09-\x0D]+"


def ranked(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with each row's place (from 0) in the order of ``key``, nulls last, without a single task that sorts all."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(key).asc_nulls_last()
    placed = cut(df.repartitionByRange(n, order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return placed.withColumn("_in", inside).join(F.broadcast(counts), "_part").withColumn(name, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def targets(sizes: DataFrame, *, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), limit: float = 3.0) -> DataFrame:
    """``source, source_size, documents, target`` from ``source, size``: shares of all sizes by weight, up to ``limit`` times a source."""
    sizes = sizes if "times" in sizes.columns else sizes.withColumn("times", F.lit(1))
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("documents"))
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.col("nth") % len(cycle) + 1).cast("int"))
    per = cut(ranked(per, "source", "nth").withColumn("weight", weight).withColumn("most", limit * F.col("source_size")), "sources")
    # what one unit of weight gets: it grows with each source that is found to be full, and those stay full
    unit, full = None, -1
    while True:
        is_full = F.lit(False) if unit is None else F.col("most") < F.col("weight") * unit
        total, spent, weights, n = per.agg(
            F.sum("source_size"),
            F.coalesce(F.sum(F.when(is_full, F.col("most"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(is_full, 1)),
        ).first()
        if not total or not weights or n == full:
            break
        unit, full = (total - spent) / weights, n
    target = F.least(F.col("most"), F.col("weight") * (unit or 0.0))
    return per.select("source", "source_size", "documents", target.cast("double").alias("target"))


def _uniform(bits: np.ndarray, turn: int) -> np.ndarray:
    """Draws in 0..1 from 64 bits of a row and the number of a turn."""
    with np.errstate(over="ignore"):
        h = bits + np.uint64(turn + 1) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def settle(size: np.ndarray, part: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extra copies (0 or 1) and what is left of the fractions ``part``; at most one row keeps a fraction.

    Every turn pairs all open rows in their order: mass (words) moves until one of a pair is 0 or 1; the other goes on.
    """
    part, extra = part.copy(), np.zeros(len(part), "int64")
    open_, turn = np.flatnonzero((part > 0) & (part < 1)), 0
    extra[part >= 1] = 1
    while len(open_) > 1:
        i, j = open_[0 : len(open_) - 1 : 2], open_[1::2]
        a, b, p, q = size[i], size[j], part[i], part[j]
        up, down = np.minimum(a * (1 - p), b * q), np.minimum(a * p, b * (1 - q))
        # upwards with a chance of down / (up + down), so that neither expectation moves
        rise = _uniform(bits[j], turn) * (up + down) < down
        full, empty = a * (1 - p) <= b * q, a * p <= b * (1 - q)
        part[i] = np.where(rise, np.where(full, 1.0, p + up / a), np.where(empty, 0.0, p - down / a))
        part[j] = np.where(rise, np.where(full, q - up / b, 0.0), np.where(empty, q + down / b, 1.0))
        met = np.concatenate([i, j])
        whole = met[(part[met] <= 1e-12) | (part[met] >= 1 - 1e-12)]
        extra[whole] = np.rint(part[whole]).astype("int64")
        part[whole] = 0.0
        open_, turn = open_[part[open_] > 0], turn + 1
    part[extra == 1] = 0.0
    return extra, part


def _chunk(group: pd.DataFrame) -> pd.DataFrame:
    """A chunk's rows with whole copies, but for one at most; if the chunk is all that its source has, that one is rounded."""
    group = group.sort_values(["bits", "doc_id", "size", "nth"], kind="stable")
    extra, part = settle(group["size"].to_numpy("float64"), group["part"].to_numpy("float64"), group["bits"].to_numpy("int64").view("uint64"))
    if group["last"].iloc[0]:
        extra, part = extra + (part >= 0.5), np.zeros(len(part))
    return group[["doc_id", "nth", "source", "size"]].assign(copies=group["copies"].to_numpy() + extra, part=part)


def mix_sizes(sizes: DataFrame, *, seed: int = 7, chunk: int = CHUNK, **how) -> DataFrame:
    """``doc_id, source, size`` with ``source_size, target, copies, taken``; the table is read once."""
    # equal rows are one row with their number, and are told apart by ``nth``: no key gathers them anywhere
    number = sizes.count()
    sizes = cut(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times")), "sizes", rows=number)
    per = cut(targets(sizes, **how), "targets")
    sources = per.count()
    limit = how.get("limit", 3.0)

    def with_source(df: DataFrame, *columns: str) -> DataFrame:
        s = small(per.select(F.col("source").alias("_source"), *columns), sources)
        return df.join(s, df["source"].eqNullSafe(s["_source"]), "inner").drop("_source")

    nth = sizes.withColumn("_many", F.explode(F.expr(f"sequence(0L, (times - 1) div {chunk})")))
    nth = nth.withColumn("nth", F.explode(F.expr(f"sequence(_many * {chunk}, least(times, (_many + 1) * {chunk}) - 1)")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(limit)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    rows = with_source(nth, "source_size", "documents", "target").withColumn("_rate", rate)
    rows = rows.select("doc_id", "nth", "source", "size", F.floor("_rate").alias("copies"), (F.col("_rate") - F.floor("_rate")).alias("part"), "documents")
    nothing = (F.col("part") <= 0) | (F.col("size") == 0)
    done = [rows.filter(nothing).select("doc_id", "source", "size", "copies")]
    rest, level = rows.filter(~nothing), 0
    while True:
        chunks = F.ceil(F.col("documents") / chunk)
        named = [F.col("doc_id"), F.col("size"), F.col("nth")]
        keyed = rest.withColumn("chunk", F.pmod(F.xxhash64(F.lit(seed), F.lit(level), *named), chunks)).withColumn("bits", F.xxhash64(*named, F.lit(level), F.lit(seed)))
        keyed = keyed.withColumn("last", F.col("documents") <= chunk).withColumn("doc_id", F.col("doc_id").cast("string")).drop("documents")
        settled = cut(keyed.groupBy("source", "chunk").applyInPandas(_chunk, "doc_id string, nth long, source string, size long, copies long, part double").withColumn("doc_id", F.col("doc_id").cast("long")), f"level{level}", rows=number)
        done.append(settled.filter("part = 0").select("doc_id", "source", "size", "copies"))
        left = settled.filter("part > 0")
        counts = left.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
        number = left.count()
        if not number:
            break
        counts = small(counts.withColumnRenamed("source", "_source"), sources)
        rest = left.join(counts, left["source"].eqNullSafe(counts["_source"])).drop("_source")
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return with_source(out, "source_size", "target").select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def sized(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size`` in words."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words.alias("size"))


def mix(docs: DataFrame, *, seed: int = 7, **how) -> DataFrame:
    """The copies of every document; the texts are read once, to count their words."""
    return mix_sizes(sized(docs), seed=seed, **how)
