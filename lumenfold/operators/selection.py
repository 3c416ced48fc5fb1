"""Orders, exact selection and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.plans.tables import cut, small

#: Rows among which the last step of a selection sorts; until there are so few, each step narrows the range that holds the row.
LAST = 10_000

#: What particles can be sorted by. (column, descending)
ORDERS = {0: None, 1: ("z", False), 2: ("e", True), 3: ("e", False), 4: ("r", True)}


def ordered(df: DataFrame, kind: int, tie: str = "pid") -> DataFrame:
    """Particles in one of the five orders; ``tie`` decides between equals."""
    order = ORDERS[kind]
    if order is None:
        return df
    column, down = order
    return df.orderBy(F.desc(column) if down else F.asc(column), tie)


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """A written table in ranges of ``order``: ``_part`` numbers a row's range, ``_at`` its place (from 0) within it.

    No task sorts more than a range, and no key gathers a group's rows: ranges come from a sample of all of ``order``.
    """
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())  # range * 2^33 + place within it
    return cut(placed.select("*", F.shiftright("_id", 33).cast("int").alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_at")).drop("_id"), "ordered")


def numbered(df: DataFrame, order: list[Column], by: list[str] = (), name: str = "nth") -> DataFrame:
    """``df`` with each row's place (from 1) among the rows of its group ``by``, null a group like others, in ``order``."""
    placed = _dealt(df, [*map(F.asc, by), *order])
    counts = placed.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    counts = cut(counts, "range-counts")  # a row for each range, and for each group
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    return placed.join(small(starts, counts.count()), same).withColumn(name, F.col("_at") + F.col("_shift") + 1).select(*df.columns, name)


def previous(df: DataFrame, value: str, order: list[str], by: list[str] = (), name: str = "before") -> DataFrame:
    """``df`` with the ``value`` of the row before in its group ``by``, in ``order``; null for a group's first row.

    Within a range it is the row above; a range's first row looks at the last of the range before it.
    """
    placed = _dealt(df, [F.asc(c) for c in (*by, *order)])
    last = placed.groupBy("_part").agg(F.max(F.struct("_at", *by, value)).alias("_e"))
    last = cut(last, "range-ends")  # a row for each range
    inside = Window.partitionBy("_part").orderBy("_at")
    ends = last.select(F.lead("_part").over(Window.orderBy("_part")).alias("_p"), "_e")
    both = placed.withColumn("_own", F.lag(F.struct(*by, F.col(value).alias("_v"))).over(inside)).join(small(ends, last.count()), (F.col("_part") == F.col("_p")) & (F.col("_at") == 0), "left")
    over = F.when(F.col("_e").isNotNull(), F.struct(*[F.col(f"_e.{c}").alias(c) for c in by], F.col(f"_e.{value}").alias("_v")))
    both = both.withColumn("_b", F.coalesce("_own", over))
    same = F.col("_b").isNotNull()
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_b.{c}"))
    return both.withColumn(name, F.when(same, F.col("_b._v"))).select(*df.columns, name)


def ranked(df: DataFrame, kind: int, tie: str = "pid") -> DataFrame:
    """All particles with their place (``rank``, from 1) in one of the orders; as they come for order 0."""
    order = ORDERS[kind]
    if order is None:
        return df.withColumn("rank", F.lit(None).cast("long"))
    column, down = order
    return numbered(df, [F.desc(column) if down else F.asc(column), F.asc(tie)], name="rank")


def medians(df: DataFrame, field: str, by: list[str]) -> DataFrame:
    """``by`` and the ``median`` of a field, exactly: the mean of the middle two. Nulls don't count."""
    known = df.select(*by, field).filter(F.col(field).isNotNull())
    places = numbered(known, [F.asc(field)], by)
    counts = known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], "_n")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{i}"))
    middle = places.join(counts, same).filter((2 * F.col("nth")).between(F.col("_n"), F.col("_n") + 2))
    return middle.groupBy(*by).agg(F.avg(field).alias("median"))


def nth_smallest(df: DataFrame, field: str, n: int):
    """The ``n``-th smallest value (from 0) of a column, exactly; nulls don't count. None if there are no more than ``n``.

    A quantile sketch brackets the value, counts tell its rank within the bracket, and the next step looks at the bracket
    alone. So a step is two small aggregates, and only ``LAST`` values at most are ever sorted.
    """
    values = df.select(F.col(field).alias("v")).filter("v IS NOT NULL")
    total = values.count()
    if not 0 <= n < total:
        return None
    while total > LAST:
        share, slack = (n + 0.5) / total, 1e-3
        low, high = values.agg(F.percentile_approx("v", [max(0.0, share - slack), min(1.0, share + slack)], 10_000)).first()[0]
        below, within = values.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v").between(low, high))).first()
        if not below <= n < below + within:  # the sketch missed: look on the side that holds the row
            values, total, n = (values.filter(F.col("v") < low), below, n) if n < below else (values.filter(F.col("v") > high), total - below - within, n - below - within)
        elif low == high:
            return low
        elif within == total:
            mid = values.agg(F.min("v"), F.max("v"), F.count_if(F.col("v") == low), F.count_if(F.col("v") > low)).first()
            if n < mid[2]:
                return low
            values, total, n = values.filter(F.col("v") > low), mid[3], n - mid[2]
        else:
            values, total, n = values.filter(F.col("v").between(low, high)), within, n - below
    return values.orderBy("v").offset(n).limit(1).first()[0]


def parted(df: DataFrame, field: str, pivot) -> tuple[DataFrame, DataFrame]:
    """Rows below a pivot, and the others (nulls among them)."""
    low = F.coalesce(F.col(field) < F.lit(pivot), F.lit(False))
    return df.filter(low), df.filter(~low)


def halves(df: DataFrame, axes: tuple[str, ...] = ("x", "y", "z")) -> tuple[str, object, DataFrame, DataFrame]:
    """The longest axis of the rows' box, its median (the upper of two), and the rows on either side."""
    r = df.agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in axes]).first()
    axis = max(axes, key=lambda c: r[c] if r[c] is not None else -1.0)
    pivot = nth_smallest(df, axis, r["n"] // 2)
    return axis, pivot, *parted(df, axis, pivot)


def share_start(part: Column, total: int, parts: int) -> Column:
    """Where a share of ``total`` items starts, if the first shares take one more where they can't be equal."""
    base, more = divmod(total, parts)
    return (part * base + F.least(part, F.lit(more))).cast("long")


def share_of(row: Column, total: int, parts: int) -> Column:
    """The share that the item ``row`` (from 0) falls into."""
    base, more = divmod(total, parts)
    edge = more * (base + 1)
    return F.when(row < edge, F.floor(row / (base + 1))).otherwise(F.floor((row - edge) / max(base, 1)) + more).cast("int")
