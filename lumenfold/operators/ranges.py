"""Ranges and normalisation of fields by type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scalar import asinh, log10_or, norm_and_clamp
from lumenfold.plans.tables import cut, small


def known(c: str) -> F.Column:
    """NaN takes no part in ranges."""
    return F.nanvl(F.col(c), F.lit(None).cast("double"))


def by_type(df: DataFrame, fields: list[str] = ("i", "e", "r"), positive: list[str] = ()) -> DataFrame:
    """Least and greatest of each field for every type; fields in ``positive`` count only where above 0."""
    value = lambda c: F.when(F.col(c) > 0, known(c)) if c in positive else known(c)
    return df.groupBy("type").agg(*[f(value(c)).alias(f"{c}_{n}") for c in fields for n, f in (("min", F.min), ("max", F.max))])


def overall(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.agg(*[f(known(c)).alias(f"{c}_{n}") for c in fields for n, f in (("min", F.min), ("max", F.max))])


def bounding_box(df: DataFrame) -> DataFrame:
    return overall(df, ["x", "y", "z"])


def radius_histogram(df: DataFrame, rth: float) -> DataFrame:
    """Counts of radii; classes from 1 on overlap, as each counts all below its bound."""
    r = F.col("r")
    below = [F.count_if((r >= 1) & (r < k * rth)).alias(f"below_{k}") for k in (1, 2, 4, 8)]
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(r < 1).alias("small"), *below, F.count_if(r >= 8 * rth).alias("large"))


def transformed(df: DataFrame, *, log: list[str] = (), arsinh: list[str] = ()) -> DataFrame:
    """Logarithm, or else the inverse hyperbolic sine, of fields."""
    return df.withColumns({c: log10_or(F.col(c)) for c in log} | {c: asinh(F.col(c)) for c in arsinh if c not in log})


def normalised(df: DataFrame, fields: list[str] = ("i", "e"), *, log: list[str] = (), arsinh: list[str] = (), limits: dict[str, tuple[float | None, float | None]] | None = None, of: DataFrame | None = None) -> DataFrame:
    """Fields over their type's range, clamped to 0..1; ``limits`` replace a range's ends; null is a type like others.

    Ranges are one row a type, summed up in the map tasks and written; they are broadcast if they are few. ``of`` has the
    same rows as ``df`` where these are dealt anew, so that only one of the two readings is.
    """
    limits = limits or {}
    ranged = transformed(of or df, log=log, arsinh=arsinh)
    # what has no logarithm takes no part in a range
    ranged = ranged.withColumns({c: F.when(F.col(c) > -38.0, F.col(c)) for c in log}) if log else ranged
    spans = cut(by_type(ranged, list(fields)).withColumnRenamed("type", "_type"), "spans", rows=1)
    after = transformed(df, log=log, arsinh=arsinh)
    joined = after.join(small(spans, spans.count()), F.col("type").eqNullSafe(F.col("_type"))).drop("_type")
    out = {}
    for c in fields:
        low, high = limits.get(c, (None, None))
        out[c] = norm_and_clamp(F.col(c), F.lit(low) if low is not None else F.col(f"{c}_min"), F.lit(high) if high is not None else F.col(f"{c}_max"))
    return joined.withColumns(out).drop(*[f"{c}_{n}" for c in fields for n in ("min", "max")])
