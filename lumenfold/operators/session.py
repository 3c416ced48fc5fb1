"""A session: a base table, an ordered list of unchangeable steps, and parameters; every render derives its plan anew."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATIONS = ("nop", "add", "sub", "mul", "div")


@dataclass(frozen=True)
class Clip:
    field: str
    low: float
    high: float


@dataclass(frozen=True)
class Combine:
    """``field <- field op other``; a division by zero gives null."""

    field: str
    op: str
    other: str


@dataclass(frozen=True)
class Rebind:
    """``slot <- column``."""

    slot: str
    column: str


@dataclass(frozen=True)
class Session:
    base: DataFrame
    steps: tuple[tuple[str, object], ...] = ()
    params: dict = field(default_factory=dict)

    def put(self, name: str, step: object) -> Session:
        """Add a step, or replace that of the same name at its place."""
        if any(n == name for n, _ in self.steps):
            return replace(self, steps=tuple((n, step if n == name else s) for n, s in self.steps))
        return replace(self, steps=(*self.steps, (name, step)))

    def drop(self, name: str) -> Session:
        return replace(self, steps=tuple((n, s) for n, s in self.steps if n != name))

    def set(self, **params) -> Session:
        unknown = set(params) - set(self.params)
        if unknown:
            raise KeyError(f"unknown parameters: {sorted(unknown)}")
        return replace(self, params={**self.params, **params})

    def frame(self) -> DataFrame:
        """The base after all steps, in their order."""
        df = self.base
        for _, s in self.steps:
            if isinstance(s, Clip):
                df = df.filter(F.col(s.field).between(s.low, s.high))
            elif isinstance(s, Combine):
                df = df.withColumn(s.field, combined(s))
            elif isinstance(s, Rebind):
                df = df.withColumn(s.slot, F.col(s.column).cast("double"))
            else:
                raise TypeError(f"not a step: {s}")
        return df

    def normalised(self, slot: str = "e") -> DataFrame:
        """The slot over its range, unclamped; always last."""
        df = self.frame()
        span = df.agg(F.min(slot).alias("_lo"), F.max(slot).alias("_hi"))
        scaled = F.try_divide(F.col(slot) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
        return df.crossJoin(F.broadcast(span)).withColumn(slot, scaled).drop("_lo", "_hi")

    def save(self, path: str) -> None:
        """What the steps keep, with all columns of the base."""
        self.frame().write.parquet(path)


def combined(c: Combine) -> F.Column:
    a, b = F.col(c.field), F.col(c.other)
    return {"nop": lambda: a, "add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: F.try_divide(a, b)}[c.op]()
