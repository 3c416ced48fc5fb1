"""Whole numbers on their way through pandas, where a column of whole numbers and nulls would become one of floats.

They travel as text and are whole numbers of their own kind again afterwards, exact to the last digit, nulls included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WHOLE = ("tinyint", "smallint", "int", "bigint")


def as_text(df: DataFrame) -> DataFrame:
    """``df`` with its whole numbers as text."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if t in _WHOLE else F.col(f"`{c}`") for c, t in df.dtypes])


def kinds(df: DataFrame) -> str:
    """The schema of :func:`as_text`, as a string."""
    return ", ".join(f"`{c}` {'string' if t in _WHOLE else t}" for c, t in df.dtypes)


def restored(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` with the columns that are whole numbers in ``like`` as these again."""
    own = dict(like.dtypes)
    return df.select(*[F.col(f"`{c}`").cast(own[c]).alias(c) if own.get(c) in _WHOLE else F.col(f"`{c}`") for c in df.columns])
