"""Vectors and strings as columns. A vector is a tuple of three columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def normal(a: Vector) -> Vector:
    """Of length 1; null for the zero vector."""
    n = length(a)
    return tuple(F.try_divide(c, n) for c in a)


def angle(a: Vector, b: Vector) -> Column:
    """Radians between two vectors, also near 0 and pi, where a cosine's inverse loses digits."""
    return F.atan2(length(cross(a, b)), dot(a, b))


def orientation(place: Vector, direction: Vector) -> Column:
    """Angle of a direction at a place on the sphere against the way to the north."""
    x, y, z = place
    east = (-y, x, F.lit(0.0))
    free = F.atan2(-dot(direction, east), dot(direction, cross(place, east)))
    pole = F.atan2(direction[1], F.when(z > 0, -direction[0]).otherwise(direction[0]))
    return F.when((x == 0) & (y == 0), pole).otherwise(free)


def cosine_between(z1: Column, phi1: Column, z2: Column, phi2: Column) -> Column:
    """Cosine of the angle between two points on the sphere, each the cosine of its colatitude and its longitude."""
    return z1 * z2 + F.cos(phi1 - phi2) * F.sqrt((1 - z1 * z1) * (1 - z2 * z2))


def on_sphere(z: Column, phi: Column) -> Vector:
    """The point of a cosine of colatitude and a longitude."""
    s = F.sqrt((1 - z) * (1 + z))
    return s * F.cos(phi), s * F.sin(phi), z


def trimmed(s: Column) -> Column:
    """Without blanks, tabs and line ends at both sides."""
    return F.regexp_replace(s, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def equal_nocase(a: Column, b: Column) -> Column:
    return F.lower(trimmed(a)) == F.lower(trimmed(b))


def tokens(s: Column, delimiter: str) -> Column:
    """The non-empty parts between a delimiter."""
    return F.filter(F.split(s, "\\Q" + delimiter + "\\E"), lambda x: x != "")


def words(s: Column) -> Column:
    return F.filter(F.split(s, r"\s+"), lambda x: x != "")


def zero_padded(v: Column, width: int) -> Column:
    """A number in at least ``width`` digits; longer numbers stay whole."""
    s = v.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))
