"""Vectors, spherical coordinates and triangles as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]


def dot(a: Vector, b: Vector) -> Column:
    out = a[0] * b[0]
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out + x * y
    return out


def magnitude(a: Vector, root: bool = False) -> Column:
    """Squared length, or the length."""
    return F.sqrt(dot(a, a)) if root else dot(a, a)


def unit(a: Vector) -> list[Column]:
    """The vector over its length; null for one without length."""
    n = magnitude(a, root=True)
    return [F.try_divide(x, n) for x in a]


def minus(a: Vector, b: Vector) -> list[Column]:
    return [x - y for x, y in zip(a, b, strict=True)]


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def face_normal(a: Vector, b: Vector, c: Vector) -> list[Column]:
    return cross(minus(b, a), minus(c, a))


def edge_normals(a: Vector, b: Vector, c: Vector) -> list[list[Column]]:
    """For each edge, the edge cross the face's normal: in the face's plane, away from the face."""
    n = face_normal(a, b, c)
    return [cross(minus(q, p), n) for p, q in ((a, b), (b, c), (c, a))]


def area(a: Vector, b: Vector, c: Vector) -> Column:
    return magnitude(face_normal(a, b, c), root=True) / 2


class Projection(NamedTuple):
    """A way to write heights as a scanner sees them: told from height, distance and distance in the plane, and the height from what was told and the distance."""

    tell: Callable[[Column, Column, Column, float], Column]
    height: Callable[[Column, Column, float, float], Column]


#: Fixed formulas. stretch belongs to the distance, lift to the height; a cone's height is not the inverse of what it tells.
PROJECTIONS = {
    "cone": Projection(lambda h, _, flat, stretch: F.try_divide(h, flat * stretch), lambda told, d, lift, stretch: told * (d + stretch) + lift),
    "sphere": Projection(lambda h, d, _, stretch: F.asin(F.try_divide(h, d + stretch)), lambda told, d, lift, stretch: F.sin(told) * (d + stretch) - lift),
}


def _projection(mode: str) -> Projection:
    if found := PROJECTIONS.get(mode):
        return found
    raise ValueError(f"a projection is one of {', '.join(PROJECTIONS)}, not {mode!r}")


def spherical(x: Column, y: Column, z: Column, z_off: float = 0.0, d_off: float = 0.0, mode: str = "sphere") -> list[Column]:
    """The bearing atan2(x, y), what the projection tells of z + z_off, and the distance. A zero divisor gives null."""
    distance = magnitude((x, y, z), root=True)
    told = _projection(mode).tell(z + z_off, distance, magnitude((x, y), root=True), d_off)
    return [F.atan2(x, y), told, distance]


def cartesian(u: Column, v: Column, d: Column, z_off: float = 0.0, d_off: float = 0.0, mode: str = "sphere") -> list[Column]:
    """x, y and z from the bearing u, what was told (v), and the distance."""
    height = _projection(mode).height(v, d, z_off, d_off)
    in_plane = F.cos(v) * (d + z_off)
    return [F.sin(u) * in_plane, F.cos(u) * in_plane, height]


def finite(cols: Sequence[Column]) -> Column:
    """Whether all are numbers: not null, not NaN, not infinite."""
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def psnr(peak: Column, mse: Column) -> Column:
    """10 log10(peak / mse); the peak is squared already. No error gives infinity."""
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(10 * F.log10(peak / F.when(mse != 0, mse)))


def snr(noise: Column, mse: Column) -> Column:
    return F.when(mse > 0, 10 * F.log10(mse / noise)).otherwise(F.lit(float("-inf")))
