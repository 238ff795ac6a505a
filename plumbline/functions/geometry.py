"""Point and plane geometry as Column expressions; all of it stays inside generated code.

A plane is four columns a, b, c, d with a*x + b*y + c*z + d = 0. Coordinates are metres, Z up.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = float | Column

VERTICAL_LIMIT = 0.25
HORIZONTAL_LIMIT = 0.85


def col(x: Number | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, with negative zero turned into zero: sums in another order then print alike."""
    return F.round(col(x), digits) + 0.0


def to_zup(x, y, z) -> tuple[Column, Column, Column]:
    return col(x), -col(z), col(y)


def to_yup(x, y, z) -> tuple[Column, Column, Column]:
    return col(x), col(z), -col(y)


def unit_plane(plane) -> list[float]:
    """a, b, c, d with a unit normal; a normal of no length is an error."""
    size = math.sqrt(sum(float(c) * float(c) for c in plane[:3]))
    if not size > 1e-12 or not math.isfinite(size):
        raise ValueError(f"the plane {list(plane)} has no normal")
    return [float(c) / size for c in plane]


def signed_distance(point: Sequence, plane: Sequence) -> Column:
    x, y, z = map(col, point)
    a, b, c, d = map(col, plane)
    return (a * x + b * y + c * z + d) / F.sqrt(a * a + b * b + c * c)


def distance(point: Sequence, plane: Sequence) -> Column:
    return F.abs(signed_distance(point, plane))


def plane_type(nz: Number) -> Column:
    """vertical_facade, horizontal or inclined, by how steep the unit normal stands."""
    steep = F.abs(col(nz))
    return F.when(steep <= VERTICAL_LIMIT, "vertical_facade").when(steep >= HORIZONTAL_LIMIT, "horizontal").otherwise("inclined")


def verticality(nz: Number) -> Column:
    """Degrees off vertical of a plane with this normal."""
    return F.degrees(F.asin(F.least(F.abs(col(nz)), F.lit(1.0))))


def horizontality(nz: Number) -> Column:
    return F.degrees(F.acos(F.least(F.abs(col(nz)), F.lit(1.0))))


def vertical_deviation(degrees: Number, height: float = 2.0) -> Column:
    """Metres that a wall leans over ``height``; infinite from 89.9 degrees on."""
    return F.when(col(degrees) >= 89.9, F.lit(math.inf)).otherwise(height * F.tan(F.radians(col(degrees))))


def dot(u: Sequence, v: Sequence) -> Column:
    out = None
    for p, q in zip(u, v, strict=True):
        out = col(p) * col(q) if out is None else out + col(p) * col(q)
    return out


def cross(u: Sequence, v: Sequence) -> tuple[Column, Column, Column]:
    (a, b, c), (x, y, z) = map(col, u), map(col, v)
    return b * z - c * y, c * x - a * z, a * y - b * x


def unit(v: Sequence) -> tuple[Column, ...]:
    n = F.sqrt(dot(v, v))
    return tuple(col(x) / n for x in v)


def plane_axes(normal: Sequence) -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    """Axes u and v in a plane. Steep planes (|nz| < 0.45): u level, v up. Others: u is the normal crossed with the z axis, or
    with the x axis where the normal lies close to z (|nz| >= 0.9); v completes the frame."""
    nx, ny, nz = map(col, normal)
    steep = F.abs(nz) < 0.45
    flat = F.sqrt(ny * ny + nx * nx)
    level = (F.when(flat < 1e-8, 1.0).otherwise(-ny / flat), F.when(flat < 1e-8, 0.0).otherwise(nx / flat), F.lit(0.0))
    along_z = F.abs(nz) < 0.9
    reference = (F.when(along_z, 0.0).otherwise(1.0), F.lit(0.0), F.when(along_z, 1.0).otherwise(0.0))
    lying = unit(cross(normal, reference))
    completed = cross(normal, lying)
    u = tuple(F.when(steep, p).otherwise(q) for p, q in zip(level, lying, strict=True))
    v = tuple(F.when(steep, p).otherwise(q) for p, q in zip((F.lit(0.0), F.lit(0.0), F.lit(1.0)), completed, strict=True))
    return u, v


def uv(point: Sequence, centre: Sequence, axes: tuple[Sequence, Sequence]) -> tuple[Column, Column]:
    """Coordinates in the plane, about ``centre``."""
    p = [col(x) - col(c) for x, c in zip(point, centre, strict=True)]
    return dot(p, axes[0]), dot(p, axes[1])


def foot(point: Sequence, plane: Sequence) -> tuple[Column, ...]:
    """The point of the plane nearest to ``point``; the plane's normal has unit length."""
    s = signed_distance(point, plane)
    return tuple(col(x) - s * col(n) for x, n in zip(point, plane[:3], strict=True))


def rigid(point: Sequence, m: Sequence[Sequence[float]]) -> tuple[Column, ...]:
    """A 4x4 rigid transform, row by row."""
    x, y, z = map(col, point)
    return tuple(F.lit(float(r[0])) * x + F.lit(float(r[1])) * y + F.lit(float(r[2])) * z + F.lit(float(r[3])) for r in m[:3])


def ray_plane(origin: Sequence, direction: Sequence, plane: Sequence) -> tuple[Column, ...]:
    """Where a ray meets a plane; null if it runs along the plane or meets it behind its origin."""
    slope = dot(direction, plane[:3])
    t = -F.try_divide(dot(origin, plane[:3]) + col(plane[3]), slope)
    hit = (F.abs(slope) >= 1e-9) & (t > 0)
    return tuple(F.when(hit, col(o) + t * col(d)) for o, d in zip(origin, direction, strict=True))


def project(point: Sequence, pose: dict) -> tuple[Column, Column, Column]:
    """Pixel coordinates and depth of a world point: pinhole with radial and tangential distortion (Brown, 1971).

    ``pose`` holds camera_matrix (3x3), rotation (3x3), translation (3) and distortion (up to five numbers).
    """
    xn, yn, z = seen_from(point, pose)
    return (*bent(xn, yn, pose), z)


def seen_from(point: Sequence, pose: dict) -> tuple[Column, Column, Column]:
    """Place of a world point on the plane at depth 1 before the camera, and its depth."""
    x, y, z = (dot(point, map(float, row)) + float(move) for row, move in zip(pose["rotation"], pose["translation"], strict=True))
    return F.try_divide(x, z), F.try_divide(y, z), z


def bent(xn: Column, yn: Column, pose: dict) -> tuple[Column, Column]:
    """Pixel of a place on the plane at depth 1."""
    k = pose["camera_matrix"]
    k1, k2, p1, p2, k3 = five(pose.get("distortion"))
    rr = xn * xn + yn * yn
    radial = 1 + rr * (k1 + rr * (k2 + rr * k3))
    xd = xn * radial + 2 * p1 * xn * yn + p2 * (rr + 2 * xn * xn)
    yd = yn * radial + p1 * (rr + 2 * yn * yn) + 2 * p2 * xn * yn
    return float(k[0][0]) * xd + float(k[0][2]), float(k[1][1]) * yd + float(k[1][2])


def five(distortion: Sequence[float] | None) -> list[float]:
    """Distortion coefficients, padded or cut to five."""
    return [*map(float, (distortion or [])), *[0.0] * 5][:5]


def inside_quadrilateral(u: Column, v: Column, corners: Sequence[Sequence[float]]) -> Column:
    """Even-odd rule over four corners."""
    if len(corners) != 4:
        raise ValueError("a quadrilateral has four corners")
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y0 == y1:
            continue  # a level edge is never crossed
        straddles = (F.lit(float(y0)) > v) != (F.lit(float(y1)) > v)
        at = (float(x1) - float(x0)) * (v - float(y0)) / (float(y1) - float(y0)) + float(x0)
        crossings = crossings + F.when(straddles & (u < at), 1).otherwise(0)
    return crossings % 2 == 1


def focal_length(width: float, height: float, degrees: float = 60.0) -> float:
    """Pixels, from the image size and the horizontal field of view (kept within 10 to 150 degrees)."""
    return width / (2 * math.tan(math.radians(min(150.0, max(10.0, degrees))) / 2))


def sane_focal(focal: Number | str, width: Number | str, height: Number | str, fallback: Number | str) -> Column:
    """A focal length of 0.15 to 10 times the longer image side, else the fallback."""
    f, side = col(focal), F.greatest(col(width), col(height))
    return F.when((f >= 0.15 * side) & (f <= 10.0 * side), f).otherwise(col(fallback))
