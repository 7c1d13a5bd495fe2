"""Boxes, poses, cameras and polygons as column expressions. Y is up; footprints lie in x and z."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Sequence[Column], Sequence[Column]]


def _product(values: Sequence[Column]) -> Column:
    out = F.lit(1.0)
    for v in values:
        out = out * v
    return out


def intersection(a: Box, b: Box) -> Column:
    """Volume that two axis-aligned boxes (low, high) share, 0 if apart."""
    return _product([F.greatest(F.least(p, q) - F.greatest(m, n), F.lit(0.0)) for m, p, n, q in zip(*a, *b, strict=True)])


def volume(a: Box) -> Column:
    return _product([h - m for m, h in zip(*a, strict=True)])


def iou(a: Box, b: Box, eps: float = 1e-8) -> Column:
    """Intersection over union plus eps."""
    shared = intersection(a, b)
    return shared / (volume(a) + volume(b) - shared + eps)


def iou_or_contained(a: Box, b: Box, padding: float = 0.0) -> Column:
    """The greater of intersection over union and over the smaller box; 0 without overlap or volume."""
    grow = lambda x: ([m - padding for m in x[0]], [h + padding for h in x[1]])
    a, b = grow(a), grow(b)
    shared, va, vb = intersection(a, b), volume(a), volume(b)
    return F.when((shared > 0) & (va > 0) & (vb > 0), F.greatest(shared / (va + vb - shared), shared / F.least(va, vb))).otherwise(0.0)


def corners(low: Sequence[Column], high: Sequence[Column]) -> Column:
    """The eight corners of a box, x slowest."""
    return F.array(*(F.array(x, y, z) for x in (low[0], high[0]) for y in (low[1], high[1]) for z in (low[2], high[2])))


def corner_bounds(points: Column) -> Box:
    """Low and high of an array of corners."""
    axis = lambda k: F.transform(points, lambda p: p[k])
    return [F.array_min(axis(k)) for k in range(3)], [F.array_max(axis(k)) for k in range(3)]


def corner_mean(points: Column) -> list[Column]:
    return [F.aggregate(points, F.lit(0.0), lambda s, p, k=k: s + p[k]) / F.size(points) for k in range(3)]


def transformed(pose: Column, xyz: Sequence[Column]) -> list[Column]:
    """A point through a row-major 4x4 matrix (16 numbers)."""
    return [pose[4 * r] * xyz[0] + pose[4 * r + 1] * xyz[1] + pose[4 * r + 2] * xyz[2] + pose[4 * r + 3] for r in range(3)]


def rigid_inverse(pose: Column) -> Column:
    """Inverse of a rotation and shift, row-major."""
    cell = lambda r, c: pose[4 * r + c]
    rows = []
    for r in range(3):
        rows += [cell(c, r) for c in range(3)] + [-(cell(0, r) * cell(0, 3) + cell(1, r) * cell(1, 3) + cell(2, r) * cell(2, 3))]
    return F.array(*rows, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def unprojected(u: Column, v: Column, depth: Column, k: Column) -> list[Column]:
    """Camera coordinates of a pixel with a depth under a row-major 3x3 matrix."""
    return [(u - k[2]) * depth / k[0], (v - k[5]) * depth / k[4], depth]


def projected(xyz: Sequence[Column], k: Column) -> tuple[Column, Column]:
    """Pixel of a point in camera coordinates, cut to integers."""
    return tuple(F.try_divide(xyz[i] * k[4 * i], xyz[2]) + k[3 * i + 2] for i in (0, 1))


def field_of_view_camera(height: Column, width: Column, degrees: float = 90.0) -> Column:
    """3x3 matrix of a camera with a horizontal field of view."""
    half = math.tan(math.radians(degrees) / 2)
    fx = width / (2 * half)
    fy = height / (2 * F.tan(F.atan(F.lit(half) * height / width)))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(fx, zero, width / 2, zero, fy, height / 2, zero, zero, one)


def matrix_of(text: Column) -> Column:
    """Numbers of a text with white space between."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.cast("double"))


def camera_of(numbers: Column) -> Column:
    """3x3 of a 3x3 or 4x4 matrix; other sizes are errors."""
    return (
        F.when(F.size(numbers) == 9, numbers)
        .when(F.size(numbers) == 16, F.array(*(numbers[4 * r + c] for r in range(3) for c in range(3))))
        .otherwise(F.raise_error(F.concat(F.lit("intrinsics have "), F.size(numbers).cast("string"), F.lit(" numbers"))).cast("array<double>"))
    )


def flipped_camera(pose: Column) -> Column:
    """The pose times diag(1, -1, -1, 1)."""
    return F.array(*(pose[4 * r + c] * (-1.0 if c in (1, 2) else 1.0) for r in range(4) for c in range(4)))


def mirrored_z(pose: Column) -> Column:
    """S * pose * S with S = diag(1, 1, -1, 1)."""
    return F.array(*(pose[4 * r + c] * (-1.0 if (r == 2) != (c == 2) else 1.0) for r in range(4) for c in range(4)))


def quaternion(pose: Column) -> Column:
    """x, y, z, w of a pose's rotation, by the largest of trace and diagonal."""
    m = lambda r, c: pose[4 * r + c]
    t = m(0, 0) + m(1, 1) + m(2, 2)
    root = lambda x: 2 * F.sqrt(F.greatest(x, F.lit(0.0)))
    s = root(t + 1)
    whole = F.array((m(2, 1) - m(1, 2)) / s, (m(0, 2) - m(2, 0)) / s, (m(1, 0) - m(0, 1)) / s, s / 4)
    a = root(1 + m(0, 0) - m(1, 1) - m(2, 2))
    x = F.array(a / 4, (m(0, 1) + m(1, 0)) / a, (m(0, 2) + m(2, 0)) / a, (m(2, 1) - m(1, 2)) / a)
    b = root(1 + m(1, 1) - m(0, 0) - m(2, 2))
    y = F.array((m(0, 1) + m(1, 0)) / b, b / 4, (m(1, 2) + m(2, 1)) / b, (m(0, 2) - m(2, 0)) / b)
    c = root(1 + m(2, 2) - m(0, 0) - m(1, 1))
    z = F.array((m(0, 2) + m(2, 0)) / c, (m(1, 2) + m(2, 1)) / c, c / 4, (m(1, 0) - m(0, 1)) / c)
    return F.when(t > 0, whole).when((m(0, 0) > m(1, 1)) & (m(0, 0) > m(2, 2)), x).when(m(1, 1) > m(2, 2), y).otherwise(z)


def in_polygon(x: Column, z: Column, polygon: Sequence[tuple[float, float]], radius: float = 0.0) -> Column:
    """Whether a point is in a polygon, or at most radius from its edges."""
    inside, near = F.lit(False), F.lit(False)
    for (ax, az), (bx, bz) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        if az != bz:
            crosses = ((F.lit(az) > z) != (F.lit(bz) > z)) & (x < (z - az) * ((bx - ax) / (bz - az)) + ax)
            inside = inside != crosses
        if radius > 0:
            length = (bx - ax) ** 2 + (bz - az) ** 2
            t = F.least(F.greatest(((x - ax) * (bx - ax) + (z - az) * (bz - az)) / (length or 1.0), F.lit(0.0)), F.lit(1.0))
            near = near | ((x - (ax + t * (bx - ax))) * (x - (ax + t * (bx - ax))) + (z - (az + t * (bz - az))) * (z - (az + t * (bz - az))) <= radius * radius)
    return inside | near if radius > 0 else inside


def in_polygon_column(x: Column, z: Column, polygon: Column) -> Column:
    """in_polygon for polygons that are rows: arrays of structs x, z."""
    n = F.size(polygon)
    edges = F.zip_with(polygon, F.concat(F.slice(polygon, 2, F.greatest(n - 1, F.lit(0))), F.slice(polygon, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crossed = F.filter(edges, lambda e: ((e.a.z > z) != (e.b.z > z)) & (x < F.try_divide((z - e.a.z) * (e.b.x - e.a.x), e.b.z - e.a.z) + e.a.x))
    return F.size(crossed) % 2 == 1


def cell(value: Column, size: float, origin: float | Column = 0.0) -> Column:
    return F.floor((value - origin) / size)
