"""Oriented boxes of groups of points, from sums that are added before rows move."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below this share of the largest variance, a direction counts as flat.
FLAT = 1e-12


def _det(m: Sequence[Sequence[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def _cross(u: Sequence[Column], v: Sequence[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def with_axes(moments: DataFrame) -> DataFrame:
    """Adds axes to rows of a covariance matrix (xx, xy, xz, yy, yz, zz): directions in descending order of variance, right-handed; null where they are not unique.

    Eigenvalues in closed form: q plus 2 p times cosines of thirds of an angle.
    Two independent rows of the matrix less an eigenvalue span all but its
    direction, so their cross product is it; the longest of three is taken.
    Each step is a column, as one expression of all would have millions of nodes.
    """
    m = [[F.col("".join(sorted(a + b))) for b in "xyz"] for a in "xyz"]
    less = lambda value: [[x - value if i == j else x for j, x in enumerate(row)] for i, row in enumerate(m)]
    step = moments.withColumn("_q", (m[0][0] + m[1][1] + m[2][2]) / 3)
    square = sum((x * x for row in less(F.col("_q")) for x in row), F.lit(0.0))
    step = step.withColumn("_p", F.sqrt(square / 6))
    step = step.withColumn("_d", F.try_divide(_det(less(F.col("_q"))), 2 * F.col("_p") * F.col("_p") * F.col("_p")))
    step = step.withColumn("_a", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_d")))) / 3)
    step = step.withColumn("_high", F.col("_q") + 2 * F.col("_p") * F.cos("_a")).withColumn("_low", F.col("_q") + 2 * F.col("_p") * F.cos(F.col("_a") + 2.0943951023931953))  # a third of a turn
    for name in ("_high", "_low"):
        rows = less(F.col(name))
        crosses = F.array(*(F.array(*_cross(rows[i], rows[j])) for i, j in ((0, 1), (0, 2), (1, 2))))
        sized = lambda v: F.struct((v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("size"), v.alias("v"))
        step = step.withColumn(name + "c", crosses)
        step = step.withColumn(name + "b", F.array_max(F.transform(name + "c", sized)))
        size, v = F.col(name + "b")["size"], F.col(name + "b")["v"]
        unit = F.array(*(v[k] / F.sqrt(size) for k in range(3)))
        step = step.withColumn(name + "v", F.when(size > FLAT * F.pow("_high", F.lit(4.0)), unit))
    first, last = F.col("_highv"), F.col("_lowv")
    second = F.array(*_cross([last[k] for k in range(3)], [first[k] for k in range(3)]))
    step = step.withColumn("axes", F.when(first.isNotNull() & last.isNotNull(), F.array(first, second, last)))
    return step.drop(*(c for c in step.columns if c.startswith("_") and c not in moments.columns))


def oriented_boxes(points: DataFrame, by: Sequence[str], least: int = 4) -> DataFrame:
    """Per group: n, center, extent (full lengths), axes (three unit vectors, x-y-z parts) and oriented.

    Directions are those of the points' covariance. Groups of fewer than `least`
    points, or whose directions are not unique (single points, lines, balls,
    squares seen as such), get the axis-aligned box with oriented = false.
    Points with a null coordinate don't count; a group of only these gives no
    row. Repeated points count as often as they stand.

    Sums of squares are about the group's own mean, which is found first: far
    from the origin, they would lose their digits. Three aggregations, each
    partial before rows move; groups meet their few numbers in joins whose
    skewed sides are split at run time. No group is collected.
    """
    by = list(by)
    own = points.select(*by, *(F.col(c).cast("double").alias(c) for c in "xyz")).filter("x is not null and y is not null and z is not null")
    key = [F.col(c).alias(f"_{c}") for c in by]
    same = lambda other: [F.col(c).eqNullSafe(other[f"_{c}"]) for c in by]
    mean = own.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in "xyz")).select(*key, "n", "mx", "my", "mz")
    joined = own.join(mean, same(mean))
    rel = joined.select(*by, "n", *(F.col(f"m{c}") for c in "xyz"), *((F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"))
    pairs = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    moments = rel.groupBy(*by).agg(*(F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in pairs), F.first("n").alias("n"))
    moments = with_axes(moments)
    chosen = F.when(F.col("n") >= least, F.col("axes"))
    upright = F.array(*(F.array(*(F.lit(float(i == j)) for j in range(3))) for i in range(3)))
    turned = moments.select(*key, chosen.isNotNull().alias("oriented"), F.coalesce(chosen, upright).alias("axes"))
    along = lambda k: sum((F.col(c) * F.col("axes")[k][i] for i, c in list(enumerate("xyz"))[1:]), F.col("x") * F.col("axes")[k][0])
    seen = rel.join(turned, same(turned)).select(*by, "n", "mx", "my", "mz", "axes", "oriented", *(along(k).alias(f"d{k}") for k in range(3)))
    ends = seen.groupBy(*by).agg(*(F.first(c).alias(c) for c in ("n", "mx", "my", "mz", "axes", "oriented")), *(f(f"d{k}").alias(f"{name}{k}") for k in range(3) for name, f in (("low", F.min), ("high", F.max))))
    middle = [(F.col(f"low{k}") + F.col(f"high{k}")) / 2 for k in range(3)]
    center = F.array(*(F.col(f"m{c}") + sum((middle[k] * F.col("axes")[k][i] for k in (1, 2)), middle[0] * F.col("axes")[0][i]) for i, c in enumerate("xyz")))
    return ends.select(*by, "n", center.alias("center"), F.array(*(F.col(f"high{k}") - F.col(f"low{k}") for k in range(3))).alias("extent"), "axes", "oriented")
