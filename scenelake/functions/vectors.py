"""Vectors as arrays; folds stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from the first element on."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot_literal(v: Column, query: Sequence[float]) -> Column:
    """Inner product with a fixed vector, unrolled so that it compiles to straight code."""
    out = F.lit(0.0)
    for k, q in enumerate(query):
        out = out + F.get(v, F.lit(k)).cast("double") * F.lit(float(q))
    return out


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column, eps: float = 1e-9) -> Column:
    """v / (|v| + eps); a null vector stays null."""
    d = doubles(v)
    n = norm(d) + F.lit(eps)
    return F.transform(d, lambda x: x / n)


def sigmoid(logit: Column, scale: float = 0.0, bias: float = 0.0) -> Column:
    """1 / (1 + exp(-(logit * exp(scale) + bias)))."""
    return 1 / (1 + F.exp(-(logit * F.exp(F.lit(float(scale))) + F.lit(float(bias)))))


def standardized(value: Column, window, on_zero: str = "center", eps: float = 1e-9) -> Column:
    """z-score over a window with the population's deviation; where it is at most eps, centred values or zeros."""
    if on_zero not in ("center", "zero"):
        raise ValueError("on_zero is center or zero")
    centred = value - F.avg(value).over(window)
    deviation = F.stddev_pop(value).over(window)
    flat = centred if on_zero == "center" else F.lit(0.0)
    return F.when(deviation > eps, centred / deviation).otherwise(flat)
