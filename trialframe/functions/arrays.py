"""Vector arithmetic on array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(c: Column, term, start: float = 0.0) -> Column:
    return F.aggregate(c, F.lit(start), lambda acc, v: acc + term(v))


def dot(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: x * y), lambda v: v)


def weighted_sq_distance(a: Column, b: Column, w: Column | None = None) -> Column:
    if w is None:
        return fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lambda v: v)
    return fold(F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), w, lambda d, k: d * k), lambda v: v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(weighted_sq_distance(a, b))


def objective(name: str, x: Column, maximise: bool = True) -> Column:
    """Benchmark functions of a point; the maximised form is the negative."""
    n = F.size(x)
    if name == "sphere":
        value = fold(x, lambda v: v * v)
    elif name == "ackley":
        a, b, c = 20.0, 0.2, 2 * math.pi
        value = (
            -F.lit(a) * F.exp(-F.lit(b) * F.sqrt(fold(x, lambda v: v * v) / n))
            - F.exp(fold(x, lambda v: F.cos(c * v)) / n) + a + math.e
        )
    elif name == "rastrigin":
        value = 10.0 * n + fold(x, lambda v: v * v - 10.0 * F.cos(2 * math.pi * v))
    elif name == "griewank":
        waves = F.transform(x, lambda v, i: F.cos(v / F.sqrt(i + 1.0)))
        value = fold(x, lambda v: v * v) / 4000.0 - F.aggregate(waves, F.lit(1.0), lambda acc, v: acc * v) + 1.0
    elif name == "zakharov":
        tilt = fold(F.transform(x, lambda v, i: 0.5 * (i + 1.0) * v), lambda v: v)
        value = fold(x, lambda v: v * v) + tilt * tilt + tilt * tilt * tilt * tilt
    else:
        raise ValueError(f"unknown objective {name!r}")
    return -value if maximise else value
