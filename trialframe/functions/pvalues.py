"""Tail probabilities Spark has no function for: as expressions, and in Arrow batches of result rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


STEPS = 200_000
_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz), NaN where it has not settled."""
    tiny = 1e-300
    whole = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    out, live = np.full(len(a), np.nan), np.arange(len(a))
    c, d = np.ones(len(a)), 1.0 / whole(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, STEPS):
        if not len(live):
            break
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / whole(1.0 + num * d)
            c = whole(1.0 + num / c)
            h = h * d * c
        done = np.abs(d * c - 1.0) < 1e-15
        if done.any():
            out[live[done]] = h[done]
            live, a, b, x, c, d, h = (v[~done] for v in (live, a, b, x, c, d, h))
    return out


def beta_cdfs(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of whole arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    out = np.where(x <= 0.0, 0.0, 1.0)
    out[~((a > 0) & (b > 0)) | np.isnan(x)] = np.nan
    at = np.flatnonzero((a > 0) & (b > 0) & (x > 0.0) & (x < 1.0))
    if len(at):
        a, b, x = a[at], b[at], x[at]
        front = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x))
        low = x < (a + 1.0) / (a + b + 2.0)
        first, second, part = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1.0 - x)
        tail = front * _beta_fraction(first, second, part) / first
        out[at] = np.where(low, tail, 1.0 - tail)
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    return float(beta_cdfs(np.array([a]), np.array([b]), np.array([x]))[0])


@F.pandas_udf(DoubleType())
def fair_coin_tail(correct: pd.Series, pairs: pd.Series) -> pd.Series:
    """P(X >= correct) for X ~ Binomial(pairs, 1/2)."""
    c, m = correct.to_numpy(dtype=float), pairs.to_numpy(dtype=float)
    known = ~(np.isnan(c) | np.isnan(m)) & (m > 0)
    out = np.where(known, 1.0, np.nan)
    some = known & (c > 0)
    out[some] = beta_cdfs(c[some], m[some] - c[some] + 1, np.full(some.sum(), 0.5))
    return pd.Series(out)


# fixed values: Lanczos' coefficients of the gamma function for g = 7
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for positive numbers from one half."""
    t = z + 6.5
    series = reduce(lambda acc, i: acc + LANCZOS[i] / (z + float(i - 1)), range(1, len(LANCZOS)), F.lit(LANCZOS[0]))
    return 0.5 * math.log(2 * math.pi) + (z - 0.5) * F.log(t) - t + F.log(series)


def beta_cdf_column(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for ``a`` and ``b`` from one half, as an expression; null for a null.

    The continued fraction is folded over as many terms as its known rate needs, of the order of the root of ``a + b``; it
    stops by itself where it has settled, and is NaN where it has not.
    """
    tiny = F.lit(1e-300)
    whole = lambda v: F.when(F.abs(v) > tiny, v).otherwise(tiny)

    def half(s: Column, num: Column) -> Column:
        pair = F.struct((1.0 / whole(1.0 + num * s["d"])).alias("d"), whole(1.0 + num / s["c"]).alias("c"))
        return _let(pair, lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (s["h"] * v["d"] * v["c"]).alias("h")))

    def fraction(p: Column, q: Column, t: Column) -> Column:
        d0 = 1.0 / whole(1.0 - (p + q) * t / (p + 1.0))

        def step(s: Column, i: Column) -> Column:
            m = i.cast("double")
            odd, even = m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))
            moved = _let(half(s, odd), lambda v: half(v, even))
            return F.when(F.abs(s["d"] * s["c"] - 1.0) < 1e-15, s).otherwise(moved)

        # not settled before the first step, whatever the numbers: c is far from 1 / d
        start = _let(d0, lambda d: F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h")))
        terms = F.sequence(F.lit(1), F.lit(60) + F.ceil(12.0 * F.sqrt(p + q)).cast("int"))
        return F.aggregate(terms, start, step, lambda s: F.when(F.abs(s["d"] * s["c"] - 1.0) < 1e-12, s["h"]).otherwise(F.lit(float("nan"))))

    def inside(v: Column) -> Column:
        front = F.exp(log_gamma(v["a"] + v["b"]) - log_gamma(v["a"]) - log_gamma(v["b"]) + v["a"] * F.log(v["x"]) + v["b"] * F.log1p(-v["x"]))
        tail = lambda p, q, t: front * fraction(p, q, t) / p
        low = v["x"] < (v["a"] + 1.0) / (v["a"] + v["b"] + 2.0)
        return F.when(low, tail(v["a"], v["b"], v["x"])).otherwise(1.0 - tail(v["b"], v["a"], 1.0 - v["x"]))

    known = F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), x.cast("double").alias("x"))
    missing = a.isNull() | b.isNull() | x.isNull()
    return F.when(missing, F.lit(None).cast("double")).when(F.isnan(x) | (a <= 0) | (b <= 0), F.lit(float("nan"))).when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(
        _let(known, inside))


def f_tail(f: str | Column, df1: Column, df2: Column) -> Column:
    """Upper tail of the F distribution with whole degrees of freedom; null where the ratio is, NaN without freedom."""
    f = F.col(f) if isinstance(f, str) else f
    spread = F.when((df1 > 0) & (df2 > 0), df2 / (df2 + df1 * f)).otherwise(F.when(f.isNotNull(), F.lit(float("nan"))))
    return beta_cdf_column(df2 / 2.0, df1 / 2.0, spread)
