"""Numeric Column expressions: finiteness, the normal distribution, improvement scores, scaling."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal distribution function (West, 2005).
CDF_TOP = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
CDF_BOTTOM = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
CDF_SPLIT = 7.07106781186547
CDF_TAIL = (0.65, 4.0, 3.0, 2.0, 1.0)
CDF_TAIL_SCALE = 2.506628274631


def col(c: Column | str | float | int) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def finite(c: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    c = col(c)
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def nan_to_null(c: Column | str) -> Column:
    c = col(c)
    return F.when(~F.isnan(c), c)


def norm_pdf(z: Column | str) -> Column:
    z = col(z)
    return F.exp(-z * z / 2.0) / math.sqrt(2 * math.pi)


def _horner(x: Column, coefs) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefs[1:], F.lit(coefs[0]))


def norm_cdf(z: Column | str) -> Column:
    """Standard normal distribution function to about 2e-16."""
    z = col(z)
    x = F.abs(z)
    body = F.exp(-x * x / 2.0)
    near = body * _horner(x, CDF_TOP) / _horner(x, CDF_BOTTOM)
    chain = x + F.lit(CDF_TAIL[0])
    for c in CDF_TAIL[1:]:
        chain = x + F.lit(c) / chain
    far = body / chain / CDF_TAIL_SCALE
    lower = F.when(x > 37.0, F.lit(0.0)).when(x < CDF_SPLIT, near).otherwise(far)
    return F.when(z > 0, 1.0 - lower).otherwise(lower)


def improvement(mu, sigma, best, xi=0.0) -> Column:
    """Expected improvement for a positive ``sigma``."""
    u = col(mu) - col(best) - col(xi)
    z = u / col(sigma)
    return col(sigma) * norm_pdf(z) + u * norm_cdf(z)


def expected_improvement(mu, var, best, xi=0.1, jitter=1e-9) -> Column:
    """Batch form: sigma is the root of the clipped variance plus a jitter."""
    return improvement(mu, F.sqrt(F.greatest(col(var), F.lit(0.0))) + jitter, best, xi)


def expected_improvement_or_zero(mu, sigma, best, xi=0.0) -> Column:
    """Variant that is 0 where the prediction is certain."""
    return F.when(col(sigma) > 0, improvement(mu, sigma, best, xi)).otherwise(F.lit(0.0))


def prob_improvement(mu, sigma, best, xi=0.0) -> Column:
    return norm_cdf((col(mu) - col(best) - col(xi)) / F.greatest(col(sigma), F.lit(1e-9)))


def ucb(mu, sigma, kappa=2.576) -> Column:
    return col(mu) + col(kappa) * col(sigma)


def prob_exceed(mu, sigma, best) -> Column:
    """Probability that the outcome exceeds ``best``; a certain prediction gives 0 or 1."""
    return F.when(col(sigma) > 0, 1.0 - norm_cdf((col(best) - col(mu)) / col(sigma))).otherwise(
        (col(mu) > col(best)).cast("double")
    )


def exceedance_threshold(mu, sigma, best) -> Column:
    return (1.0 - norm_cdf((col(best) - col(mu)) / col(sigma))) * col(sigma)


def minmax_fixed(c, lo, hi) -> Column:
    return (col(c) - col(lo)) / (col(hi) - col(lo))


def minmax_inverse(c, lo, hi) -> Column:
    return col(lo) + col(c) * (col(hi) - col(lo))


def softcap_objective(v, cap, lam) -> Column:
    """The value, less a quadratic penalty above the cap."""
    over = F.greatest(col(v) - col(cap), F.lit(0.0))
    return col(v) - col(lam) * over * over


def is_close(a, b, rtol=1e-5, atol=1e-8) -> Column:
    return F.abs(col(a) - col(b)) <= F.lit(atol) + F.lit(rtol) * F.abs(col(b))
