"""Normal distribution functions as Column arithmetic.

Spark has no error function. erfc(z) for z >= 0 is t * exp(-z**2 + g(t)) with t = 2 / (2 + z); g is smooth on [0, 1]
and interpolated at Chebyshev points when the module loads.
"""

from __future__ import annotations

import math

import numpy as np
from numpy.polynomial import chebyshev
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.functions.special import normal_ppf

DEGREE = 30


def _scaled_erfc(z: float) -> float:
    """erfc(z) * exp(z**2)."""
    if z < 5:
        return math.erfc(z) * math.exp(z * z)
    f = z
    for k in range(60, 0, -1):  # the continued fraction, from its far end
        f = z + k / 2 / f
    return 1 / (f * math.sqrt(math.pi))


def _g(y: np.ndarray) -> np.ndarray:
    t = (y + 1) / 2
    return np.array([math.log(_scaled_erfc(2 / x - 2) / x) if x > 1e-12 else -math.log(2 * math.sqrt(math.pi)) for x in t])


_CHEB = chebyshev.chebinterpolate(_g, DEGREE)


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def erfc(x: Column) -> Column:
    steps = F.array(*[F.lit(float(c)) for c in _CHEB[:0:-1]])
    start = F.struct(F.lit(0.0).alias("b1"), F.lit(0.0).alias("b2"))

    def at(v: Column) -> Column:
        z = F.abs(v)
        y = 4 / (z + 2) - 1
        ends = F.aggregate(steps, start, lambda s, c: F.struct((2 * y * s["b1"] - s["b2"] + c).alias("b1"), s["b1"].alias("b2")))
        half = let(ends, lambda b: 2 / (z + 2) * F.exp(-z * z + y * b["b1"] - b["b2"] + float(_CHEB[0])))
        return let(half, lambda h: F.when(v >= 0, h).otherwise(2 - h))

    return let(x, at)


def cdf(x: Column) -> Column:
    return erfc(-x / math.sqrt(2)) / 2


def pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def chi_square_1_sf(x: Column) -> Column:
    """Upper tail of a chi-square with one degree of freedom."""
    return erfc(F.sqrt(F.greatest(x, F.lit(0.0)) / 2))


def ppf(p: Column) -> Column:
    """Normal quantile: a rational first guess on the tail of the nearer side, then Newton steps with the exact tail; null outside (0, 1)."""

    def at(q: Column) -> Column:
        low = F.least(q, 1 - q)
        t = F.sqrt(-2 * F.ln(low))
        # fixed values: a classic two-by-three rational approximation
        x = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t))
        for _ in range(4):
            x = let(x, lambda v: v - (cdf(v) - low) / F.greatest(pdf(v), F.lit(1e-300)))
        return let(x, lambda v: F.when(q == 0.5, 0.0).when(q < 0.5, v).otherwise(-v))

    return let(F.when((p > 0) & (p < 1), p), at)


def z(confidence: float) -> float:
    """The normal quantile of the tail, a literal for plans."""
    return normal_ppf(1 - confidence)


def uniform(*keys, seed: int = 0) -> Column:
    """A uniform number in (0, 1) from a hash of the keys: the same whatever the partitioning."""
    h = F.xxhash64(F.lit(seed), *keys)
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
