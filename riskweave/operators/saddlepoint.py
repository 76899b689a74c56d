"""The tail of a sum of independent defaults. An obligor frame is (obligor, probability, exposure)."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.errors import SaddlepointError
from riskweave.functions import special
from riskweave.operators.frames import need

# Fixed values.
SADDLE_FLOOR = 1e-6
SPAN_DENOMINATOR = 1024


def checked_obligors(obligors: DataFrame) -> DataFrame:
    good = F.col("probability").between(0, 1) & (F.col("exposure") > 0)
    return obligors.withColumn("exposure", F.when(good, F.col("exposure")).otherwise(F.raise_error("an obligor needs a probability in [0, 1] and a positive exposure")))


def portfolio_moments(obligors: DataFrame) -> DataFrame:
    """(names, mean, variance, maximum): one row."""
    p, e = F.col("probability"), F.col("exposure")
    return checked_obligors(obligors).agg(F.count("*").alias("names"), F.sum(p * e).alias("mean"), F.sum(p * (1 - p) * e * e).alias("variance"), F.sum(F.when(p > 0, e).otherwise(0.0)).alias("maximum"))


def cumulants_at(obligors: DataFrame, tilt: float) -> DataFrame:
    """(cumulant, first, second, third): the cumulant function and its derivatives at a tilt, one row."""
    p, e = F.col("probability"), F.col("exposure")
    q = F.when(p >= 1, 1.0).otherwise(p / (p + (1 - p) * F.exp(-tilt * e)))
    return obligors.agg(F.sum(F.log1p(p * F.expm1(tilt * e))).alias("cumulant"), F.sum(q * e).alias("first"), F.sum(q * (1 - q) * e * e).alias("second"), F.sum(q * (1 - q) * (1 - 2 * q) * e * e * e).alias("third"))


def grouped(obligors: DataFrame) -> LossPortfolio:
    """Obligors that are alike as one row with a count, on the driver: as many rows as distinct (probability, exposure)."""
    rows = checked_obligors(obligors).groupBy("probability", "exposure").agg(F.count("*").alias("c")).orderBy("probability", "exposure").collect()
    return LossPortfolio(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)).detected()


def lattice_span(exposures) -> float:
    """The greatest step that divides all exposures, as fractions of denominators up to a bound; 0 if there is none."""
    parts = []
    for e in {float(x) for x in exposures}:
        f = Fraction(e).limit_denominator(SPAN_DENOMINATOR)
        if abs(float(f) - e) > 1e-12 * max(1.0, abs(e)):
            return 0.0
        parts.append(f)
    if not parts:
        return 0.0
    den = math.lcm(*(f.denominator for f in parts))
    return math.gcd(*(int(f * den) for f in parts)) / den


@dataclass(frozen=True)
class LossPortfolio:
    """Distinct obligors with counts, and the step of the loss lattice (0: none)."""

    p: np.ndarray
    e: np.ndarray
    count: np.ndarray
    span: float = 0.0

    def __post_init__(self) -> None:
        need(len(self.p) > 0 and ((self.p >= 0) & (self.p <= 1) & (self.e > 0)).all(), SaddlepointError, "obligors need probabilities in [0, 1] and positive exposures")

    @classmethod
    def of(cls, obligors) -> LossPortfolio:
        p, e = zip(*obligors, strict=True)
        return cls(np.array(p, float), np.array(e, float), np.ones(len(p)))

    @classmethod
    def homogeneous(cls, names: int, probability: float, exposure: float = 1.0) -> LossPortfolio:
        return cls(np.array([probability]), np.array([exposure]), np.array([float(names)]), exposure)

    def detected(self) -> LossPortfolio:
        return LossPortfolio(self.p, self.e, self.count, lattice_span(self.e))

    def without(self, position: int) -> LossPortfolio:
        count = self.count.copy()
        count[position] -= 1
        keep = count > 0
        return LossPortfolio(self.p[keep], self.e[keep], count[keep], self.span)

    mean = property(lambda self: float((self.count * self.p * self.e).sum()))
    variance = property(lambda self: float((self.count * self.p * (1 - self.p) * self.e**2).sum()))
    maximum = property(lambda self: float((self.count * self.e)[self.p > 0].sum()))

    def _q(self, t: float) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self.p / (self.p + (1 - self.p) * np.exp(-t * self.e))

    def cumulant(self, t: float) -> float:
        x = t * self.e
        big = x > 30
        small = np.log1p(self.p * np.expm1(np.where(big, 0, x)))
        far = x + np.log(np.maximum(self.p, 1e-300)) + np.log1p((1 - self.p) / np.maximum(self.p, 1e-300) * np.exp(-np.where(big, x, 0)))
        return float((self.count * np.where(big & (self.p > 0), far, small)).sum())

    def derivative(self, t: float) -> float:
        return float((self.count * self._q(t) * self.e).sum())

    def second_derivative(self, t: float) -> float:
        q = self._q(t)
        return float((self.count * q * (1 - q) * self.e**2).sum())

    def third_derivative(self, t: float) -> float:
        q = self._q(t)
        return float((self.count * q * (1 - q) * (1 - 2 * q) * self.e**3).sum())


def saddlepoint(portfolio: LossPortfolio, level: float) -> float:
    """The tilt whose mean is the level."""
    need(0 < level < portfolio.maximum, SaddlepointError, "the level lies outside the losses")
    bound = 50 / float(portfolio.e.min())
    return special._root(lambda t: portfolio.derivative(t) - level, -bound, bound, 300)


@dataclass(frozen=True)
class Exceedance:
    level: float
    probability: float
    raw: float
    tilt: float
    near_mean: bool

    clamped = property(lambda self: self.raw != self.probability)


def tail_probability(portfolio: LossPortfolio, level: float) -> Exceedance:
    """P(L > level) by the Lugannani-Rice formula; on a lattice, P(L >= next step) with its continuity correction."""
    d = portfolio.span
    x = (math.floor(level / d + 1e-9) + 1) * d if d else level
    if d and x >= portfolio.maximum - 1e-12:
        t = math.inf
        raw = float(np.prod(np.where(portfolio.p > 0, portfolio.p, 1.0) ** portfolio.count)) if abs(x - portfolio.maximum) < 1e-9 else 0.0
        return Exceedance(level, raw, raw, t, False)
    centre = x - d / 2
    t = saddlepoint(portfolio, centre)
    k2 = portfolio.second_derivative(t)
    near = abs(t) * math.sqrt(portfolio.variance) < SADDLE_FLOOR * 100
    if near:
        k2, k3 = portfolio.variance, portfolio.third_derivative(0.0)
        z = (centre - portfolio.mean) / math.sqrt(k2)
        raw = special.normal_cdf(-z) - k3 / (6 * k2**1.5) * (1 - z * z) * -special.normal_pdf(z)
    else:
        w = math.copysign(math.sqrt(max(0.0, 2 * (t * centre - portfolio.cumulant(t)))), t)
        u = (2 / d * math.sinh(min(700.0, max(-700.0, d * t / 2))) if d else t) * math.sqrt(k2)
        raw = special.normal_cdf(-w) + special.normal_pdf(w) * (1 / u - 1 / w)
    return Exceedance(level, min(1.0, max(0.0, raw)), raw, t, near)


def exceedance_probability(portfolio: LossPortfolio, level: float) -> float:
    """P(L > level), with the exact ends."""
    if level < 0:
        return 1.0
    if level >= portfolio.maximum:
        return 0.0
    if level == 0:
        return -math.expm1(float((portfolio.count * np.log1p(-np.minimum(portfolio.p, 1 - 1e-16))).sum())) if (portfolio.p < 1).all() else 1.0
    return tail_probability(portfolio, level).probability


def tail_loss_contributions(portfolio: LossPortfolio, level: float) -> np.ndarray:
    """E[loss of one obligor; L > level] for each distinct obligor: e p P(rest > level - e)."""
    out = []
    for k, (p, e) in enumerate(zip(portfolio.p, portfolio.e, strict=True)):
        if portfolio.count.sum() == 1:
            out.append(e * p * (e > level))
        else:
            out.append(e * p * exceedance_probability(portfolio.without(k), level - e))
    return np.array(out, float)


def saddlepoint_tail_loss(portfolio: LossPortfolio, level: float) -> float:
    chance = exceedance_probability(portfolio, level)
    need(chance > 0, SaddlepointError, "nothing lies beyond the level")
    return float((portfolio.count * tail_loss_contributions(portfolio, level)).sum() / chance)


def exact_distribution(portfolio: LossPortfolio, *, unit: float = 1.0) -> np.ndarray:
    """Masses of losses 0, unit, 2 unit, ..: one convolution step per obligor."""
    size = portfolio.e / unit
    need(np.abs(size - size.round()).max() < 1e-9, SaddlepointError, "an exposure is not a multiple of the unit")
    mass = np.ones(1)
    for p, k, c in zip(portfolio.p, size.round().astype(int), portfolio.count.astype(int), strict=True):
        for _ in range(c):
            new = np.append(mass * (1 - p), np.zeros(k))
            new[k:] += mass * p
            mass = new
    return mass


def exact_tail(masses, level: float, *, unit: float = 1.0) -> float:
    m = np.asarray(masses, float)
    return float(m[np.arange(len(m)) * unit > level + 1e-12].sum())


def exact_tail_loss(masses, level: float, *, unit: float = 1.0) -> float:
    m = np.asarray(masses, float)
    x = np.arange(len(m)) * unit
    far = x > level + 1e-12
    need(m[far].sum() > 0, SaddlepointError, "nothing lies beyond the level")
    return float((m * x)[far].sum() / m[far].sum())


def normal_tail(portfolio: LossPortfolio, level: float) -> float:
    return special.normal_cdf((portfolio.mean - level) / math.sqrt(portfolio.variance))
