"""Finite normal mixtures of losses: regimes, and the risk that is not an average of risks."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.errors import BadMixture
from riskweave.functions import special
from riskweave.operators.frames import cut, need

# Fixed values.
NEGLIGIBLE = 1e-15
DEFAULT_FLOOR = 1e-8


@dataclass(frozen=True)
class Component:
    weight: float
    mean: float
    deviation: float

    def __post_init__(self) -> None:
        need(self.weight > 0 and self.deviation > 0 and all(map(math.isfinite, (self.weight, self.mean, self.deviation))), BadMixture, "a component needs a positive weight and deviation")

    def _z(self, loss: float) -> float:
        return (loss - self.mean) / self.deviation

    def cdf(self, loss: float) -> float:
        return special.normal_cdf(self._z(loss))

    def survival(self, loss: float) -> float:
        return special.normal_cdf(-self._z(loss))

    def pdf(self, loss: float) -> float:
        return special.normal_pdf(self._z(loss)) / self.deviation

    def partial_mean(self, loss: float) -> float:
        """E[L; L > loss]."""
        return self.mean * self.survival(loss) + self.deviation * special.normal_pdf(self._z(loss))


@dataclass(frozen=True)
class NormalMixture:
    components: tuple[Component, ...]

    def __post_init__(self) -> None:
        need(len(self.components) > 0, BadMixture, "a mixture needs a component")
        total = math.fsum(c.weight for c in self.components)
        object.__setattr__(self, "components", tuple(Component(c.weight / total, c.mean, c.deviation) for c in self.components))

    @classmethod
    def of(cls, parts) -> NormalMixture:
        return cls(tuple(Component(*p) for p in parts))

    @classmethod
    def two_regime(cls, *, stress: float, calm_mean: float = 0.0, calm_deviation: float = 1.0, stress_mean: float = 0.0, stress_deviation: float = 1.0) -> NormalMixture:
        need(0 < stress < 1, BadMixture, "the share of stress must lie strictly between 0 and 1")
        return cls.of([(1 - stress, calm_mean, calm_deviation), (stress, stress_mean, stress_deviation)])

    def _sum(self, f) -> float:
        return math.fsum(c.weight * f(c) for c in self.components)

    mean = property(lambda self: self._sum(lambda c: c.mean))
    variance = property(lambda self: self.central_moment(2))
    deviation = property(lambda self: math.sqrt(self.variance))
    skewness = property(lambda self: self.central_moment(3) / self.variance**1.5)
    excess_kurtosis = property(lambda self: self.central_moment(4) / self.variance**2 - 3)

    def central_moment(self, order: int) -> float:
        m = self.mean
        even = lambda k: math.prod(range(1, k, 2))  # noqa: E731  (moments of the unit normal)
        return self._sum(lambda c: sum(math.comb(order, k) * (c.mean - m) ** (order - k) * c.deviation**k * even(k) for k in range(0, order + 1, 2)))

    def cdf(self, loss: float) -> float:
        return self._sum(lambda c: c.cdf(loss))

    def survival(self, loss: float) -> float:
        return self._sum(lambda c: c.survival(loss))

    def pdf(self, loss: float) -> float:
        return self._sum(lambda c: c.pdf(loss))

    def partial_mean(self, loss: float) -> float:
        return self._sum(lambda c: c.partial_mean(loss))

    def quantile(self, probability: float) -> float:
        need(0 < probability < 1, BadMixture, "a probability must lie strictly between 0 and 1")
        ends = [c.mean + c.deviation * special.normal_ppf(probability) for c in self.components]
        if probability > 0.5:
            f = lambda x: (1 - probability) - self.survival(x)
        else:
            f = lambda x: self.cdf(x) - probability
        return special._root(f, min(ends) - 1e-9, max(ends) + 1e-9)

    def shifted(self, by: float) -> NormalMixture:
        return NormalMixture.of((c.weight, c.mean + by, c.deviation) for c in self.components)

    def scaled(self, by: float) -> NormalMixture:
        need(by > 0, BadMixture, "a scale must be positive")
        return NormalMixture.of((c.weight, c.mean * by, c.deviation * by) for c in self.components)


@dataclass(frozen=True)
class MixtureRisk:
    confidence: float
    value_at_risk: float
    expected_tail_loss: float
    responsibility: tuple
    averaged: float

    tail_probability = property(lambda self: 1 - self.confidence)
    averaging_error = property(lambda self: self.averaged / self.expected_tail_loss - 1)
    tail_ratio = property(lambda self: self.expected_tail_loss / self.value_at_risk)


def responsibilities(mixture: NormalMixture, loss: float) -> tuple[float, ...]:
    """P(component | L > loss)."""
    total = mixture.survival(loss)
    return tuple(c.weight * c.survival(loss) / total for c in mixture.components)


def averaged_tail_loss(mixture: NormalMixture, confidence: float) -> float:
    """The weighted mean of the components' own tail losses: the wrong number, for comparison."""
    z = special.normal_ppf(confidence)
    return sum(c.weight * (c.mean + c.deviation * special.normal_pdf(z) / (1 - confidence)) for c in mixture.components)


def mixture_risk(mixture: NormalMixture, confidence: float) -> MixtureRisk:
    v = mixture.quantile(confidence)
    return MixtureRisk(confidence, v, mixture.partial_mean(v) / mixture.survival(v), responsibilities(mixture, v), averaged_tail_loss(mixture, confidence))


def tail_ratio(mixture: NormalMixture, confidence: float) -> float:
    return mixture_risk(mixture, confidence).tail_ratio


def convolve(left: NormalMixture, right: NormalMixture, *, negligible: float = NEGLIGIBLE) -> NormalMixture:
    """The law of the sum of independent losses."""
    pairs = [(a.weight * b.weight, a.mean + b.mean, math.hypot(a.deviation, b.deviation)) for a, b in product(left.components, right.components)]
    return NormalMixture.of(p for p in pairs if p[0] >= negligible)


def convolve_frames(left: DataFrame, right: DataFrame, negligible: float = NEGLIGIBLE) -> DataFrame:
    """(weight, mean, deviation) of all pairs of two component frames (a handful of rows each)."""
    r = right.select(F.col("weight").alias("w2"), F.col("mean").alias("m2"), F.col("deviation").alias("d2"))
    both = left.crossJoin(F.broadcast(r))  # components of a mixture, not data
    return both.select((F.col("weight") * F.col("w2")).alias("weight"), (F.col("mean") + F.col("m2")).alias("mean"), F.hypot("deviation", "d2").alias("deviation")).where(F.col("weight") >= negligible)


def diversification_gap(left: NormalMixture, right: NormalMixture, confidence: float) -> float:
    return convolve(left, right).quantile(confidence) - left.quantile(confidence) - right.quantile(confidence)


@dataclass(frozen=True)
class Fitted:
    mixture: NormalMixture
    log_likelihood: float
    iterations: int
    converged: bool
    degenerate: bool


def fit_mixture(sample, components: int = 2, *, floor: float = DEFAULT_FLOOR, tolerance: float = 1e-10, iterations: int = 500) -> Fitted:
    """Expectation maximisation from the midpoints of quantile bands."""
    x = np.sort(np.asarray(sample, float))
    need(components >= 1 and len(x) >= 2 * components, BadMixture, "too few losses for so many components")
    need(bool(np.isfinite(x).all()), BadMixture, "losses must be finite")
    need(x[0] < x[-1], BadMixture, "equal losses have no components")
    mean = x[(2 * np.arange(components) + 1) * len(x) // (2 * components)]
    sd, weight = np.full(components, max(x.std(ddof=1), floor)), np.full(components, 1 / components)
    before, done, k = -math.inf, False, 0
    for k in range(1, iterations + 1):
        log = np.log(weight) - np.log(sd) - 0.5 * ((x[:, None] - mean) / sd) ** 2 - 0.5 * math.log(2 * math.pi)
        top = log.max(axis=1, keepdims=True)
        like = np.exp(log - top)
        total = like.sum(axis=1, keepdims=True)
        now = float((np.log(total) + top).sum())
        if abs(now - before) <= tolerance * (1 + abs(now)):
            done = True
            break
        before = now
        r = like / total
        n = np.maximum(r.sum(axis=0), 1e-300)
        weight, mean = n / len(x), (r * x[:, None]).sum(axis=0) / n
        sd = np.maximum(np.sqrt((r * (x[:, None] - mean) ** 2).sum(axis=0) / n), floor)
    parts = sorted(zip(np.maximum(weight, 1e-300), mean, sd, strict=True), key=lambda p: p[2])
    return Fitted(NormalMixture.of((float(w), float(m), float(s)) for w, m, s in parts), now, k, done, bool((sd <= floor).any()))


def fit_mixtures(losses: DataFrame, components: int = 2, floor: float = DEFAULT_FLOOR) -> DataFrame:
    """(series, component, weight, mean, deviation, log_likelihood, converged): one series to a task."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        f = fit_mixture(pdf["loss"], components, floor=floor)
        return pd.DataFrame([(pdf["series"].iloc[0], k, c.weight, c.mean, c.deviation, f.log_likelihood, f.converged) for k, c in enumerate(f.mixture.components)], columns=["series", "component", "weight", "mean", "deviation", "log_likelihood", "converged"])

    return losses.groupBy("series").applyInPandas(fit, "series string, component int, weight double, mean double, deviation double, log_likelihood double, converged boolean")


def starting_mixtures(losses: DataFrame, components: int = 2, floor: float = DEFAULT_FLOOR) -> DataFrame:
    """(series, n, centre, parts): equal weights, the midpoints of quantile bands less the series' mean, and the sample's deviation; parts is an array of (weight, mean, deviation)."""
    need(components >= 1, BadMixture, "a mixture needs a component")
    bands = [F.expr(f"percentile_disc({(2 * k + 1) / (2 * components)!r}) WITHIN GROUP (ORDER BY loss)") for k in range(components)]
    sizes = losses.groupBy("series").agg(F.count("*").alias("n"), F.avg("loss").alias("centre"), F.greatest(F.stddev_samp("loss"), F.lit(floor)).alias("sd"), F.array(*bands).alias("bands"))
    part = lambda b: F.struct(F.lit(1.0 / components).alias("weight"), (b - F.col("centre")).alias("mean"), F.col("sd").alias("deviation"))
    return sizes.select("series", "n", "centre", F.transform("bands", part).alias("parts"))


def expectation_step(losses: DataFrame, mixtures: DataFrame, components: int, floor: float = DEFAULT_FLOOR) -> DataFrame:
    """(series, n, centre, parts, log_likelihood): one step of expectation maximisation for all series at once, one aggregation.

    The log likelihood is that of the mixtures that went in. Losses are taken less the series' mean, so that second
    moments keep their digits; partial sums are combined before the shuffle, so a long series is no hot task.
    """
    x = F.col("loss") - F.col("centre")
    log = F.transform("parts", lambda c: F.ln(c["weight"]) - F.ln(c["deviation"]) - F.pow((x - c["mean"]) / c["deviation"], 2) / 2 - 0.5 * math.log(2 * math.pi))
    rows = losses.select("series", "loss").join(mixtures.select("series", "n", "centre", "parts"), "series").select("series", "n", "centre", x.alias("x"), log.alias("log"))
    rows = rows.withColumn("top", F.array_max("log")).withColumn("like", F.transform("log", lambda v: F.exp(v - F.col("top")))).withColumn("total", F.aggregate("like", F.lit(0.0), lambda s, v: s + v))
    sums = [F.sum(F.get("like", k) / F.col("total") * F.pow(F.col("x"), d)).alias(f"s{d}_{k}") for k in range(components) for d in range(3)]
    out = rows.groupBy("series").agg(F.max("n").alias("n"), F.max("centre").alias("centre"), F.sum(F.ln("total") + F.col("top")).alias("log_likelihood"), *sums)

    def part(k):
        n = F.greatest(F.col(f"s0_{k}"), F.lit(1e-300))
        mean = F.col(f"s1_{k}") / n
        spread = F.sqrt(F.greatest(F.col(f"s2_{k}") / n - mean * mean, F.lit(0.0)))
        return F.struct(F.greatest(n / F.col("n"), F.lit(1e-300)).alias("weight"), mean.alias("mean"), F.greatest(spread, F.lit(floor)).alias("deviation"))

    return out.select("series", "n", "centre", F.array(*[part(k) for k in range(components)]).alias("parts"), "log_likelihood")


def fit_by_steps(losses: DataFrame, components: int = 2, *, floor: float = DEFAULT_FLOOR, steps: int = 500, tolerance: float = 1e-10, every: int = 5) -> DataFrame:
    """(series, component, weight, mean, deviation, log_likelihood): all series together, for long ones; ``fit_mixtures`` suits many short ones.

    Parameters are cut from their lineage after ``every`` steps, where the fit stops if no series' log likelihood moves by
    more than ``tolerance``, relative to its size. A series of equal losses or fewer than two a component is refused.
    """
    need(floor > 0 and steps >= 1, BadMixture, "a fit needs a positive floor and a step")
    odd = F.when((F.count("*") < 2 * components) | (F.min("loss") >= F.max("loss")), F.raise_error("equal losses, or too few, have no components"))
    losses = cut(losses.select("series", "loss"))
    losses.groupBy("series").agg(odd.alias("odd")).where("odd is not null").count()
    now = cut(starting_mixtures(losses, components, floor))
    done = 0
    while done < steps:
        before = None
        for _ in range(min(every, steps - done)):
            before, now = now, expectation_step(losses, now, components, floor)
            done += 1
        now = cut(now)
        if "log_likelihood" in before.columns:
            last = before.select("series", F.col("log_likelihood").alias("b")).join(now, "series").agg(F.max(F.abs(F.col("log_likelihood") - F.col("b")) / (1 + F.abs("log_likelihood")))).first()[0]
            if last is None or last <= tolerance:
                break
    ordered = F.array_sort("parts", lambda a, b: F.when(a["deviation"] < b["deviation"], -1).when(a["deviation"] > b["deviation"], 1).otherwise(0))
    rows = now.select("series", "centre", "log_likelihood", F.posexplode(ordered).alias("component", "p"))
    return rows.select("series", "component", "p.weight", (F.col("p.mean") + F.col("centre")).alias("mean"), "p.deviation", "log_likelihood")


@dataclass(frozen=True)
class Occupation:
    """How many of the periods are stressed."""

    periods: int
    probability: tuple

    @property
    def expected(self) -> float:
        return math.fsum(k * p for k, p in enumerate(self.probability))


def occupation_law(persistence: tuple[float, float], start: tuple[float, float], periods: int) -> Occupation:
    p, q = persistence
    need(0 <= p <= 1 and 0 <= q <= 1 and periods >= 1 and abs(sum(start) - 1) < 1e-9, BadMixture, "a chain needs probabilities and a period")
    calm, stress = np.zeros(periods + 1), np.zeros(periods + 1)
    calm[0], stress[1] = start
    for _ in range(periods - 1):
        into = calm * (1 - p) + stress * q
        calm, stress = calm * p + stress * (1 - q), np.append(0.0, into[:-1])
    return Occupation(periods, tuple(map(float, calm + stress)))


def stationary(persistence: tuple[float, float]) -> tuple[float, float]:
    p, q = persistence
    need(p + q < 2, BadMixture, "a chain that never moves has no single stationary law")
    return (1 - q) / (2 - p - q), (1 - p) / (2 - p - q)


def horizon_mixture(calm: Component, stressed: Component, persistence: tuple[float, float], start: tuple[float, float], periods: int) -> NormalMixture:
    """The loss over several periods: one component for each number of stressed ones."""
    law = occupation_law(persistence, start, periods)
    parts = []
    for k, mass in enumerate(law.probability):
        if mass > NEGLIGIBLE:
            parts.append((mass, (periods - k) * calm.mean + k * stressed.mean, math.sqrt((periods - k) * calm.deviation**2 + k * stressed.deviation**2)))
    return NormalMixture.of(parts)
