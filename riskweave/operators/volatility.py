"""GARCH(1,1): the variance recursion as a plan, the fit one series to a task."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import StrEnum

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.errors import GarchDidNotConverge
from riskweave.functions import special
from riskweave.operators.frames import require_rows
from riskweave.operators.parametric import Distribution, Risk, parametric
from riskweave.operators.recursion import affine

# Fixed values.
MIN_OBSERVATIONS = 100
MAX_PERSISTENCE = 0.9999
MIN_DEGREES = 2.1
MAX_DEGREES = 1000.0
IDENTIFIED_DEGREES = 200.0


class Innovation(StrEnum):
    NORMAL = "normal"
    STUDENT_T = "student-t"


def garch_variances(panel: DataFrame, *, omega: float, alpha: float, beta: float, mean: float = 0.0, seed: float | None = None) -> DataFrame:
    """(series, t, r, variance, next_variance): a recursion along each series, seeded with the ML variance of the sample."""
    start = F.var_pop("r") if seed is None else F.max(F.lit(float(seed)))
    shock = F.col("r") - mean
    run = affine(panel, omega + alpha * shock * shock, beta, start)
    return run.withColumnsRenamed({"v": "variance", "next_v": "next_variance"})


def variances(returns, omega: float, alpha: float, beta: float, mean: float = 0.0, seed: float | None = None) -> np.ndarray:
    x = np.asarray(returns, float) - mean
    out = np.empty(len(x))
    v = float(np.var(np.asarray(returns, float))) if seed is None else seed
    for k, e in enumerate(x.tolist()):
        out[k] = v
        v = omega + alpha * e * e + beta * v
    return out


@dataclass(frozen=True)
class Garch:
    omega: float
    alpha: float
    beta: float
    mean: float
    variances: np.ndarray
    log_likelihood: float
    observations: int
    iterations: int
    converged: bool
    innovation: Innovation = Innovation.NORMAL
    degrees: float | None = None
    last_return: float = 0.0

    persistence = property(lambda self: self.alpha + self.beta)
    long_run_variance = property(lambda self: self.omega / (1 - self.persistence))
    long_run_volatility = property(lambda self: math.sqrt(self.long_run_variance))
    half_life = property(lambda self: math.log(0.5) / math.log(self.persistence) if 0 < self.persistence < 1 else 0.0)
    volatilities = property(lambda self: np.sqrt(self.variances))
    degrees_identified = property(lambda self: self.degrees is not None and self.degrees < IDENTIFIED_DEGREES)

    @property
    def implied_excess_kurtosis(self) -> float:
        if self.degrees is None:
            return 0.0
        return 6 / (self.degrees - 4) if self.degrees > 4 else math.inf

    def standardised(self, returns) -> np.ndarray:
        return (np.asarray(returns, float) - self.mean) / self.volatilities

    def next_variance(self, last_return: float) -> float:
        return self.omega + self.alpha * (last_return - self.mean) ** 2 + self.beta * float(self.variances[-1])

    def forecast(self, steps: int, *, last_return: float | None = None) -> np.ndarray:
        first = float(self.variances[-1]) if last_return is None else self.next_variance(last_return)
        level = self.long_run_variance
        return level + self.persistence ** np.arange(steps) * (first - level)

    def horizon_variance(self, steps: int, *, last_return: float | None = None) -> float:
        return float(self.forecast(steps, last_return=last_return).sum())

    def scaling_against_square_root_of_time(self, steps: int, *, last_return: float | None = None) -> float:
        f = self.forecast(steps, last_return=last_return)
        return math.sqrt(float(f.sum()) / (steps * float(f[0])))

    def risk(self, *, confidence: float = 0.99, last_return: float | None = None) -> Risk:
        v = float(self.variances[-1]) if last_return is None else self.next_variance(last_return)
        shape = {"distribution": Distribution.STUDENT_T, "degrees": self.degrees} if self.degrees is not None else {}
        return parametric(mean=self.mean, volatility=math.sqrt(v), confidence=confidence, **shape)


def _simplex(f, start: np.ndarray, step: float, iterations: int, tolerance: float = 1e-10) -> tuple[np.ndarray, float, int, bool]:
    """Downhill simplex search."""
    points = [start] + [start + step * e for e in np.eye(len(start))]
    points = sorted(((f(p), k, p) for k, p in enumerate(points)), key=lambda x: x[:2])
    n = 0
    for n in range(1, iterations + 1):
        values, best, worst = [p[0] for p in points], points[0], points[-1]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance) and max(np.abs(p[2] - best[2]).max() for p in points) < 1e-6:
            return best[2], best[0], n, True
        centre = np.mean([p[2] for p in points[:-1]], axis=0)
        at = lambda k: centre + k * (centre - worst[2])  # noqa: B023, E731
        new = (f(at(1.0)), n + 10, at(1.0))
        if new[0] < values[0]:
            far = (f(at(2.0)), n + 10, at(2.0))
            new = min(new, far, key=lambda x: x[0])
        elif new[0] >= values[-2]:
            k = 0.5 if new[0] < worst[0] else -0.5
            new = (f(at(k)), n + 10, at(k))
            if new[0] >= worst[0]:
                points = [best] + [(f(q := best[2] + 0.5 * (p[2] - best[2])), n + 10, q) for p in points[1:]]
                points.sort(key=lambda x: x[:2])
                continue
        points = sorted([*points[:-1], new], key=lambda x: x[:2])
    return points[0][2], points[0][0], n, False


def fit_garch(returns, *, variance_targeting: bool = False, mean: float | None = None, strict: bool = True, max_iterations: int = 4000, innovation: Innovation = Innovation.NORMAL) -> Garch:
    """Maximum likelihood in coordinates that keep persistence below one and the variance positive."""
    x = np.asarray(returns, float)
    require_rows(len(x), MIN_OBSERVATIONS, "a variance model")
    mu = float(x.mean()) if mean is None else mean
    e2, level = (x - mu) ** 2, float(np.var(x))
    fat = innovation == Innovation.STUDENT_T
    squash = lambda y: 1 / (1 + math.exp(-max(-500.0, min(500.0, y))))

    def unpack(p):
        persistence = MAX_PERSISTENCE * squash(p[0])
        alpha = persistence * squash(p[1])
        rest = list(p[2:])
        lr = level if variance_targeting else level * math.exp(max(-20.0, min(20.0, rest.pop(0))))
        nu = MIN_DEGREES + (MAX_DEGREES - MIN_DEGREES) * squash(rest.pop(0)) if fat else None
        return lr * (1 - persistence), alpha, persistence - alpha, nu

    def path(omega, alpha, beta) -> np.ndarray:
        out, v = np.empty(len(e2)), level
        for k, s in enumerate(squares):
            out[k] = v
            v = omega + alpha * s + beta * v
        return out

    squares = e2.tolist()

    def cost(p) -> float:
        omega, alpha, beta, nu = unpack(p)
        v = np.maximum(path(omega, alpha, beta), 1e-300)
        if nu is None:
            like = -0.5 * (math.log(2 * math.pi) + np.log(v) + e2 / v).sum()
        else:
            c = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log((nu - 2) * math.pi)
            like = (c - 0.5 * np.log(v) - (nu + 1) / 2 * np.log1p(e2 / v / (nu - 2))).sum()
        return -float(like) if math.isfinite(like) else 1e300

    logit = lambda q: math.log(q / (1 - q))
    start = [logit(0.95), logit(0.08)] + [0.0] * (not variance_targeting) + [logit(6 / MAX_DEGREES)] * fat
    best, value, n, done = _simplex(cost, np.array(start), 0.4, max_iterations)
    omega, alpha, beta, nu = unpack(best)
    if strict and not done:
        raise GarchDidNotConverge("the likelihood still rises")
    return Garch(omega, alpha, beta, mu, path(omega, alpha, beta), -value, len(x), n, done, innovation, nu, float(x[-1]))


@dataclass(frozen=True)
class FatTail:
    statistic: float
    p_value: float
    degrees: float
    identified: bool
    normal_log_likelihood: float
    student_log_likelihood: float

    fat = property(lambda self: self.p_value < 0.05 and self.identified)


def fat_tail_test(returns, *, variance_targeting: bool = False, mean: float | None = None) -> FatTail:
    a = fit_garch(returns, variance_targeting=variance_targeting, mean=mean)
    b = fit_garch(returns, variance_targeting=variance_targeting, mean=mean, innovation=Innovation.STUDENT_T)
    s = max(0.0, 2 * (b.log_likelihood - a.log_likelihood))
    return FatTail(s, special.chi_square_sf(s, 1), b.degrees, b.degrees_identified, a.log_likelihood, b.log_likelihood)


_FIT = "series string, omega double, alpha double, beta double, mean double, degrees double, log_likelihood double, observations bigint, converged boolean, current_variance double, next_variance double"


def fit_garch_models(panel: DataFrame, innovation: Innovation = Innovation.NORMAL, variance_targeting: bool = False) -> DataFrame:
    """One row of fitted parameters per series; a series too short has nulls."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        name = pdf["series"].iloc[0]
        columns = [c.split()[0] for c in _FIT.split(", ")]
        if len(pdf) < MIN_OBSERVATIONS:
            return pd.DataFrame([(name, *[None] * 6, len(pdf), False, None, None)], columns=columns)
        g = fit_garch(pdf["r"], innovation=innovation, variance_targeting=variance_targeting, strict=False)
        return pd.DataFrame([(name, g.omega, g.alpha, g.beta, g.mean, g.degrees, g.log_likelihood, g.observations, g.converged, float(g.variances[-1]), g.next_variance(g.last_return))], columns=columns)

    return panel.groupBy("series").applyInPandas(fit, _FIT)


def garch_forecast_series(panel: DataFrame, variance_targeting: bool = False) -> DataFrame:
    """(series, t, r, volatility, next_volatility): one-step volatilities of a fit per series."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        g = fit_garch(pdf["r"], variance_targeting=variance_targeting, strict=False)
        return pd.DataFrame({"series": pdf["series"], "t": pdf["t"], "r": pdf["r"], "volatility": g.volatilities, "next_volatility": math.sqrt(g.next_variance(g.last_return))})

    kind = panel.schema["t"].dataType.simpleString()
    return panel.groupBy("series").applyInPandas(fit, f"series string, t {kind}, r double, volatility double, next_volatility double")
