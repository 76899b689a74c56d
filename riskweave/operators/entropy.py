"""Entropy pooling: the least change of scenario weights that meets stated views."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.errors import TooShort, ViewsInfeasible, ViewsNotIdentified
from riskweave.operators.frames import need

# Fixed values.
MAX_POOL_ITERATIONS = 100
POOL_TOLERANCE = 1e-15
STALL_TOLERANCE = 1e-9


@dataclass(frozen=True)
class View:
    """A column of the scenario frame whose mean under the new weights is to be the target."""

    column: str
    target: float
    label: str = ""

    def __post_init__(self) -> None:
        need(bool(self.column), ViewsInfeasible, "a view needs a column")
        need(math.isfinite(self.target), ViewsInfeasible, f"a view must be finite, got {self.target}")

    def named(self, position: int) -> str:
        return self.label or f"view {position}"


def mean_view(column: str, target: float, label: str = "") -> View:
    return View(column, target, label)


def probability_view(column: str, target: float, label: str = "") -> View:
    """The view that a 0/1 column has the stated probability."""
    need(0 < target < 1, ViewsInfeasible, "a probability view must lie strictly between 0 and 1")
    return View(column, target, label)


def relative_entropy(scenarios: DataFrame, w: str = "w", prior: str | None = None) -> DataFrame:
    """(relative_entropy, effective_scenarios): against a prior column, or equal weights."""
    q = F.col(w)
    p = F.col(prior) if prior else None
    if prior is None:  # a count joined as one row, instead of a window over all rows
        n = scenarios.agg(F.count("*").alias("__n"))
        scenarios, p = scenarios.crossJoin(F.broadcast(n)), 1.0 / F.col("__n")
    ln = lambda x: F.when(q > 0, q * F.ln(x)).otherwise(0.0)
    return scenarios.agg(F.sum(ln(q / p)).alias("relative_entropy"), F.exp(-F.sum(ln(q))).alias("effective_scenarios"))


def effective_scenarios(weights) -> float:
    w = np.asarray(weights, float)
    w = w[w > 0]
    return float(np.exp(-(w * np.log(w)).sum()))


def tilt_to_probability(scenarios: DataFrame, inside: str, target: float, prior: str = "p") -> DataFrame:
    """One probability view in closed form: (.., w) with the mass inside and outside rescaled."""
    mass = scenarios.agg(F.sum(F.when(F.col(inside), F.col(prior)).otherwise(0.0)).alias("__in"), F.sum(prior).alias("__all"))
    both = scenarios.crossJoin(F.broadcast(mass))  # one row
    w = F.when(F.col(inside), F.col(prior) * target / F.col("__in")).otherwise(F.col(prior) * (1 - target) / (F.col("__all") - F.col("__in")))
    return both.withColumn("w", w).drop("__in", "__all")


@dataclass(frozen=True)
class Posterior:
    scenarios: DataFrame
    multipliers: tuple
    relative_entropy: float
    effective_scenarios: float
    residuals: tuple
    iterations: int
    dual_value: float
    count: int

    @property
    def concentration(self) -> float:
        return self.effective_scenarios / self.count


def pool(scenarios: DataFrame, views: list[View], prior: str | None = None, *, tolerance: float = POOL_TOLERANCE, max_iterations: int = MAX_POOL_ITERATIONS) -> Posterior:
    """Damped Newton on the dual. The scenarios stay distributed: each step is one aggregation that gives the tilted sum, means and second moments of the views."""
    k = len(views)
    stats = scenarios.agg(F.count("*").alias("n"), *[f(v.column).alias(f"{n}{i}") for i, v in enumerate(views) for n, f in (("lo", F.min), ("hi", F.max))], *([F.sum(prior).alias("total")] if prior else [])).first()
    n = stats["n"]
    need(n > 0, TooShort, "a view needs at least one scenario")
    low, high = np.array([stats[f"lo{i}"] for i in range(k)], float), np.array([stats[f"hi{i}"] for i in range(k)], float)
    target = np.array([v.target for v in views], float)
    span = high - low
    need((span > 0).all(), ViewsNotIdentified, "a view is about a constant")
    need(((target > low) & (target < high)).all(), ViewsInfeasible, "a view lies outside what the scenarios hold")
    p = F.col(prior) / stats["total"] if prior else F.lit(1.0 / n)
    x = [(F.col(v.column) - v.target) / float(s) for v, s in zip(views, span, strict=True)]

    def at(m: np.ndarray):
        tilt = F.lit(0.0)
        for c, a in zip(x, m, strict=True):
            tilt = tilt + float(a) * c
        shift = scenarios.agg(F.max(tilt)).first()[0]
        e = p * F.exp(tilt - shift)
        row = scenarios.agg(F.sum(e), *[F.sum(e * c) for c in x], *[F.sum(e * x[i] * x[j]) for i in range(k) for j in range(k)]).first()
        mean = np.array(row[1 : k + 1]) / row[0]
        second = np.array(row[k + 1 :]).reshape(k, k) / row[0]
        return math.log(row[0]) + shift, mean, second - np.outer(mean, mean), e, row[0]

    m = np.zeros(k)
    value, mean, hessian, e, total = at(m)
    steps = 0
    for steps in range(1, max_iterations + 1):
        if np.abs(mean).max() <= max(tolerance, 4e-15):
            break
        if np.linalg.cond(hessian + np.eye(k) * 1e-300) > 1e14:
            if np.abs(m).max() > 500:
                raise ViewsInfeasible("the views cannot hold together")
            raise ViewsNotIdentified("the views depend on each other")
        move = -np.linalg.solve(hessian, mean)
        size = 1.0
        for _ in range(60):
            got = at(m + size * move)
            if got[0] <= value + 1e-4 * size * float(mean @ move) + 1e-16:
                break
            size /= 2
        else:
            break
        m = m + size * move
        done = value - got[0] <= 1e-16 and np.abs(got[1]).max() >= np.abs(mean).max()
        value, mean, hessian, e, total = got
        if done:
            break
    if np.abs(mean).max() > STALL_TOLERANCE:
        raise ViewsInfeasible("the views cannot hold together")
    weighted = scenarios.withColumn("w", e / total)
    own = relative_entropy(weighted, "w").first()
    re = float(own["relative_entropy"]) if prior is None else float(-value + (m @ mean))
    return Posterior(weighted, tuple(float(a / s) for a, s in zip(m, span, strict=True)), re, float(own["effective_scenarios"]), tuple(float(a * s) for a, s in zip(mean, span, strict=True)), steps, float(-value), n)


def temper(scenarios: DataFrame, confidence: float, w: str = "w", prior: str = "p") -> DataFrame:
    """(1 - c) prior + c posterior."""
    need(0 <= confidence <= 1, ValueError, "a confidence must lie in [0, 1]")
    return scenarios.withColumn(w, (1 - confidence) * F.col(prior) + confidence * F.col(w))


def _cumulative(frame: DataFrame, value: str, w: str) -> DataFrame:
    order = Window.partitionBy("series").orderBy(value, *(["t"] if "t" in frame.columns else [])).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frame.select("series", F.col(value).alias("x"), F.col(w).alias("w"), F.sum(w).over(order).alias("cum"))


def weighted_quantile(frame: DataFrame, probability: float, value: str = "r", w: str = "w") -> DataFrame:
    """(series, quantile): the smallest value with cumulative weight of at least the probability."""
    return _cumulative(frame, value, w).where(F.col("cum") >= probability - 1e-15).groupBy("series").agg(F.min("x").alias("quantile"))


def weighted_expected_tail_loss(frame: DataFrame, probability: float, value: str = "r", w: str = "w") -> DataFrame:
    """(series, tail_mean, mass): the mean up to and including the scenario at which the probability is reached."""
    rows = _cumulative(frame, value, w).where(F.col("cum") - F.col("w") < probability - 1e-15)
    return rows.groupBy("series").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("tail_mean"), F.sum("w").alias("mass"))


def stressed_risk(frame: DataFrame, confidence: float, value: str = "r", w: str = "w") -> DataFrame:
    """(series, value_at_risk, expected_tail_loss, mean, volatility) under the weights."""
    alpha = 1 - confidence
    x = F.col(value)
    m = frame.groupBy("series").agg((F.sum(F.col(w) * x) / F.sum(w)).alias("mean"), (F.sum(F.col(w) * x * x) / F.sum(w)).alias("square"))
    both = weighted_quantile(frame, alpha, value, w).join(weighted_expected_tail_loss(frame, alpha, value, w), "series").join(m, "series")
    return both.select("series", (-F.col("quantile")).alias("value_at_risk"), (-F.col("tail_mean")).alias("expected_tail_loss"), "mean", F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))).alias("volatility"))
