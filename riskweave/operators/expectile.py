"""Expectiles: the exact sample root in one sorted pass, closed forms by root search."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.errors import BadLevel, OutOfDomain
from riskweave.functions import special
from riskweave.operators.frames import need


def _check(level: float) -> None:
    need(0 < level < 1, BadLevel, "a level must lie strictly between 0 and 1")


@dataclass(frozen=True)
class Expectile:
    value: float
    level: float
    upper: float
    lower: float
    mean: float

    @property
    def identity(self) -> float:
        return self.level * self.upper - (1 - self.level) * self.lower

    @property
    def exceedance_ratio(self) -> float:
        return self.upper / self.lower


def sample_expectiles(panel: DataFrame, level: float, value: str = "loss") -> DataFrame:
    """(series, level, value, upper, lower, mean) of losses: the candidate of each gap between neighbouring losses, kept where it falls inside the gap."""
    _check(level)
    order = Window.partitionBy("series").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("series")
    rows = panel.groupBy("series", F.col(value).alias("x")).agg(F.count("*").alias("c"))  # equal losses once
    rows = rows.select(
        "series", "x", F.lead("x").over(Window.partitionBy("series").orderBy("x")).alias("next"),
        F.sum("c").over(order).alias("nb"), F.sum(F.col("c") * F.col("x")).over(order).alias("sb"), F.sum("c").over(every).alias("n"), F.sum(F.col("c") * F.col("x")).over(every).alias("s"),
    )
    above, total = F.col("n") - F.col("nb"), F.col("s") - F.col("sb")
    candidate = (level * total + (1 - level) * F.col("sb")) / (level * above + (1 - level) * F.col("nb"))
    inside = F.col("next").isNull() | ((F.col("e") >= F.col("x")) & (F.col("e") <= F.col("next")))
    low = F.col("nb") * F.col("e") - F.col("sb")
    found = rows.withColumn("e", candidate).withColumn("above", above).withColumn("total", total).where(inside)
    first = Window.partitionBy("series").orderBy("x")
    found = found.withColumn("__o", F.row_number().over(first)).where("__o = 1")
    return found.select("series", F.lit(level).alias("level"), F.col("e").alias("value"), ((F.col("total") - F.col("above") * F.col("e")) / F.col("n")).alias("upper"), (low / F.col("n")).alias("lower"), (F.col("s") / F.col("n")).alias("mean"))


def sample_expectile(losses, level: float) -> Expectile:
    _check(level)
    x = np.sort(np.asarray(list(losses), float))
    n, below = len(x), np.cumsum(x)
    need(n > 0, BadLevel, "no losses")
    k = np.arange(1, n + 1)
    e = (level * (x.sum() - below) + (1 - level) * below) / (level * (n - k) + (1 - level) * k)
    ok = (e >= x) & (e <= np.append(x[1:], np.inf))
    v = float(e[np.argmax(ok)]) if ok.any() else float(x[-1])
    return Expectile(v, level, float(np.maximum(x - v, 0).mean()), float(np.maximum(v - x, 0).mean()), float(x.mean()))


def asymmetric_squared_loss(forecast: float, loss: float, level: float) -> float:
    _check(level)
    return (level if loss > forecast else 1 - level) * (loss - forecast) ** 2


def expectile_identity(candidate: float, losses, level: float) -> float:
    x = np.asarray(losses, float)
    return float(level * np.maximum(x - candidate, 0).mean() - (1 - level) * np.maximum(candidate - x, 0).mean())


def _unit(level: float, upper: Callable[[float], float]) -> float:
    """Root of level * E(X - e)+ = (1 - level) * E(e - X)+ of a law with mean 0; upper(e) is E(X - e)+."""
    return special._root(lambda e: (1 - level) * (upper(e) + e) - level * upper(e), -1e3, 1e3, 400)


def normal_expectile(*, mean: float, volatility: float, level: float) -> Expectile:
    _check(level)
    upper = lambda e: special.normal_pdf(e) - e * special.normal_cdf(-e)
    e = _unit(level, upper)
    return Expectile(mean + volatility * e, level, volatility * upper(e), volatility * (upper(e) + e), mean)


def student_t_expectile(*, mean: float, volatility: float, level: float, degrees: float) -> Expectile:
    _check(level)
    need(degrees > 2, OutOfDomain, "a variance needs more than 2 degrees of freedom")
    scale = ((degrees - 2) / degrees) ** 0.5

    def upper(e: float) -> float:
        t = e / scale
        return scale * ((degrees + t * t) / (degrees - 1) * special.student_t_pdf(t, degrees) - t * special.student_t_cdf(-t, degrees))

    e = _unit(level, upper)
    return Expectile(mean + volatility * e, level, volatility * upper(e), volatility * (upper(e) + e), mean)


@dataclass(frozen=True)
class Match:
    level: float
    target: float
    value: float

    @property
    def residual(self) -> float:
        return self.value - self.target


def matching_level(target: float, expectile_of: Callable[[float], float]) -> Match:
    """The level whose expectile is the target."""
    level = special._root(lambda p: expectile_of(p) - target, 1e-12, 1 - 1e-12, 200)
    return Match(level, target, expectile_of(level))


def matching_levels(losses: DataFrame, targets: DataFrame) -> DataFrame:
    """(series, target, level): the level whose expectile of a series' losses is its target (series, target), for all series in one aggregation.

    At its own expectile the mean shortfall below and the mean excess above stand as level to 1 - level, so no search is
    needed. A target outside a series' losses, or losses that all equal it, have no level: null.
    """
    gap = F.col("loss") - F.col("target")
    sums = losses.join(targets.select("series", "target"), "series").groupBy("series", "target").agg(F.sum(F.greatest(-gap, F.lit(0.0))).alias("below"), F.sum(F.abs(gap)).alias("both"))
    share = F.try_divide("below", "both")
    return sums.select("series", "target", F.when((share > 0) & (share < 1), share).alias("level"))


def subadditivity_gap(first, second, level: float) -> float:
    x, y = np.asarray(first, float), np.asarray(second, float)
    return sum(sample_expectile(v, level).value for v in (x, y)) - sample_expectile(x + y, level).value


def comonotonic_gap(first, second, level: float) -> float:
    x, y = np.asarray(first, float), np.asarray(second, float)
    o = np.lexsort((y, x))
    need((np.diff(y[o]) >= 0).all(), BadLevel, "the pairs do not move together")
    return subadditivity_gap(x, y, level)
