"""Where risk comes from: Euler allocation, risk parity, diversification."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.errors import NegativeContribution, NoRiskToAllocate, RiskParityDidNotConverge
from riskweave.functions import linalg
from riskweave.operators.covariance import matrix_vector
from riskweave.operators.frames import need
from riskweave.operators.parametric import Distribution, unit_tail
from riskweave.operators.series import portfolio


def _allocated(frame: DataFrame) -> DataFrame:
    """Adds total, share and the identity's error to (series, w, marginal, total)."""
    out = frame.withColumn("component", F.col("w") * F.col("marginal"))
    return out.select("series", "w", "marginal", "component", "total", F.try_divide("component", "total").alias("share"))


def volatility_contributions(weights: DataFrame, covariance: DataFrame) -> DataFrame:
    """(series, w, marginal, component, total, share): marginal (S w)_i / volatility."""
    return risk_contributions(weights, covariance, scale=1.0)


def risk_contributions(
    weights: DataFrame, covariance: DataFrame, means: DataFrame | None = None, confidence: float = 0.99, distribution: Distribution = Distribution.NORMAL, of_expected_tail_loss: bool = False, scale: float | None = None, **shape,
) -> DataFrame:
    """Euler contributions to parametric value at risk or expected tail loss: marginal scale * (S w)_i / volatility - mean_i."""
    if scale is None:
        q, tail = unit_tail(confidence, distribution, **shape)
        scale = -tail if of_expected_tail_loss else -q
    sw = matrix_vector(covariance, weights).withColumnRenamed("i", "series").join(weights, "series")
    if means is not None:
        sw = sw.join(means.select("series", "mean"), "series", "left")
    drift = F.coalesce(F.col("mean"), F.lit(0.0)) if means is not None else F.lit(0.0)
    every = Window.partitionBy(F.lit(1))  # one row per asset: the matrix is already aggregated
    vol = F.sqrt(F.sum(F.col("w") * F.col("value")).over(every))
    rows = sw.select("series", "w", "value", drift.alias("mean"), F.when(vol > 1e-300, vol).otherwise(F.raise_error("there is no risk to allocate")).alias("volatility"))
    rows = rows.withColumn("marginal", scale * F.col("value") / F.col("volatility") - F.col("mean"))
    return _allocated(rows.withColumn("total", scale * F.col("volatility") - F.sum(F.col("w") * F.col("mean")).over(every)))


def historical_tail_loss_contributions(panel: DataFrame, weights: DataFrame, confidence: float = 0.99) -> DataFrame:
    """Euler contributions to the portfolio's historical expected tail loss: each asset's mean over the portfolio's own tail."""
    alpha = 1 - confidence
    book = portfolio(panel, weights)
    order = Window.partitionBy("series").orderBy("r", "t")
    ranked = book.select("t", F.row_number().over(order).alias("rn"), F.count("*").over(Window.partitionBy("series")).alias("n"))
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("n") * alpha - (F.col("rn") - 1)))
    tail = ranked.select("t", part.alias("part")).where("part > 0")
    means = panel.join(tail, "t").groupBy("series").agg((-F.sum(F.col("part") * F.col("r")) / F.sum("part")).alias("marginal")).join(weights, "series")
    return _allocated(means.withColumn("total", F.sum(F.col("w") * F.col("marginal")).over(Window.partitionBy(F.lit(1)))))


def checked_allocation(allocation: DataFrame) -> DataFrame:
    """The allocation; an asset without a weight, a marginal or a component fails in the plan."""
    whole = F.col("w").isNotNull() & F.col("marginal").isNotNull() & F.col("component").isNotNull()
    return allocation.withColumn("component", F.when(whole, F.col("component")).otherwise(F.raise_error(F.concat(F.lit("an incomplete allocation: "), F.col("series").cast("string")))))


def euler_identity(allocation: DataFrame) -> DataFrame:
    """One row (assets, total, sum_of_components, identity_error, has_negative_contribution)."""
    rows = checked_allocation(allocation)
    sums = rows.agg(F.count("*").alias("assets"), F.max("total").alias("total"), F.sum("component").alias("sum_of_components"), F.bool_or(F.col("component") < 0).alias("has_negative_contribution"))
    return sums.withColumn("identity_error", F.abs(F.col("sum_of_components") - F.col("total")))


def contribution_of(allocation: DataFrame, name: str) -> float:
    """One asset's component."""
    found = allocation.where(F.col("series") == name).select("component").first()
    need(found is not None, KeyError, name)
    return found[0]


def diversification(allocation: DataFrame, covariance: DataFrame) -> DataFrame:
    """One row (diversification_ratio, effective_bets, concentration, largest) of a volatility allocation; null where a weight or share is negative."""
    sd = covariance.where("i = j").select(F.col("i").alias("series"), F.sqrt("v").alias("sd"))
    p = F.col("share")
    rows = allocation.join(sd, "series")
    good = F.min("share") >= 0
    return rows.agg(
        F.when(F.min("w") >= 0, F.sum(F.col("w") * F.col("sd")) / F.max("total")).alias("diversification_ratio"),
        F.when(good, F.exp(-F.sum(F.when(p > 0, p * F.ln(p)).otherwise(0.0)))).alias("effective_bets"),
        F.sum(p * p).alias("concentration"), F.max_by("series", F.struct("component", "series")).alias("largest"),
    )


def diversification_ratio(weights, covariance) -> float:
    w, m = np.asarray(weights, float), np.asarray(covariance, float)
    need((w >= 0).all(), NegativeContribution, "the ratio is for long-only books")
    vol = math.sqrt(linalg.quadratic_form(w, m))
    need(vol > 1e-300, NoRiskToAllocate, "the book has no risk")
    return float(w @ np.sqrt(np.diag(m)) / vol)


def effective_bets(shares) -> float:
    """exp of the entropy of risk shares."""
    p = np.asarray(shares, float)
    need((p >= 0).all(), NegativeContribution, "a share is negative")
    p = p[p > 0]
    return float(np.exp(-(p * np.log(p)).sum()))


def concentration(shares) -> float:
    p = np.asarray(shares, float)
    return float((p * p).sum())


@dataclass(frozen=True)
class RiskParity:
    names: list
    weights: np.ndarray
    budgets: np.ndarray
    sweeps: int
    final_change: float
    budget_error: float
    converged: bool

    @property
    def equal_risk(self) -> bool:
        return bool(np.abs(self.budgets - self.budgets[0]).max() <= 1e-12)


def risk_parity(covariance, *, budgets=None, names=None, tolerance: float = 1e-14, max_sweeps: int = 2000) -> RiskParity:
    """Long-only weights whose risk shares equal the budgets: coordinate descent on x'Sx / 2 - sum(b ln x), then normalised."""
    n, m = linalg.check_symmetric(covariance), np.asarray(covariance, float)
    b = np.full(n, 1 / n) if budgets is None else np.asarray(budgets, float)
    need(len(b) == n and (b > 0).all(), ValueError, "one positive budget for each asset")
    b = b / b.sum()
    need((np.diag(m) > 0).all(), NoRiskToAllocate, "an asset has no variance")
    x = np.sqrt(b / np.diag(m))
    change, sweep = math.inf, 0
    while sweep < max_sweeps and change > tolerance:
        change, sweep = 0.0, sweep + 1
        for i in range(n):
            cross = m[i] @ x - m[i, i] * x[i]
            root = math.sqrt(cross * cross + 4 * m[i, i] * b[i])
            new = 2 * b[i] / (cross + root) if cross > 0 else (root - cross) / (2 * m[i, i])
            change = max(change, abs(new - x[i]) / new)
            x[i] = new
    w = x / x.sum()
    share = w * (m @ w) / (w @ m @ w)
    out = RiskParity(list(names or range(n)), w, b, sweep, float(change), float(np.abs(share - b).max()), bool(change <= tolerance or np.abs(share - b).max() < 1e-12))
    if not out.converged:
        raise RiskParityDidNotConverge("the weights still move", out)
    return out


@dataclass(frozen=True)
class PrincipalBets:
    distribution: np.ndarray
    variances: np.ndarray
    effective_bets: float

    @property
    def concentration(self) -> float:
        return concentration(self.distribution)


def principal_bets(weights, covariance) -> PrincipalBets:
    """Variance along each eigenvector, largest eigenvalue first."""
    values, vectors = linalg.eigh(covariance)
    part = (np.maximum(values, 0) * (vectors @ np.asarray(weights, float)) ** 2)[::-1]
    need(part.sum() > 1e-300, NoRiskToAllocate, "the book has no risk")
    share = part / part.sum()
    return PrincipalBets(share, part, effective_bets(share))
