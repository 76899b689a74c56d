"""Risk over several periods, simulated from a fitted variance process: paths are rows, uniforms are hashes."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import StrEnum

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from riskweave.errors import OutOfDomain
from riskweave.operators.frames import need
from riskweave.operators.historical import historical_risk
from riskweave.operators.series import Convention
from riskweave.operators.volatility import Garch

# Fixed values.
MIN_PATHS = 1000
MIN_OBSERVED_RESIDUALS = 250
BATCHES = 20


class Innovations(StrEnum):
    PARAMETRIC = "parametric"
    BOOTSTRAP = "bootstrap"


@dataclass(frozen=True)
class HorizonRisk:
    value_at_risk: float
    expected_tail_loss: float
    additive_value_at_risk: float
    additive_volatility: float
    convention: Convention
    steps: int
    paths: int
    one_step_value_at_risk: float
    square_root_of_time_volatility: float
    standard_error: float
    ruined_paths: int

    @staticmethod
    def _over(a: float, b: float) -> float:
        return a / b if b else math.inf

    relative_standard_error = property(lambda self: self._over(self.standard_error, self.value_at_risk))
    scaling_against_square_root_of_time = property(lambda self: self._over(self.additive_volatility, self.square_root_of_time_volatility))
    compounding_factor = property(lambda self: self._over(self.value_at_risk, self.additive_value_at_risk))
    loss_against_square_root_of_time = property(lambda self: self._over(self.value_at_risk, math.sqrt(self.steps) * self.one_step_value_at_risk))
    quantile_against_square_root_of_time = property(lambda self: self._over(self.additive_value_at_risk, math.sqrt(self.steps) * self.one_step_value_at_risk))


def horizon_risk(
    spark: SparkSession, fitted: Garch, returns, *, steps: int, confidence: float = 0.99, paths: int = 20_000, innovations: Innovations = Innovations.BOOTSTRAP, seed: int = 0,
    convention: Convention = Convention.SIMPLE,
) -> HorizonRisk:
    """Simple returns compound (a path at zero stays there), log returns add. The standard error comes from 20 batches of paths.

    A path's draws come from a generator keyed by its number, so they do not depend on the partitioning; the pool of
    residuals is one series.
    """
    need(steps >= 1 and paths >= MIN_PATHS, OutOfDomain, f"at least one step and {MIN_PATHS} paths")
    residuals = fitted.standardised(returns)
    if innovations == Innovations.BOOTSTRAP:
        need(len(residuals) >= MIN_OBSERVED_RESIDUALS, OutOfDomain, f"a bootstrap needs {MIN_OBSERVED_RESIDUALS} residuals")
        residuals = (residuals - residuals.mean()) / residuals.std()
    first = fitted.next_variance(float(np.asarray(returns, float)[-1]))
    omega, alpha, beta, mean, degrees = fitted.omega, fitted.alpha, fitted.beta, fitted.mean, fitted.degrees
    boot, simple = innovations == Innovations.BOOTSTRAP, convention == Convention.SIMPLE

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            draws = np.empty((len(ids), steps))
            for row, path in enumerate(ids.tolist()):
                g = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), path]))
                if boot:
                    draws[row] = residuals[g.integers(0, len(residuals), steps)]
                elif degrees is not None:
                    draws[row] = g.standard_t(degrees, steps) * math.sqrt((degrees - 2) / degrees)
                else:
                    draws[row] = g.standard_normal(steps)
            v = np.full(len(ids), first)
            wealth, total, ruined = np.ones(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), bool)
            for k in range(steps):
                e = np.sqrt(v) * draws[:, k]
                r = mean + e
                total += r
                if simple:
                    ruined |= r <= -1
                    wealth = np.where(ruined, 0.0, wealth * (1 + r))
                v = omega + alpha * e * e + beta * v
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(wealth - 1 if simple else total), pa.array(total), pa.array(ruined)], names=["path", "r", "added", "ruined"])

    sim = spark.range(paths).mapInArrow(run, "path bigint, r double, added double, ruined boolean")
    rows = sim.select(F.explode(F.array(
        F.struct(F.lit("all").alias("series"), F.col("r").alias("r"), F.col("path").alias("t")),
        F.struct(F.lit("added").alias("series"), F.col("added").alias("r"), F.col("path").alias("t")),
        F.struct(F.concat(F.lit("batch "), F.floor(F.col("path") * BATCHES / paths).cast("string")).alias("series"), F.col("r").alias("r"), F.col("path").alias("t")),
    )).alias("x")).select("x.*")
    risk = {r["series"]: r for r in historical_risk(rows, confidence).collect()}
    spread = sim.agg(F.stddev_samp("added").alias("sd"), F.count_if("ruined").alias("ruined")).first()
    batch = [r["value_at_risk"] for k, r in risk.items() if k.startswith("batch")]
    one = fitted.risk(confidence=confidence, last_return=float(np.asarray(returns, float)[-1])).value_at_risk
    return HorizonRisk(
        risk["all"]["value_at_risk"], risk["all"]["expected_tail_loss"], risk["added"]["value_at_risk"], spread["sd"], convention, steps, paths, one,
        math.sqrt(steps * first), float(np.std(batch, ddof=1) / math.sqrt(len(batch))), spread["ruined"],
    )
