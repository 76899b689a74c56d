"""Second moments as matrix-long frames (i, j, v), Ledoit-Wolf shrinkage and diagnostics.

Pairs come from outer products of chunks of periods (see ``gram``), i <= j; the mirrored half is added afterwards. Weights, means and eigenvectors meet the matrix by joins or, for the small square that
is left, as arrays on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.functions import linalg
from riskweave.operators.frames import cut, matrix
from riskweave.operators.gram import pair_moments


def mirrored(upper: DataFrame) -> DataFrame:
    """Both halves of a matrix from its upper one, in one pass over it."""
    own, other = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    both = upper.select(F.explode(F.when(F.col("i") < F.col("j"), F.array(own, other)).otherwise(F.array(own))).alias("__at"), *[c for c in upper.columns if c not in ("i", "j")])
    return both.select(*[F.col(f"__at.{c}").alias(c) if c in ("i", "j") else F.col(c) for c in upper.columns])


def sample_covariance(panel: DataFrame, ddof: int = 1) -> DataFrame:
    """(i, j, v) of an aligned panel, both halves."""
    return mirrored(pair_moments(panel).select("i", "j", (F.col("s") * F.col("n") / (F.col("n") - ddof)).alias("v")))


def _with_sd(covariance: DataFrame) -> DataFrame:
    sd = covariance.where("i = j").select("i", F.sqrt("v").alias("si"))
    return covariance.join(sd, "i").join(sd.select(F.col("i").alias("j"), F.col("si").alias("sj")), "j")


def correlation(covariance: DataFrame) -> DataFrame:
    """Unit diagonal; 0 beside a zero variance."""
    rho = F.when(F.col("i") == F.col("j"), 1.0).when(F.col("si") * F.col("sj") == 0, 0.0).otherwise(F.col("v") / F.nullif(F.col("si") * F.col("sj"), F.lit(0.0)))
    return _with_sd(covariance).select("i", "j", rho.alias("v"))


def average_correlation(covariance: DataFrame) -> DataFrame:
    """(average_correlation): one row, 0 with fewer than two assets."""
    return correlation(covariance).where("i < j").agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("average_correlation"))


def constant_correlation_target(covariance: DataFrame) -> DataFrame:
    rho = average_correlation(covariance)
    v = F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(F.col("average_correlation") * F.col("si") * F.col("sj"))
    return _with_sd(covariance).crossJoin(F.broadcast(rho)).select("i", "j", v.alias("v"))  # rho is one row


def blend(sample: DataFrame, target: DataFrame, intensity: float) -> DataFrame:
    if not 0 <= intensity <= 1:
        raise ValueError("the intensity must lie in [0, 1]")
    both = sample.join(target.select("i", "j", F.col("v").alias("u")), ["i", "j"])
    return both.select("i", "j", (intensity * F.col("u") + (1 - intensity) * F.col("v")).alias("v"))


def _size() -> Column:
    """The product of a pair's deviations; the square roots first, so that tiny variances do not vanish."""
    return F.sqrt("sii") * F.sqrt("sjj")


def shrinkage(panel: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One row (periods, pi, rho, gamma, average_correlation, unclamped_intensity, intensity) of constant-correlation shrinkage of an aligned panel, from ML moments.

    rho and gamma are polynomials in the average correlation, so one pass over the pairs' moments gives their
    coefficients. A gamma within rounding of zero (always with two assets) counts as zero: sample and target are one, and the intensity is 1.
    """
    s, size, off = F.col("s"), _size(), F.col("i") < F.col("j")
    pi, ti, tj = F.col("xy2") - s * s, F.col("x3y") - F.col("sii") * s, F.col("xy3") - F.col("sjj") * s
    ratio = lambda a, b: F.sqrt(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)))
    over = lambda c: F.coalesce(F.sum(F.when(off, c)), F.lit(0.0))
    sums = (pair_moments(panel) if pairs is None else pairs).agg(
        F.max("n").alias("periods"), F.coalesce(F.avg(F.when(off, F.coalesce(F.try_divide(s, size), F.lit(0.0)))), F.lit(0.0)).alias("average_correlation"),
        F.sum(F.when(off, 2 * pi).otherwise(pi)).alias("pi"), F.coalesce(F.sum(F.when(~off, pi)), F.lit(0.0)).alias("own"),
        over(ratio("sjj", "sii") * ti + ratio("sii", "sjj") * tj).alias("cross"),
        (2 * over(size * size)).alias("g2"), (2 * over(size * s)).alias("g1"), (2 * over(s * s)).alias("g0"), F.count_if(off).alias("pairs"),
    )
    r = F.col("average_correlation")
    gamma = r * r * F.col("g2") - 2 * r * F.col("g1") + F.col("g0")
    gamma = F.when((F.col("pairs") <= 1) | (gamma <= 1e-14 * F.col("g0")), 0.0).otherwise(gamma)
    out = sums.select("periods", "pi", (F.col("own") + r * F.col("cross")).alias("rho"), gamma.alias("gamma"), "average_correlation")
    kappa = F.coalesce(F.try_divide(F.col("pi") - F.col("rho"), F.col("gamma") * F.col("periods")), F.lit(1.0))
    return out.withColumn("unclamped_intensity", kappa).withColumn("intensity", F.greatest(F.lit(0.0), F.least(F.lit(1.0), kappa))).withColumn("clamped", F.col("unclamped_intensity") != F.col("intensity"))


def ledoit_wolf(panel: DataFrame) -> DataFrame:
    """(i, j, v, sample, target, intensity): the unbiased covariance shrunk towards constant correlation; the pairs' moments are read twice, the panel once."""
    unbiased = F.col("n") / (F.col("n") - 1)
    pairs = cut(pair_moments(panel))
    k = shrinkage(panel, pairs).select("intensity", "average_correlation")
    rows = pairs.crossJoin(F.broadcast(k))  # k is one row
    sample = unbiased * F.col("s")
    target = F.when(F.col("i") == F.col("j"), sample).otherwise(unbiased * F.col("average_correlation") * _size())
    both = rows.select("i", "j", sample.alias("sample"), target.alias("target"), "intensity")
    return mirrored(both.select("i", "j", (F.col("intensity") * F.col("target") + (1 - F.col("intensity")) * F.col("sample")).alias("v"), "sample", "target", "intensity"))


def _weighted(covariance: DataFrame, weights: DataFrame) -> DataFrame:
    return covariance.join(weights.select(F.col("series").alias("i"), F.col("w").alias("wi")), "i").join(weights.select(F.col("series").alias("j"), F.col("w").alias("wj")), "j")


def quadratic_form(weights: DataFrame, covariance: DataFrame) -> DataFrame:
    """(variance): w' S w, one row."""
    return _weighted(covariance, weights).agg(F.sum(F.col("wi") * F.col("wj") * F.col("v")).alias("variance"))


portfolio_variance = quadratic_form


def matrix_vector(covariance: DataFrame, weights: DataFrame) -> DataFrame:
    """(i, value): S w."""
    return covariance.join(weights.select(F.col("series").alias("j"), "w"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("value"))


@dataclass(frozen=True)
class Diagnostics:
    assets: int
    observations: int
    condition_number: float
    smallest_eigenvalue: float
    largest_eigenvalue: float
    positive_semidefinite: bool
    observations_per_parameter: float

    @property
    def numerically_singular(self) -> bool:
        return self.smallest_eigenvalue <= self.largest_eigenvalue * 1e-14


def diagnose(covariance: DataFrame, observations: int) -> Diagnostics:
    _, m = matrix(covariance)
    values = linalg.eigenvalues(m)
    n = len(values)
    return Diagnostics(n, observations, linalg.condition_number(m), float(values[0]), float(values[-1]), linalg.is_positive_semidefinite(m), n * observations / (n * (n + 1) / 2))


def as_array(covariance: DataFrame) -> tuple[list, np.ndarray]:
    return matrix(covariance)
