"""Portfolio risk when dependence is not elliptical: Gaussian and Student-t copulas."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from enum import StrEnum

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.errors import NoGaussianBaseline, NotIdentified
from riskweave.functions import linalg, special
from riskweave.operators.extreme import fit_tail
from riskweave.operators.frames import cut, matrix, need, require_rows
from riskweave.operators.historical import historical_risk
from riskweave.operators.ranks import elliptical_correlation, kendall_matrix, ranks_of
from riskweave.operators.series import aligned

# Fixed values.
MIN_COPULA_PATHS = 2000
MAX_COPULA_ASSETS = 40
MIN_COPULA_DEGREES = 2.0
MAX_COPULA_DEGREES = 100.0
COPULA_BATCHES = 20
GRID_POINTS = 14
DEGREES_TOLERANCE = 0.1
MIN_COPULA_OBSERVATIONS = 200
TAIL_FRACTION = 0.05


class Family(StrEnum):
    GAUSSIAN = "gaussian"
    STUDENT_T = "student_t"


class Marginal(StrEnum):
    EMPIRICAL = "empirical"
    EXTREME_VALUE = "extreme_value"


@dataclass(frozen=True)
class TailDependence:
    pair: tuple
    correlation: float
    coefficient: float

    is_asymptotically_independent = property(lambda self: self.coefficient <= 0)


def tail_dependence_coefficient(correlation: float, degrees_of_freedom: float | None) -> float:
    if degrees_of_freedom is None:
        return 0.0
    if correlation >= 1:
        return 1.0
    if correlation <= -1:
        return 0.0
    v = degrees_of_freedom
    return 2 * special.student_t_cdf(-math.sqrt((v + 1) * (1 - correlation) / (1 + correlation)), v + 1)


@dataclass(frozen=True)
class FittedCopula:
    family: Family
    names: list
    correlation: np.ndarray
    kendall: np.ndarray
    degrees_of_freedom: float | None
    observations: int
    log_likelihood: float
    gaussian_log_likelihood: float
    projected: bool

    assets = property(lambda self: len(self.names))
    likelihood_ratio = property(lambda self: 2 * (self.log_likelihood - self.gaussian_log_likelihood))

    def tail_dependence(self) -> tuple[TailDependence, ...]:
        n = self.assets
        return tuple(
            TailDependence((self.names[i], self.names[j]), float(self.correlation[i, j]), tail_dependence_coefficient(float(self.correlation[i, j]), self.degrees_of_freedom)) for i in range(n) for j in range(i + 1, n)
        )


def _quantiles(uniforms: np.ndarray, ppf) -> np.ndarray:
    """Quantiles of few distinct ranks: each is found once."""
    values, where = np.unique(uniforms, return_inverse=True)
    return np.array([ppf(float(u)) for u in values])[where].reshape(uniforms.shape)


def _half_log_determinant(lower: np.ndarray) -> float:
    return float(np.log(np.diag(lower)).sum())


def gaussian_copula_log_likelihood(uniforms, correlation) -> float:
    u = np.asarray(uniforms, float)
    lower = linalg.cholesky(correlation)
    z = _quantiles(u, special.normal_ppf)
    y = np.linalg.solve(lower, z.T)
    return float(-len(u) * _half_log_determinant(lower) - 0.5 * ((y * y).sum() - (z * z).sum()))


def student_t_copula_log_likelihood(uniforms, correlation, degrees_of_freedom: float) -> float:
    u, v = np.asarray(uniforms, float), degrees_of_freedom
    n, k = u.shape
    lower = linalg.cholesky(correlation)
    z = _quantiles(u, lambda p: special.student_t_ppf(p, v))
    y = np.linalg.solve(lower, z.T)
    const = math.lgamma((v + k) / 2) + (k - 1) * math.lgamma(v / 2) - k * math.lgamma((v + 1) / 2)
    return float(n * (const - _half_log_determinant(lower)) - (v + k) / 2 * np.log1p((y * y).sum(axis=0) / v).sum() + (v + 1) / 2 * np.log1p(z * z / v).sum())


def pseudo_observations(panel: DataFrame) -> DataFrame:
    """(series, t, u): rank / (n + 1); tied values share their mean rank."""
    return ranks_of(panel).select("series", "t", (F.col("rank") / (F.count("*").over(Window.partitionBy("series")) + 1)).alias("u"))


def _periods(panel: DataFrame) -> DataFrame:
    """(u): an array of each period's uniforms in the order of the names, evaluated once."""
    by_name = F.transform(F.array_sort(F.collect_list(F.struct("series", "u"))), lambda x: x["u"])
    return cut(pseudo_observations(panel).groupBy("t").agg(by_name.alias("u")).select("u"))


def log_likelihoods(periods: DataFrame, correlation: np.ndarray, degrees: list[float | None]) -> tuple[int, list[float]]:
    """How many periods there are, and the log likelihood for each number of degrees (None: Gaussian), in one job: sums over blocks of periods, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            own = [gaussian_copula_log_likelihood(u, correlation) if v is None else student_t_copula_log_likelihood(u, correlation, v) for v in degrees]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int32()), pa.array(own), pa.array([len(u)] * len(own), pa.int64())], names=["k", "value", "n"])

    sums = periods.mapInArrow(run, "k int, value double, n bigint").groupBy("k").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()  # a row for each number of degrees
    value = {r["k"]: r["value"] for r in sums}
    return max((r["n"] for r in sums), default=0), [value.get(k, 0.0) for k in range(len(degrees))]


def fit_copula(panel: DataFrame, family: Family = Family.STUDENT_T, degrees_of_freedom: float | None = None) -> FittedCopula:
    """Kendall's matrix and the profile over degrees are plans: a grid of degrees is one pass over the periods, and each narrower grid another. Only matrices of at most 40 assets come to the driver."""
    panel = aligned(panel)
    names, tau = matrix(kendall_matrix(panel))
    need(2 <= len(names) <= MAX_COPULA_ASSETS, NotIdentified, f"a copula needs 2 to {MAX_COPULA_ASSETS} assets")
    rho, projected = elliptical_correlation(tau)
    periods = _periods(panel)
    n, (gauss,) = log_likelihoods(periods, rho, [None])
    require_rows(n, MIN_COPULA_OBSERVATIONS, "a copula")
    if family == Family.GAUSSIAN:
        return FittedCopula(family, names, rho, tau, None, n, gauss, gauss, projected)
    if degrees_of_freedom is None:
        low, high = MIN_COPULA_DEGREES, MAX_COPULA_DEGREES
        while high - low > DEGREES_TOLERANCE:
            grid = np.geomspace(low, high, GRID_POINTS).tolist()
            best = int(np.argmax(log_likelihoods(periods, rho, grid)[1]))
            low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
        degrees_of_freedom = (low + high) / 2
    return FittedCopula(family, names, rho, tau, degrees_of_freedom, n, log_likelihoods(periods, rho, [degrees_of_freedom])[1][0], gauss, projected)


def _draws(ids: np.ndarray, seed: int, lower: np.ndarray, degrees: float | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Correlated normals of each path, and what divides them for the t copula."""
    z, w = np.empty((len(ids), len(lower))), np.empty(len(ids))
    for row, path in enumerate(ids.tolist()):
        g = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), path]))
        z[row] = g.standard_normal(len(lower))
        w[row] = g.chisquare(degrees) / degrees if degrees else 1.0
    return z @ lower.T, np.sqrt(w)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([special.normal_cdf(v) for v in x.ravel()]).reshape(x.shape)


def _t_cdf(x: np.ndarray, degrees: float) -> np.ndarray:
    """By interpolation in a fine table of the distribution function, finer towards the tails."""
    grid = np.sinh(np.linspace(-12, 12, 4001))
    table = np.array([special.student_t_cdf(float(g), degrees) for g in grid])
    return np.clip(np.interp(x, grid, table), 1e-12, 1 - 1e-12)


def simulate_copula(spark: SparkSession, fitted: FittedCopula, paths: int = 10_000, seed: int = 0) -> DataFrame:
    """(path, u): an array of uniforms per path, in the order of the fitted names."""
    lower, degrees = linalg.cholesky(fitted.correlation), fitted.degrees_of_freedom

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            z, w = _draws(ids, seed, lower, degrees)
            u = _t_cdf(z / w[:, None], degrees) if degrees else _normal_cdf(z)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(u), pa.list_(pa.float64()))], names=["path", "u"])

    return spark.range(paths).mapInArrow(run, "path bigint, u array<double>")


def joint_exceedance_rate(uniforms: DataFrame, quantile: float = 0.01) -> DataFrame:
    return uniforms.agg(F.avg(F.forall("u", lambda x: x <= quantile).cast("double")).alias("rate"))


@dataclass(frozen=True)
class CopulaRisk:
    value_at_risk: float
    expected_tail_loss: float
    gaussian_value_at_risk: float
    gaussian_expected_tail_loss: float
    copula: FittedCopula
    marginal: Marginal
    paths: int
    weights: tuple
    standard_error: float

    @property
    def tail_dependence_premium(self) -> float:
        if not self.gaussian_expected_tail_loss:
            raise NoGaussianBaseline("the Gaussian copula shows no tail loss")
        return (self.expected_tail_loss - self.gaussian_expected_tail_loss) / self.gaussian_expected_tail_loss


def copula_risk(
    panel: DataFrame, weights: dict, confidence: float = 0.99, family: Family = Family.STUDENT_T, marginal: Marginal = Marginal.EMPIRICAL, degrees_of_freedom: float | None = None, paths: int = 40_000, seed: int = 0,
) -> CopulaRisk:
    """The fitted and the Gaussian copula on common random numbers, through the assets' own marginals; paths are rows."""
    need(paths >= MIN_COPULA_PATHS, NotIdentified, f"at least {MIN_COPULA_PATHS} paths")
    spark = panel.sparkSession
    panel = aligned(panel).cache()
    fitted = fit_copula(panel, family, degrees_of_freedom)
    sample = {r["series"]: np.array(r["x"]) for r in panel.groupBy("series").agg(F.array_sort(F.collect_list("r")).alias("x")).collect()}
    xs = [sample[n] for n in fitted.names]
    tails = [fit_tail(-x, tail_fraction=TAIL_FRACTION) if marginal == Marginal.EXTREME_VALUE else None for x in xs]
    w = np.array([float(weights[n]) for n in fitted.names])
    lower, degrees = linalg.cholesky(fitted.correlation), fitted.degrees_of_freedom

    def returns(u: np.ndarray) -> np.ndarray:
        total = np.zeros(len(u))
        for k, (x, tail) in enumerate(zip(xs, tails, strict=True)):
            r = np.interp(u[:, k] * (len(x) - 1), np.arange(len(x)), x)
            if tail is not None:
                deep = u[:, k] < tail.exceedance_probability
                r[deep] = [-tail.quantile(1 - float(p)) for p in u[deep, k]]
            total += w[k] * r
        return total

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            z, scale = _draws(ids, seed, lower, degrees)
            gauss = returns(_normal_cdf(z))
            own = returns(_t_cdf(z / scale[:, None], degrees)) if degrees else gauss
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(own), pa.array(gauss)], names=["path", "own", "gauss"])

    sim = spark.range(paths).mapInArrow(run, "path bigint, own double, gauss double")
    rows = sim.select(F.explode(F.array(
        F.struct(F.lit("own").alias("series"), F.col("own").alias("r"), F.col("path").alias("t")), F.struct(F.lit("gauss").alias("series"), F.col("gauss").alias("r"), F.col("path").alias("t")),
        F.struct(F.concat(F.lit("batch "), F.floor(F.col("path") * COPULA_BATCHES / paths).cast("string")).alias("series"), F.col("own").alias("r"), F.col("path").alias("t")),
    )).alias("x")).select("x.*")
    risk = {r["series"]: r for r in historical_risk(rows, confidence).collect()}
    batch = [r["value_at_risk"] for k, r in risk.items() if k.startswith("batch")]
    return CopulaRisk(
        risk["own"]["value_at_risk"], risk["own"]["expected_tail_loss"], risk["gauss"]["value_at_risk"], risk["gauss"]["expected_tail_loss"], fitted, marginal, paths, tuple(w),
        float(np.std(batch, ddof=1) / math.sqrt(len(batch))),
    )
