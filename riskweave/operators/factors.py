"""Factor models: exposures by regression per asset, implied covariance, risk attribution."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.errors import TooShort
from riskweave.functions import linalg
from riskweave.operators.covariance import mirrored, sample_covariance
from riskweave.operators.frames import cut, need
from riskweave.operators.gram import pair_moments
from riskweave.operators.recursion import CHUNK, chunked


def single_factor(assets: DataFrame, factor: DataFrame) -> DataFrame:
    """(series, beta, alpha, r_squared, observations, specific_variance, durbin_watson) against one factor (t, f): native aggregates and one lag window."""
    both = assets.join(factor.select("t", "f"), "t")
    fit = both.groupBy("series").agg(F.regr_slope("r", "f").alias("beta"), F.regr_intercept("r", "f").alias("alpha"), F.regr_r2("r", "f").alias("r_squared"), F.count("*").alias("observations"))
    e = both.join(fit, "series").withColumn("e", F.col("r") - F.col("alpha") - F.col("beta") * F.col("f"))
    step = F.col("e") - F.lag("e").over(Window.partitionBy("series").orderBy("t"))
    rest = e.withColumn("d", step).groupBy("series").agg(F.sum(F.col("e") * F.col("e")).alias("sse"), F.sum(F.col("d") * F.col("d")).alias("ssd"))
    return fit.join(rest, "series").select("series", "beta", "alpha", "r_squared", "observations", (F.col("sse") / (F.col("observations") - 2)).alias("specific_variance"), F.try_divide("ssd", "sse").alias("durbin_watson"))


@dataclass(frozen=True)
class Regression:
    """One asset on its factors; ``names`` are the factors, betas in their order."""

    asset: str
    names: tuple
    alpha: float
    betas: np.ndarray
    residuals: np.ndarray
    specific_variance: float
    standard_errors: np.ndarray
    r_squared: float
    intercept: bool

    @property
    def degrees_of_freedom(self) -> int:
        return len(self.residuals) - len(self.betas) - self.intercept

    @property
    def specific_volatility(self) -> float:
        return float(np.sqrt(self.specific_variance))

    @property
    def adjusted_r_squared(self) -> float:
        n = len(self.residuals)
        return 1 - (1 - self.r_squared) * (n - self.intercept) / self.degrees_of_freedom

    @property
    def t_statistics(self) -> np.ndarray:
        coef = np.append([self.alpha] if self.intercept else [], self.betas)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.standard_errors > 0, coef / self.standard_errors, np.where(coef == 0, 0.0, np.sign(coef) * np.inf))

    @property
    def durbin_watson(self) -> float:
        e = self.residuals
        total = float(e @ e)
        return float((np.diff(e) ** 2).sum() / total) if total else float("nan")

    def beta(self, factor: str) -> float:
        return float(self.betas[self.names.index(factor)])

    def fitted(self, exposures) -> float:
        return float(self.alpha + self.betas @ np.asarray(exposures, float))


def regress(asset, factors, *, names=None, asset_name: str = "asset", intercept: bool = True) -> Regression:
    """OLS by QR of a vector on the columns of a matrix (rows are periods)."""
    y, x = np.asarray(asset, float), np.asarray(factors, float).reshape(len(asset), -1)
    design = np.column_stack([np.ones(len(y)), x]) if intercept else x
    need(len(y) > design.shape[1], TooShort, "a regression needs more periods than coefficients")
    coef, r = linalg.least_squares(design, y)
    e = y - design @ coef
    s2 = float(e @ e / (len(y) - design.shape[1]))
    centred = y - y.mean() if intercept else y
    total = float(centred @ centred)
    se = np.sqrt(np.maximum(0, s2 * np.diag(linalg.upper_inverse_gram(r))))
    return Regression(asset_name, tuple(names or range(x.shape[1])), float(coef[0]) if intercept else 0.0, coef[1:] if intercept else coef, e, s2, se, 1 - float(e @ e) / total if total else 0.0, intercept)


#: What is left of a chunk of periods: the triangles of [1, factors, return] and of its differences, and its two ends.
_PART = "series {0}, chunk bigint, n bigint, levels array<double>, steps array<double>, first array<double>, last array<double>"
_FIT = "series {0}, factor string, beta double, alpha double, specific_variance double, r_squared double, durbin_watson double, observations bigint"


def _reducer(intercept: bool):
    """The triangular factor of a chunk's design and return side by side: as good as its rows for any regression on them."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        table = table.take(pc.sort_indices(table, sort_keys=[("t", "ascending")]))
        y = np.asarray(table["r"].combine_chunks())
        x = np.asarray(table["fs"].combine_chunks().flatten()).reshape(len(y), -1)
        both = np.column_stack([x, y])
        levels = np.linalg.qr(np.column_stack([np.ones(len(y)), both]) if intercept else both, mode="r")
        steps = np.linalg.qr(np.diff(both, axis=0), mode="r") if len(y) > 1 else np.zeros((0, both.shape[1]))
        lists = [pa.ListArray.from_arrays(pa.array([0, m.size], pa.int32()), pa.array(m.ravel())) for m in (levels, steps, both[0], both[-1])]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], table.schema.field("series").type), pa.array([key[1].as_py()], pa.int64()), pa.array([len(y)], pa.int64()), *lists], names=["series", "chunk", "n", "levels", "steps", "first", "last"])

    return run


def _solver(names: list[str], intercept: bool):
    """One regression from the triangles of its chunks, stacked."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        parts = sorted(table.to_pylist(), key=lambda p: p["chunk"])
        k, width = len(names), len(names) + intercept
        levels = np.concatenate([np.reshape(p["levels"], (-1, width + 1)) for p in parts])
        between = [np.subtract(b["first"], a["last"]) for a, b in zip(parts, parts[1:], strict=False)]
        steps = np.concatenate([np.reshape(p["steps"], (-1, k + 1)) for p in parts] + [np.reshape(between, (-1, k + 1))])
        n = sum(p["n"] for p in parts)
        need(n > width, TooShort, "a regression needs more periods than coefficients")
        levels = np.linalg.qr(levels, mode="r")
        levels = np.vstack([levels, np.zeros((width + 1 - len(levels), width + 1))])
        coef, _ = linalg.least_squares(levels[:, :width], levels[:, width])
        rest = levels[:, width] - levels[:, :width] @ coef
        sse, total = float(rest @ rest), float((levels[intercept:, width] ** 2).sum())
        betas, alpha = (coef[1:], float(coef[0])) if intercept else (coef, 0.0)
        moves = steps[:, k] - steps[:, :k] @ betas
        one = [alpha, sse / (n - width), 1 - sse / total if total else 0.0, float(moves @ moves) / sse if sse else float("nan")]
        columns = [pa.array([key[0].as_py()] * k, table.schema.field("series").type), pa.array(names), pa.array(betas), *(pa.array([x] * k, pa.float64()) for x in one), pa.array([n] * k, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["series", "factor", "beta", "alpha", "specific_variance", "r_squared", "durbin_watson", "observations"])

    return run


def fit_factor_model(assets: DataFrame, factors: DataFrame, intercept: bool = True) -> FactorModel:
    """One regression per asset over the periods that it and all factors have. Chunks of periods are reduced to triangles, whose stack is solved per asset, so a long series is many tasks."""
    names = sorted(r[0] for r in factors.select("series").distinct().collect())
    by_name = F.transform(F.array_sort(F.collect_list(F.struct("series", "r"))), lambda x: x["r"])
    arrays = factors.where("r is not null").groupBy("t").agg(by_name.alias("fs")).where(F.size("fs") == len(names))
    rows = assets.select("series", "t", "r").where("r is not null")
    both = chunked(rows, CHUNK).join(arrays, "t").select("series", "chunk", "t", "r", "fs")
    kind = assets.schema["series"].dataType.simpleString()
    parts = both.groupBy("series", "chunk").applyInArrow(_reducer(intercept), _PART.format(kind))
    exposures = cut(parts.groupBy("series").applyInArrow(_solver(names, intercept), _FIT.format(kind)))  # a row for each asset and factor
    return FactorModel(exposures, factors, both.drop("chunk"), names)


class FactorModel:
    """exposures (series, factor, beta, alpha, specific_variance, ...), the factors' panel and the rows they were fitted on."""

    def __init__(self, exposures: DataFrame, panel: DataFrame, rows: DataFrame, factors: list[str]) -> None:
        self.exposures, self.panel, self.rows, self.factor_names = exposures, panel, rows, factors

    @cached_property
    def covariance(self) -> DataFrame:
        """(i, j, v) of the factors, evaluated once."""
        return cut(sample_covariance(self.panel))

    @property
    def assets(self) -> int:
        return self.exposures.select("series").distinct().count()

    @property
    def factors(self) -> int:
        return len(self.factor_names)

    def regression(self, name: str) -> DataFrame:
        return self.exposures.where(F.col("series") == name)

    def portfolio_exposures(self, weights: DataFrame) -> DataFrame:
        """(series, w): series are the factors, so it serves as weights of the factor covariance."""
        return self.exposures.join(weights, "series").groupBy("factor").agg(F.sum(F.col("w") * F.col("beta")).alias("w")).withColumnRenamed("factor", "series")

    def specific(self) -> DataFrame:
        return self.exposures.groupBy("series").agg(F.max("specific_variance").alias("d"))

    def implied_covariance(self) -> DataFrame:
        b = self.exposures.select("series", "factor", "beta")
        left = b.select(F.col("series").alias("a"), F.col("factor").alias("i"), F.col("beta").alias("x"))
        right = b.select(F.col("series").alias("c"), F.col("factor").alias("j"), F.col("beta").alias("y"))
        common = self.covariance.join(left, "i").join(right, "j").groupBy("a", "c").agg(F.sum(F.col("x") * F.col("v") * F.col("y")).alias("v"))
        own = self.specific().select(F.col("series").alias("a"), F.col("series").alias("c"), F.col("d").alias("v"))
        return common.unionByName(own).groupBy("a", "c").agg(F.sum("v").alias("v")).select(F.col("a").alias("i"), F.col("c").alias("j"), "v")

    def residuals(self) -> DataFrame:
        """(series, t, r): a panel of residuals."""
        betas = self.exposures.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("factor", "beta"))), lambda x: x["beta"]).alias("bs"), F.max("alpha").alias("alpha"))
        dot = F.aggregate(F.zip_with("bs", "fs", lambda b, f: b * f), F.lit(0.0), lambda s, x: s + x)
        return self.rows.join(betas, "series").select("series", "t", (F.col("r") - F.col("alpha") - dot).alias("r"))

    def residual_correlations(self) -> DataFrame:
        both = mirrored(pair_moments(self.residuals()).select("i", "j", "s", (F.sqrt("sii") * F.sqrt("sjj")).alias("size")))
        return both.select("i", "j", F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.coalesce(F.try_divide("s", "size"), F.lit(0.0))).alias("v"))

    def worst_residual_correlation(self) -> DataFrame:
        return self.residual_correlations().where("i < j").orderBy(F.desc(F.abs("v")), "i", "j").limit(1)


def attribute_risk(weights: DataFrame, model: FactorModel) -> DataFrame:
    """(factor, exposure, component, total, factor_volatility, specific_volatility, factor_share); the components and specific_volatility**2 / total add to total."""
    x = model.portfolio_exposures(weights)
    fx = model.covariance.join(x.select(F.col("series").alias("j"), "w"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("w")).alias("fx")).withColumnRenamed("i", "series")
    spec = model.specific().join(weights, "series").agg(F.sum(F.col("w") * F.col("w") * F.col("d")).alias("s2"))
    parts = x.join(fx, "series").select("series", "w", "fx", F.lit(0.0).alias("s2")).unionByName(spec.select(F.lit(None).cast("string").alias("series"), F.lit(0.0).alias("w"), F.lit(0.0).alias("fx"), "s2"))
    whole = Window.partitionBy(F.lit(0))  # a row for each factor, and one
    rows = parts.withColumn("f2", F.sum(F.col("w") * F.col("fx")).over(whole)).withColumn("s2", F.sum("s2").over(whole)).where("series is not null").withColumn("total", F.sqrt(F.col("f2") + F.col("s2")))
    return rows.select(
        F.col("series").alias("factor"), F.col("w").alias("exposure"), F.try_divide(F.col("w") * F.col("fx"), F.col("total")).alias("component"), "total",
        F.sqrt("f2").alias("factor_volatility"), F.sqrt("s2").alias("specific_volatility"), F.try_divide(F.col("f2"), F.col("f2") + F.col("s2")).alias("factor_share"),
    )


def attribution_identity(attribution: DataFrame) -> DataFrame:
    """One row (total, factor_contribution, specific_contribution, sum_of_parts, identity_error)."""
    specific = F.try_divide(F.max("specific_volatility") * F.max("specific_volatility"), F.max("total"))
    sums = attribution.agg(F.max("total").alias("total"), F.sum("component").alias("factor_contribution"), specific.alias("specific_contribution"))
    sums = sums.withColumn("sum_of_parts", F.col("factor_contribution") + F.col("specific_contribution"))
    return sums.withColumn("identity_error", F.abs(F.col("sum_of_parts") - F.col("total")))


def attribution_of(attribution: DataFrame, factor: str) -> float:
    """One factor's component."""
    found = attribution.where(F.col("factor") == factor).select("component").first()
    need(found is not None, KeyError, factor)
    return found[0]


def largest_factor(attribution: DataFrame) -> DataFrame:
    """One row (factor, component): the largest in absolute size; ties go to the first name."""
    return attribution.orderBy(F.desc(F.abs("component")), "factor").limit(1).select("factor", "component")


__all__ = ["FactorModel", "Regression", "attribute_risk", "attribution_identity", "attribution_of", "fit_factor_model", "largest_factor", "regress", "single_factor"]
