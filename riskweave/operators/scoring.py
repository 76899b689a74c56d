"""Which of two adequate risk models is better: consistent scores and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import columns
from riskweave.operators.frames import by_time


def quantile_loss(forecasts: DataFrame, confidence: float, var: str = "var") -> DataFrame:
    """(series, t, score): (L - VaR) (c - 1{L < VaR}) with L = -r."""
    gap = -F.col("r") - F.col(var)
    return forecasts.select("series", "t", (gap * (confidence - (gap < 0).cast("double"))).alias("score"))


def fz0_loss(forecasts: DataFrame, confidence: float, var: str = "var", es: str = "es") -> DataFrame:
    """(series, t, score): the joint loss of value at risk and expected tail loss that is homogeneous of degree 0. Both must be positive."""
    v, e = F.col(var), F.col(es)
    ok = F.when((v > 0) & (e >= v), e).otherwise(F.raise_error("forecasts must satisfy 0 < var <= es"))
    return forecasts.select("series", "t", (F.greatest(-F.col("r") - v, F.lit(0.0)) / ((1 - confidence) * ok) + v / ok + F.ln(ok) - 1).alias("score"))


def mean_score(scores: DataFrame) -> DataFrame:
    return scores.groupBy("series").agg(F.avg("score").alias("mean"), F.count("*").alias("observations"))


def compare(first: DataFrame, second: DataFrame, lags: int | None = None) -> DataFrame:
    """(series, difference, standard_error, statistic, p_value, lags, naive_standard_error, observations, better): Diebold-Mariano with a Bartlett long-run variance.

    Autocovariances come from one self-join on the row number, as many rows per period as lags.
    """
    d = first.join(second.select("series", "t", F.col("score").alias("other")), ["series", "t"]).select("series", "t", (F.col("score") - F.col("other")).alias("d"))
    every = Window.partitionBy("series")
    d = d.select("series", F.row_number().over(by_time()).alias("k"), (F.col("d") - F.avg("d").over(every)).alias("c"), F.avg("d").over(every).alias("mean"), F.count("*").over(every).alias("n"))
    auto = F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))) if lags is None else F.lit(lags)
    d = d.withColumn("lags", F.least(auto, F.col("n") - 1).cast("int"))
    shifted = d.select("series", F.col("c").alias("c2"), F.explode(F.sequence(F.lit(0), F.col("lags"))).alias("lag"), F.col("k").alias("k2")).withColumn("k", F.col("k2") + F.col("lag"))
    bartlett = F.when(F.col("lag") == 0, 1.0).otherwise(2 * (1 - F.col("lag") / (F.col("lags") + 1)))
    s = d.join(shifted, ["series", "k"]).groupBy("series").agg(
        F.max("mean").alias("difference"), F.max("n").alias("observations"), F.max("lags").alias("lags"), (F.sum(bartlett * F.col("c") * F.col("c2")) / F.max("n")).alias("long"),
        (F.sum(F.when(F.col("lag") == 0, F.col("c") * F.col("c2"))) / F.max("n")).alias("short"),
    )
    n = F.col("observations")
    se = F.sqrt(F.greatest(F.col("long"), F.lit(0.0)) / n)
    out = s.withColumn("standard_error", se).withColumn("naive_standard_error", F.sqrt(F.col("short") / n)).withColumn("statistic", F.try_divide("difference", "standard_error"))
    p = 2 * columns.cdf(-F.abs("statistic"))
    return out.select("series", "difference", "standard_error", "statistic", p.alias("p_value"), "lags", "naive_standard_error", "observations", F.when(F.col("difference") < 0, 1).when(F.col("difference") > 0, 2).alias("better"))
