"""Risk read from the sample: quantiles, tail means, bootstrap intervals, EWMA filtering, subadditivity."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.errors import OutOfDomain
from riskweave.operators.frames import need, of_series
from riskweave.operators.recursion import affine

# Fixed values.
DEFAULT_DECAY = 0.94
DEFAULT_RESAMPLES = 2000


class QuantileMethod(StrEnum):
    LOWER = "lower"
    HIGHER = "higher"
    LINEAR = "linear"
    WEIBULL = "weibull"


def _pick(ordered: Column, p: float, method: QuantileMethod) -> Column:
    """A quantile of a sorted array."""
    n = F.size(ordered)
    h = n * p + p - 1 if method == QuantileMethod.WEIBULL else (n - 1) * F.lit(p)
    h = F.greatest(F.lit(0.0), F.least(h.cast("double"), (n - 1).cast("double")))
    low, high = F.floor(h), F.ceil(h)
    at = lambda k: F.element_at(ordered, (k + 1).cast("int"))
    if method == QuantileMethod.LOWER:
        return at(low)
    if method == QuantileMethod.HIGHER:
        return at(high)
    return at(low) + (h - low) * (at(high) - at(low))


def empirical_quantile(panel: DataFrame, probability: float, method: QuantileMethod = QuantileMethod.LINEAR, value: str = "r") -> DataFrame:
    """(series, quantile)."""
    need(0 <= probability <= 1, OutOfDomain, "a probability must lie in [0, 1]")
    if method == QuantileMethod.LINEAR:
        return panel.groupBy("series").agg(F.percentile(value, F.lit(probability)).alias("quantile"))
    return panel.groupBy("series").agg(_pick(F.array_sort(F.collect_list(value)), probability, method).alias("quantile"))


#: Ranks of an approximate quantile are off by at most n / ACCURACY; series of at most EXACT times that are ranked whole.
ACCURACY, EXACT = 10_000, 5


def ranked(panel: DataFrame, value: str = "r", upto: float | None = None) -> DataFrame:
    """The panel with ``rn`` (1 = worst) and ``n`` per series: one sort that every tail measure reads.

    With ``upto`` only the worst rows matter: all of rank up to ``upto`` * n + 2 are there, and of a long series few more.
    An approximate quantile above that bounds them, so a hot series is never sorted whole.
    """
    order = Window.partitionBy("series").orderBy(value, *(["t"] if "t" in panel.columns else []))
    place = F.row_number().over(order).cast("bigint")
    if upto is None:
        return panel.withColumn("rn", place).withColumn("n", F.count("*").over(of_series()))
    over = min(1.0, upto + 2 / ACCURACY)
    bound = F.when(F.count("*") > EXACT * ACCURACY, F.percentile_approx(value, F.lit(over), F.lit(ACCURACY)))
    sizes = panel.groupBy("series").agg(F.count("*").alias("n"), bound.alias("__bound"))
    return panel.join(sizes, "series").where(F.col("__bound").isNull() | (F.col(value) <= F.col("__bound"))).drop("__bound").withColumn("rn", place)


def tail_weight(probability: float) -> Column:
    """The part of the rn-th worst of n observations inside the tail of mass n * probability (the last one fractional)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("n") * probability - (F.col("rn") - 1)))


def sample_expected_tail_loss(panel: DataFrame, probability: float, value: str = "r") -> DataFrame:
    """(series, tail_mean, used): mean of the worst n * probability observations, the last one in part."""
    w = tail_weight(probability)
    return ranked(panel, value, probability).where(F.col("rn") - 1 < F.col("n") * probability).groupBy("series").agg((F.sum(w * F.col(value)) / F.sum(w)).alias("tail_mean"), F.count("*").alias("used"))


def historical_risk(panel: DataFrame, confidence: float = 0.99, method: QuantileMethod = QuantileMethod.LINEAR, value: str = "r") -> DataFrame:
    """(series, value_at_risk, expected_tail_loss, quantile, observations, tail_observations, effective_sample)."""
    need(0 < confidence < 1, OutOfDomain, "a confidence must lie strictly between 0 and 1")
    alpha = 1 - confidence
    w = tail_weight(alpha)
    sums = [F.max("n").alias("observations"), (F.sum(w * F.col(value)) / F.sum(w)).alias("tail_mean"), F.sum((w > 0).cast("bigint")).alias("tail_observations")]
    rows = ranked(panel, value, alpha if method == QuantileMethod.LINEAR else None)
    if method == QuantileMethod.LINEAR:
        h = (F.col("n") - 1) * alpha
        low, part = F.floor(h), h - F.floor(h)
        quantile = F.sum(F.when(F.col("rn") - 1 == low, (1 - part) * F.col(value)).when(F.col("rn") - 2 == low, part * F.col(value)).otherwise(0.0))
    else:
        quantile = _pick(F.array_sort(F.collect_list(value)), alpha, method)
    out = rows.groupBy("series").agg(quantile.alias("quantile"), *sums)
    return out.select(
        "series", (-F.col("quantile")).alias("value_at_risk"), (-F.col("tail_mean")).alias("expected_tail_loss"), "quantile", F.lit(confidence).alias("confidence"),
        "observations", "tail_observations", (F.col("observations") * alpha).alias("effective_sample"),
    )


def bootstrap_interval(
    panel: DataFrame, confidence: float = 0.99, level: float = 0.95, resamples: int = DEFAULT_RESAMPLES, seed: int = 0, of_expected_tail_loss: bool = False,
) -> DataFrame:
    """(series, estimate, lower, upper, level, resamples, width, relative_width): percentile bootstrap.

    Draws are hashes of (seed, resample, draw), so they do not depend on the partitioning; each resample is one row
    group of a series, and the series' sorted values ride along as an array of its periods.
    """
    alpha = 1 - confidence
    base = panel.groupBy("series").agg(F.array_sort(F.collect_list("r")).alias("xs")).withColumn("n", F.size("xs"))
    runs = base.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    draw = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.element_at("xs", (F.pmod(F.xxhash64(F.lit(seed), F.col("b"), i), F.col("n")) + 1).cast("int")))
    runs = runs.repartition("series", "b").select("series", "b", "n", F.array_sort(draw).alias("ys"))
    if of_expected_tail_loss:
        m = F.col("n") * alpha
        stat = -F.aggregate(F.transform("ys", lambda y, i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), m - i)) * y), F.lit(0.0), lambda a, x: a + x) / m
        point = sample_expected_tail_loss(panel, alpha).select("series", (-F.col("tail_mean")).alias("estimate"))
    else:
        stat = -_pick(F.col("ys"), alpha, QuantileMethod.LINEAR)
        point = empirical_quantile(panel, alpha).select("series", (-F.col("quantile")).alias("estimate"))
    ends = runs.select("series", stat.alias("s")).groupBy("series").agg(F.percentile("s", F.lit((1 - level) / 2)).alias("lower"), F.percentile("s", F.lit((1 + level) / 2)).alias("upper"))
    out = point.join(ends, "series")
    width = F.col("upper") - F.col("lower")
    return out.select("series", "estimate", "lower", "upper", F.lit(level).alias("level"), F.lit(resamples).alias("resamples"), width.alias("width"), F.try_divide(width, F.abs("estimate")).alias("relative_width"))


def ewma_volatility(panel: DataFrame, decay: float = DEFAULT_DECAY) -> DataFrame:
    """(series, t, r, volatility, next_volatility): the forecast made before each return, seeded with the whole sample's ML variance."""
    run = affine(panel, (1 - decay) * F.col("r") * F.col("r"), decay, F.var_pop("r"))
    return run.select("series", "t", "r", F.sqrt("v").alias("volatility"), F.sqrt("next_v").alias("next_volatility"))


def filtered_historical_risk(panel: DataFrame, confidence: float = 0.99, decay: float = DEFAULT_DECAY, volatilities: DataFrame | None = None) -> DataFrame:
    """Historical risk of returns rescaled to current volatility; ``volatilities`` (series, t, r, volatility, next_volatility) replaces the EWMA filter."""
    path = ewma_volatility(panel, decay) if volatilities is None else volatilities
    last = F.max_by("next_volatility", "t").over(of_series())
    mean = F.sqrt(F.avg(F.col("volatility") * F.col("volatility")).over(of_series()))
    scaled = path.select("series", "t", F.when(F.col("volatility") == 0, 0.0).otherwise(F.col("r") / F.col("volatility") * last).alias("r"), last.alias("current"), mean.alias("average"))
    vols = scaled.groupBy("series").agg(F.max("current").alias("current_volatility"), F.max("average").alias("average_volatility"))
    return historical_risk(scaled, confidence).join(vols, "series").withColumn("scaling", F.try_divide(F.col("current_volatility"), F.col("average_volatility")))


def check_subadditivity(panel: DataFrame, confidence: float = 0.99, expected_tail_loss: bool = False) -> DataFrame:
    """(measure, combined, sum_of_parts, penalty, subadditive): the risk of the per-period sum against the sum of risks."""
    measure = "expected_tail_loss" if expected_tail_loss else "value_at_risk"
    both = panel.select(F.lit("part").alias("kind"), "series", "t", "r").unionByName(panel.groupBy("t").agg(F.sum("r").alias("r")).select(F.lit("sum").alias("kind"), F.lit("\x00sum").alias("series"), "t", "r"))
    risk = historical_risk(both.select("series", "t", "r"), confidence)
    total = F.sum(F.when(F.col("series") == "\x00sum", F.col(measure)).otherwise(0.0))
    parts = F.sum(F.when(F.col("series") != "\x00sum", F.col(measure)).otherwise(0.0))
    out = risk.agg(total.alias("combined"), parts.alias("sum_of_parts"))
    return out.select(F.lit(measure).alias("measure"), "combined", "sum_of_parts", (F.col("combined") - F.col("sum_of_parts")).alias("penalty"), (F.col("combined") <= F.col("sum_of_parts") * (1 + 1e-12) + 1e-15).alias("subadditive"))


def as_risk(estimate: DataFrame) -> DataFrame:
    """Historical risk in the columns of parametric risk."""
    return estimate.select("series", "value_at_risk", "expected_tail_loss", "quantile", "confidence", F.lit("historical").alias("distribution"), F.lit(1.0).alias("horizon"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("volatility"))


def with_tail_probability(estimate: DataFrame) -> DataFrame:
    """Adds tail_probability, 1 - confidence, to any risk frame (historical, extreme)."""
    return estimate.withColumn("tail_probability", 1 - F.col("confidence"))
