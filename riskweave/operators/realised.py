"""Volatility from whole bars. A bar frame is (series, t, open, high, low, close)."""

from __future__ import annotations

import math
from enum import StrEnum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.errors import BadBar
from riskweave.operators.frames import by_time, need

# Fixed value: the mean overshoot of a discretely watched Brownian path.
OVERSHOOT = 0.5825971579390106


class Estimator(StrEnum):
    CLOSE_TO_CLOSE = "close_to_close"
    PARKINSON = "parkinson"
    GARMAN_KLASS = "garman_klass"
    ROGERS_SATCHELL = "rogers_satchell"
    GARMAN_KLASS_YANG_ZHANG = "garman_klass_yang_zhang"
    YANG_ZHANG = "yang_zhang"


def bars_from_ticks(ticks: DataFrame, order: list[str], price: str = "price") -> DataFrame:
    """(series, t, open, high, low, close): first, highest, lowest and last price of each period, ticks ordered by ``order``."""
    key = F.struct(*order)
    return ticks.groupBy("series", "t").agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"))


def checked_bars(bars: DataFrame) -> DataFrame:
    """The bars; one that is not positive or not ordered fails in the plan."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    good = (lo > 0) & (h >= F.greatest(o, c)) & (lo <= F.least(o, c)) & (h < float("inf"))
    return bars.withColumn("low", F.when(good, lo).otherwise(F.raise_error(F.concat(F.lit("not a bar: "), F.to_json(F.struct(o, h, lo, c))))))


def bars_from_rows(spark: SparkSession, name: str, rows) -> DataFrame:
    """(series, t, open, high, low, close) of (open, high, low, close) rows; the first that is no bar is named by its position."""
    built = []
    for t, row in enumerate(rows):
        need(len(row) == 4, BadBar, f"{name}: row {t} has {len(row)} values, expected 4")
        o, h, lo, c = map(float, row)
        need(0 < lo <= min(o, c) <= max(o, c) <= h < math.inf, BadBar, f"{name}: row {t} is not a bar")
        built.append((name, t, o, h, lo, c))
    need(bool(built), BadBar, f"{name}: no bars")
    return spark.createDataFrame(built, "series string, t bigint, open double, high double, low double, close double")


class Bars:
    """A bar frame with its length, its bars in order of time and its closes."""

    def __init__(self, frame: DataFrame) -> None:
        self.frame = checked_bars(frame)

    @classmethod
    def from_rows(cls, spark: SparkSession, name: str, rows) -> Bars:
        return cls(bars_from_rows(spark, name, rows))

    def __len__(self) -> int:
        return self.frame.count()

    def __iter__(self):
        return iter(self.frame.orderBy("series", "t").toLocalIterator())

    @property
    def closes(self) -> DataFrame:
        """(series, t, close)."""
        return self.frame.select("series", "t", "close")

    def overnight(self) -> DataFrame:
        return overnight(self.frame)


def overnight(bars: DataFrame) -> DataFrame:
    """Adds ``gap``, ln(open / previous close); null in the first bar."""
    return bars.withColumn("gap", F.ln(F.col("open") / F.lag("close").over(by_time())))


def realised_variances(bars: DataFrame) -> DataFrame:
    """(series, bars, one column per estimator): all six per-period variances in one pass; null where there are too few bars."""
    ln2 = math.log(2)
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    hl, co, ho, lo_ = F.ln(h / lo), F.ln(c / o), F.ln(h / o), F.ln(lo / o)
    rows = overnight(checked_bars(bars)).select(
        "series", "gap", co.alias("co"), (F.col("gap") + co).alias("cc"), (hl * hl / (4 * ln2)).alias("pk"), (0.5 * hl * hl - (2 * ln2 - 1) * co * co).alias("gk"), (ho * (ho - co) + lo_ * (lo_ - co)).alias("rs"),
    )
    later = F.col("gap").isNotNull()
    agg = rows.groupBy("series").agg(
        F.count("*").alias("bars"), F.var_samp("cc").alias("close_to_close"), F.avg("pk").alias("parkinson"), F.avg("gk").alias("garman_klass"), F.avg("rs").alias("rogers_satchell"),
        F.avg(F.when(later, F.col("gk") + F.col("gap") * F.col("gap"))).alias("garman_klass_yang_zhang"),
        F.var_samp("gap").alias("vg"), F.var_samp(F.when(later, F.col("co"))).alias("vc"), F.avg(F.when(later, F.col("rs"))).alias("vr"),
    )
    n = (F.col("bars") - 1).cast("double")
    k = F.lit(0.34) / (1.34 + F.try_divide(n + 1, n - 1))
    yz = F.col("vg") + k * F.col("vc") + (1 - k) * F.col("vr")
    return agg.select(
        "series", "bars", F.when(F.col("bars") >= 3, F.col("close_to_close")).alias("close_to_close"), "parkinson", "garman_klass", "rogers_satchell",
        F.when(F.col("bars") >= 2, F.col("garman_klass_yang_zhang")).alias("garman_klass_yang_zhang"), F.when(F.col("bars") >= 4, yz).alias("yang_zhang"),
    )


def realised_variance(bars: DataFrame, estimator: Estimator = Estimator.YANG_ZHANG) -> DataFrame:
    return realised_variances(bars).select("series", F.col(str(estimator)).alias("variance"))


def realised_volatility(bars: DataFrame, periods_per_year: float = 252.0, estimator: Estimator = Estimator.YANG_ZHANG) -> DataFrame:
    return realised_variance(bars, estimator).select("series", F.sqrt(F.col("variance") * periods_per_year).alias("volatility"))


def _one(estimator: Estimator):
    def variance(bars: DataFrame) -> DataFrame:
        return realised_variance(bars, estimator)

    variance.__name__ = str(estimator)
    return variance


close_to_close, parkinson, garman_klass, rogers_satchell, garman_klass_yang_zhang, yang_zhang = map(_one, Estimator)


def tick_bias_factor(ticks_per_bar: int) -> float:
    """By what the range's variance is too small when a bar saw so many ticks; divide by it."""
    need(ticks_per_bar >= 2, BadBar, "a bar needs at least two ticks")
    return (1 - OVERSHOOT / (math.sqrt(2 / math.pi) * math.sqrt(ticks_per_bar))) ** 2


def efficiency(samples: DataFrame, estimator: Estimator, baseline: Estimator = Estimator.CLOSE_TO_CLOSE) -> DataFrame:
    """(efficiency): the spread of the baseline's estimates over the estimator's, across series that sample one process."""
    v = realised_variances(samples)
    return v.agg(F.try_divide(F.var_samp(str(baseline)), F.var_samp(str(estimator))).alias("efficiency"))
