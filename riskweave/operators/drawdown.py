"""Path statistics: wealth, drawdowns, time under water, ratios and rolling windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.frames import by_time, so_far
from riskweave.operators.series import performance


def wealth_curve(panel: DataFrame, initial: float = 1.0) -> DataFrame:
    """(series, k, t, wealth): the start (k = 0, null t) and the compounded value after each period."""
    path = panel.select(
        "series", F.row_number().over(by_time()).cast("bigint").alias("k"), "t", (initial * F.exp(F.sum(F.log1p("r")).over(so_far()))).alias("wealth")
    )
    start = panel.select("series").distinct().select("series", F.lit(0).cast("bigint").alias("k"), F.lit(None).cast(panel.schema["t"].dataType).alias("t"), F.lit(float(initial)).alias("wealth"))
    return path.unionByName(start)


def drawdown_series(panel: DataFrame, initial: float = 1.0) -> DataFrame:
    """(series, k, t, wealth, peak, drawdown)."""
    peak = F.max("wealth").over(so_far("series", "k"))
    return wealth_curve(panel, initial).withColumn("peak", peak).withColumn("drawdown", (F.col("peak") - F.col("wealth")) / F.col("peak"))


def _lengths(frame: DataFrame) -> DataFrame:
    """Adds what follows from a drawdown's depth and positions."""
    return frame.select(
        "*", F.col("recovery_at").isNotNull().alias("recovered"), (F.col("trough_at") - F.col("peak_at")).alias("decline_periods"),
        (F.col("recovery_at") - F.col("trough_at")).alias("recovery_periods"), (F.coalesce("recovery_at", "trough_at") - F.col("peak_at")).alias("underwater_periods"),
        F.when(F.col("depth") < 1, F.col("depth") / (1 - F.col("depth"))).otherwise(F.lit(float("inf"))).alias("recovery_return"),
    )


def maximum_drawdown(panel: DataFrame, initial: float = 1.0) -> DataFrame:
    """The deepest decline of each series: first trough and first peak on ties; depth 0 recovers at its own start."""
    path = drawdown_series(panel, initial)
    order = Window.partitionBy("series").orderBy(F.desc("drawdown"), "k")
    worst = path.withColumn("__o", F.row_number().over(order)).where("__o = 1").select("series", F.col("drawdown").alias("depth"), F.col("k").alias("trough_at"), F.col("t").alias("trough"), F.col("wealth").alias("trough_value"), F.col("peak").alias("peak_value"))
    seen = path.select("series", "k", "t", "wealth").join(worst, "series")
    ends = seen.groupBy("series").agg(
        F.min(F.when(F.col("wealth") == F.col("peak_value"), F.col("k"))).alias("peak_at"),
        F.min(F.when((F.col("k") >= F.col("trough_at")) & (F.col("wealth") >= F.col("peak_value")), F.col("k"))).alias("recovery_at"),
    )
    return _lengths(worst.join(ends, "series"))


def drawdowns(panel: DataFrame, initial: float = 1.0, minimum_depth: float = 0.0) -> DataFrame:
    """Disjoint episodes from a peak (the last of equal ones) to its recovery, deepest first by ``rank``."""
    path = drawdown_series(panel, initial)
    top = F.col("wealth") >= F.col("peak")
    path = path.withColumn("island", F.sum(top.cast("bigint")).over(so_far("series", "k")))
    path = path.withColumn("next_top", F.min(F.when(top, F.col("k"))).over(by_time("series", "k").rowsBetween(1, Window.unboundedFollowing)))
    found = path.groupBy("series", "island").agg(
        F.max("drawdown").alias("depth"), F.min("k").alias("peak_at"), F.max_by("peak", "k").alias("peak_value"), F.max("next_top").alias("recovery_at"),
        F.min_by("k", F.struct((-F.col("drawdown")).alias("d"), F.col("k"))).alias("trough_at"),
    )
    found = found.where((F.col("depth") > 0) & (F.col("depth") >= minimum_depth)).drop("island")
    found = _lengths(found)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("depth"), "peak_at")).cast("bigint"))


def longest_underwater(panel: DataFrame, initial: float = 1.0) -> DataFrame:
    """The episode that lasted longest (then deepest); a series that never fell has its maximum drawdown of 0."""
    columns = ["series", "depth", "peak_at", "trough_at", "recovery_at", "underwater_periods"]
    order = Window.partitionBy("series").orderBy(F.desc("underwater_periods"), F.desc("depth"), "peak_at")
    first = drawdowns(panel, initial).withColumn("__o", F.row_number().over(order)).where("__o = 1").select(*columns)
    flat = maximum_drawdown(panel, initial).where("depth = 0").select(*columns)
    return first.unionByName(flat)


def path_ratios(panel: DataFrame, periods_per_year: float, target: float = 0.0, full_sample: bool = True, initial: float = 1.0) -> DataFrame:
    """(series, max_depth, ulcer_index, calmar, martin_ratio, downside_deviation, sortino); a ratio over 0 is null."""
    path = drawdown_series(panel, initial).groupBy("series").agg(F.max("drawdown").alias("max_depth"), F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer_index"))
    short = F.least(F.col("r") - target, F.lit(0.0))
    n = F.count("*") if full_sample else F.greatest(F.count_if(F.col("r") < target), F.lit(1))
    down = panel.groupBy("series").agg(F.sqrt(F.sum(short * short) / n).alias("downside_deviation"), F.avg("r").alias("mean"))
    out = path.join(down, "series").join(performance(panel, periods_per_year).select("series", "annualised_return"), "series")
    return out.select(
        "series", "max_depth", "ulcer_index", F.try_divide("annualised_return", "max_depth").alias("calmar"), F.try_divide("annualised_return", "ulcer_index").alias("martin_ratio"),
        "downside_deviation", F.try_divide((F.col("mean") - target) * periods_per_year, F.col("downside_deviation") * periods_per_year**0.5).alias("sortino"),
    )


def rolling(panel: DataFrame, window: int, statistic: Callable[[Column], Column], name: str = "value") -> DataFrame:
    """(series, t, value): a Column statistic of the array of returns in each full window."""
    frame = by_time().rowsBetween(-(window - 1), 0)
    rows = panel.withColumn("__k", F.row_number().over(by_time())).withColumn("__x", F.collect_list("r").over(frame)).where(F.col("__k") >= window)
    return rows.select("series", "t", statistic(F.col("__x")).alias(name))


def rolling_volatility(panel: DataFrame, window: int, periods_per_year: float, ddof: int = 1) -> DataFrame:
    frame = by_time().rowsBetween(-(window - 1), 0)
    spread = (F.stddev_samp("r") if ddof else F.stddev_pop("r")).over(frame)
    return panel.withColumn("__k", F.row_number().over(by_time())).withColumn("volatility", spread * periods_per_year**0.5).where(F.col("__k") >= window).select("series", "t", "volatility")


def _path(xs: Column, part) -> Column:
    start = F.struct(F.lit(1.0).alias("w"), F.lit(1.0).alias("p"), F.lit(0.0).alias("d"))

    def step(s, r):
        w = s["w"] * (1 + r)
        p = F.greatest(s["p"], w)
        return F.struct(w.alias("w"), p.alias("p"), part(s["d"], (p - w) / p).alias("d"))

    return F.aggregate(xs, start, step)["d"]


#: Log growth that stands for a total loss: its exponential is 0.
_RUIN = -1000.0


def rolling_maximum_drawdown(panel: DataFrame, window: int) -> DataFrame:
    """(series, t, max_drawdown) of each full window, in time that does not depend on its length.

    Periods fall into blocks of ``window``, so a window is a block's tail and the next one's head (or a whole block). A
    segment's state is its log growth, its highest and lowest log wealth and its deepest log drawdown, from a start of 0;
    states of all heads and tails are running extremes within a block, and two of them make a window.
    """
    growth = F.when(F.col("r") > -1, F.log1p("r")).otherwise(_RUIN)
    rows = panel.select("series", "t", growth.alias("x"), (F.row_number().over(by_time()) - 1).cast("bigint").alias("k"))
    rows = rows.withColumn("block", F.floor(F.col("k") / window))
    head = Window.partitionBy("series", "block").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    tail = Window.partitionBy("series", "block").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.sum("x").over(head))
    heads = rows.withColumn("low", F.min("s").over(head)).withColumn("peak", F.greatest(F.max("s").over(head), F.lit(0.0)))
    heads = heads.withColumn("deep", F.min(F.col("s") - F.col("peak")).over(head)).select("series", "t", "k", "low", "deep")
    before = F.col("s") - F.col("x")  # log wealth at the block's start up to the tail's
    tails = rows.withColumn("top", F.max("s").over(tail)).withColumn("least", F.min("s").over(tail)).withColumn("end", F.first("s").over(tail))
    tails = tails.withColumn("tail_deep", F.min(F.col("least") - before).over(tail))
    tails = tails.select("series", (F.col("k") + window - 1).alias("k"), (F.col("end") - before).alias("tail_growth"), F.greatest(F.col("top") - before, F.lit(0.0)).alias("tail_top"), "tail_deep")
    both = heads.where(F.col("k") >= window - 1).join(tails, ["series", "k"])
    whole = F.col("k") % window == window - 1
    deep = F.when(whole, F.col("deep")).otherwise(F.least("deep", "tail_deep", F.col("tail_growth") + F.col("low") - F.col("tail_top")))
    return both.select("series", "t", F.greatest(F.lit(0.0), -F.expm1(deep)).alias("max_drawdown"))


def rolling_ulcer_index(panel: DataFrame, window: int) -> DataFrame:
    return rolling(panel, window, lambda xs: F.sqrt(_path(xs, lambda d, x: d + x * x) / (window + 1)), "ulcer_index")

