"""Return series and panels: prices to returns, conventions, moments, alignment, portfolios."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.errors import Misaligned, TooShort
from riskweave.operators.frames import by_time, of_series, require_rows, weights_frame

# Periods in a year.
DAILY_TRADING = 252
DAILY_CALENDAR = 365
WEEKLY = 52
MONTHLY = 12
QUARTERLY = 4
ANNUAL = 1


class Convention(StrEnum):
    SIMPLE = "simple"
    LOG = "log"


def checked(frame: DataFrame, convention: Convention = Convention.SIMPLE, r: str = "r") -> DataFrame:
    """The panel with its convention as metadata; null or non-finite returns, and simple ones of -1 or less, fail in the plan."""
    x = F.col(r)
    bad = x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    if convention == Convention.SIMPLE:
        bad = bad | (x <= -1)
    return frame.withColumn(r, F.when(bad, F.raise_error(F.concat(F.lit("not a return: "), x.cast("string")))).otherwise(x)).withMetadata(r, {"convention": str(convention)})


def convention_of(frame: DataFrame, r: str = "r") -> Convention:
    return Convention(frame.schema[r].metadata.get("convention", "simple"))


def returns_from_prices(prices: DataFrame, convention: Convention = Convention.SIMPLE, px: str = "px") -> DataFrame:
    """(series, t, r): each price over the one before; a price that is not positive fails in the plan, the first row of a series goes."""
    p = F.when(~(F.col(px) > 0) | F.isnan(px), F.raise_error(F.concat(F.lit("not a price: "), F.col(px).cast("string")))).otherwise(F.col(px))
    step = prices.withColumn("__p", p).withColumn("__before", F.lag("__p").over(by_time()))
    ratio = F.col("__p") / F.col("__before")
    r = F.ln(ratio) if convention == Convention.LOG else ratio - 1
    return step.where("__before is not null").select("series", "t", r.alias("r")).withMetadata("r", {"convention": str(convention)})


def to_log(panel: DataFrame) -> DataFrame:
    if convention_of(panel) == Convention.LOG:
        return panel
    return panel.withColumn("r", F.log1p("r")).withMetadata("r", {"convention": "log"})


def to_simple(panel: DataFrame) -> DataFrame:
    if convention_of(panel) == Convention.SIMPLE:
        return panel
    return panel.withColumn("r", F.expm1("r")).withMetadata("r", {"convention": "simple"})


def corrected_skewness(g: Column, n: Column) -> Column:
    return F.when(n >= 3, g * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(g: Column, n: Column) -> Column:
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g + 6))


def moments(panel: DataFrame) -> DataFrame:
    """(series, n, mean, variance and stdev with both divisors, skewness and excess kurtosis, plain and corrected). A flat series has no shape: null."""
    eps = 2.220446049250313e-16
    agg = panel.groupBy("series").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.try_divide(F.var_samp("r"), F.lit(1)).alias("variance"), F.var_pop("r").alias("variance_ml"),
        F.skewness("r").alias("g1"), F.kurtosis("r").alias("g2"), F.sum(F.col("r") * F.col("r")).alias("ss"),
    )
    n = F.col("n").cast("double")
    flat = F.col("variance_ml") <= eps * F.col("ss")
    shape = lambda c: F.when(~flat, c)
    return agg.select(
        "series", "n", "mean", "variance", "variance_ml", F.sqrt("variance").alias("stdev"), F.sqrt("variance_ml").alias("stdev_ml"),
        shape(F.col("g1")).alias("skewness_plain"), shape(corrected_skewness(F.col("g1"), n)).alias("skewness"),
        shape(F.col("g2")).alias("kurtosis_plain"), shape(corrected_kurtosis(F.col("g2"), n)).alias("excess_kurtosis"),
    )


def performance(panel: DataFrame, periods_per_year: float, ddof: int = 1) -> DataFrame:
    """(series, cumulative, annualised_return, annualised_volatility)."""
    grown = F.sum(F.col("r") if convention_of(panel) == Convention.LOG else F.log1p("r"))
    spread = F.stddev_samp("r") if ddof else F.stddev_pop("r")
    return panel.groupBy("series").agg(
        F.expm1(grown).alias("cumulative"), F.expm1(grown * periods_per_year / F.count("r")).alias("annualised_return"), (spread * periods_per_year**0.5).alias("annualised_volatility")
    )


def aligned(panel: DataFrame) -> DataFrame:
    """Only the periods that every series has: an inner join on the index, nothing filled."""
    n = panel.select("series").distinct().agg(F.count("*").alias("n"))
    shared = panel.groupBy("t").agg(F.countDistinct("series").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("t")  # n is one row
    return panel.join(shared, "t", "left_semi").select(*panel.columns)


def demeaned(panel: DataFrame) -> DataFrame:
    return panel.withColumn("r", F.col("r") - F.avg("r").over(of_series()))


def from_columns(wide: DataFrame, columns: list[str], t: str = "t", convention: Convention = Convention.SIMPLE) -> DataFrame:
    """A wide frame, one column per series, as a panel."""
    return checked(wide.unpivot(t, columns, "series", "r").select("series", F.col(t).alias("t"), F.col("r").cast("double").alias("r")), convention)


def to_columns(panel: DataFrame, names: list[str]) -> DataFrame:
    return panel.groupBy("t").pivot("series", names).agg(F.first("r"))


def as_panel(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        if convention_of(f) != convention_of(out):
            raise Misaligned("series of different conventions do not make a panel")
        out = out.unionByName(f)
    return out


def portfolio(panel: DataFrame, weights: DataFrame | dict, name: str = "portfolio") -> DataFrame:
    """(series, t, r): weighted sums of simple returns over the periods that all weighted series have. Weights are not normalised."""
    w = weights_frame(panel.sparkSession, weights) if isinstance(weights, dict) else weights
    k = w.agg(F.count("*").alias("__k"))
    held = to_simple(panel).join(w, "series")  # as many rows as series: Spark broadcasts them when small
    out = held.groupBy("t").agg(F.sum(F.col("w") * F.col("r")).alias("r"), F.count("*").alias("__n")).join(F.broadcast(k), F.col("__n") == F.col("__k"))  # k is one row
    return out.select(F.lit(name).alias("series"), "t", "r").withMetadata("r", {"convention": "simple"})


class ReturnSeries:
    """One series of a panel, with single numbers as properties; each is one small aggregation."""

    def __init__(self, panel: DataFrame, name: str) -> None:
        self.frame, self.name = panel.where(F.col("series") == name), name

    @classmethod
    def from_prices(cls, prices: DataFrame, name: str, convention: Convention = Convention.SIMPLE) -> ReturnSeries:
        return cls(returns_from_prices(prices.where(F.col("series") == name), convention), name)

    def __len__(self) -> int:
        return self.frame.count()

    @property
    def convention(self) -> Convention:
        return convention_of(self.frame)

    def _one(self, frame: DataFrame, column: str) -> float:
        row = frame.select(column).first()
        if row is None or row[0] is None:
            raise TooShort(f"{self.name}: too few or flat observations for {column}")
        return row[0]

    @property
    def mean(self) -> float:
        return self._one(moments(self.frame), "mean")

    def variance(self, *, ddof: int = 1) -> float:
        return self._one(moments(self.frame), "variance" if ddof else "variance_ml")

    def stdev(self, *, ddof: int = 1) -> float:
        return self.variance(ddof=ddof) ** 0.5

    def skewness(self, *, corrected: bool = True) -> float:
        return self._one(moments(self.frame), "skewness" if corrected else "skewness_plain")

    def excess_kurtosis(self, *, corrected: bool = True) -> float:
        return self._one(moments(self.frame), "excess_kurtosis" if corrected else "kurtosis_plain")

    def cumulative(self) -> float:
        return self._one(performance(self.frame, 1), "cumulative")

    def annualised_return(self, periods_per_year: float) -> float:
        return self._one(performance(self.frame, periods_per_year), "annualised_return")

    def annualised_volatility(self, periods_per_year: float, *, ddof: int = 1) -> float:
        return self._one(performance(self.frame, periods_per_year, ddof), "annualised_volatility")

    def to_log(self) -> ReturnSeries:
        return ReturnSeries(to_log(self.frame), self.name)

    def to_simple(self) -> ReturnSeries:
        return ReturnSeries(to_simple(self.frame), self.name)

    def values(self) -> list[float]:
        """The returns in order, on the driver: for the kernels of single series."""
        return [x[0] for x in self.frame.orderBy("t").select("r").collect()]


class Panel:
    """A panel frame with the questions one asks of it."""

    def __init__(self, frame: DataFrame) -> None:
        self.frame = frame

    @classmethod
    def from_columns(cls, wide: DataFrame, columns: list[str], t: str = "t", convention: Convention = Convention.SIMPLE) -> Panel:
        return cls(from_columns(wide, columns, t, convention))

    @classmethod
    def from_prices(cls, prices: DataFrame, convention: Convention = Convention.SIMPLE) -> Panel:
        return cls(aligned(returns_from_prices(prices, convention)))

    @classmethod
    def aligned(cls, *frames: DataFrame) -> Panel:
        out = aligned(as_panel(*frames))
        if out.isEmpty():
            raise Misaligned("the series share no period")
        return cls(out)

    @property
    def names(self) -> list[str]:
        return [r[0] for r in self.frame.select("series").distinct().orderBy("series").collect()]

    @property
    def assets(self) -> int:
        return self.frame.select("series").distinct().count()

    def __len__(self) -> int:
        return self.assets

    @property
    def observations(self) -> int:
        return self.frame.select("t").distinct().count()

    @property
    def convention(self) -> Convention:
        return convention_of(self.frame)

    def __getitem__(self, name: str) -> ReturnSeries:
        if name not in self.names:
            raise KeyError(name)
        return ReturnSeries(self.frame, name)

    def column(self, index: int) -> ReturnSeries:
        return ReturnSeries(self.frame, self.names[index])

    def row(self, t) -> dict[str, float]:
        return {r["series"]: r["r"] for r in self.frame.where(F.col("t") == t).orderBy("series").collect()}

    def means(self) -> dict[str, float]:
        return {r["series"]: r["mean"] for r in moments(self.frame).collect()}

    def demeaned(self) -> DataFrame:
        return demeaned(self.frame)

    def require(self, minimum: int, what: str) -> None:
        require_rows(self.observations, minimum, what)

    def portfolio(self, weights: dict, name: str = "portfolio") -> ReturnSeries:
        return ReturnSeries(portfolio(self.frame, weights, name), name)
