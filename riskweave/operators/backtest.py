"""Scoring a risk model against what happened. A forecast frame is (series, t, r, var, es): positive losses, es >= var."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.errors import BadForecast
from riskweave.functions import columns, special
from riskweave.operators.frames import by_time, need
from riskweave.operators.parametric import Distribution, unit_tail

# The supervisory scheme.
ADVISORY_MINIMUM = 100
SUPERVISORY_OBSERVATIONS = 250
SUPERVISORY_CONFIDENCE = 0.99
PLUS_FACTOR = {5: 0.40, 6: 0.50, 7: 0.65, 8: 0.75, 9: 0.85}
GREEN_CEILING = 0.95
RED_FLOOR = 0.9999
NEUTRAL_BAND = 0.03


class Zone(StrEnum):
    GREEN = "green"
    YELLOW = "yellow"
    RED = "red"


def exceedances(forecasts: DataFrame) -> DataFrame:
    """(series, t, r, var, breach): strictly worse than the forecast. A value at risk that is not positive fails in the plan."""
    v = F.when(~(F.col("var") > 0), F.raise_error("a value at risk must be positive")).otherwise(F.col("var"))
    return forecasts.withColumn("var", v).withColumn("breach", F.col("r") < -F.col("var"))


def transitions(breaches: DataFrame) -> DataFrame:
    """(series, observations, count, n00, n01, n10, n11) of consecutive periods."""
    step = breaches.withColumn("before", F.lag("breach").over(by_time()))
    pair = lambda a, b: F.count_if((F.col("before") == a) & (F.col("breach") == b))
    return step.groupBy("series").agg(
        F.count("*").alias("observations"), F.count_if("breach").alias("count"), pair(False, False).alias("n00"), pair(False, True).alias("n01"), pair(True, False).alias("n10"), pair(True, True).alias("n11")
    )


def _xlogy(x: Column, y: Column) -> Column:
    """x * ln(y) with 0 where x is 0."""
    return F.when(x > 0, x * F.ln(F.when(y > 0, y).otherwise(F.lit(1e-300)))).otherwise(0.0)


def coverage_tests(breaches: DataFrame, confidence: float) -> DataFrame:
    """(series, observations, count, expected, rate, and statistic and p-value of unconditional coverage, independence and both; advisory)."""
    x, n, p = F.col("count").cast("double"), F.col("observations").cast("double"), 1 - confidence
    lit = F.lit
    t = transitions(breaches)
    rate = x / n
    unconditional = -2 * ((n - x) * F.ln(lit(confidence)) + x * F.ln(lit(p)) - _xlogy(n - x, 1 - rate) - _xlogy(x, rate))
    n00, n01, n10, n11 = (F.col(c).cast("double") for c in ("n00", "n01", "n10", "n11"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), lit(0.0))
    p0, p1, both = ratio(n01, n00 + n01), ratio(n11, n10 + n11), ratio(n01 + n11, n00 + n01 + n10 + n11)
    independence = 2 * (_xlogy(n00, 1 - p0) + _xlogy(n01, p0) + _xlogy(n10, 1 - p1) + _xlogy(n11, p1) - _xlogy(n00 + n10, 1 - both) - _xlogy(n01 + n11, both))
    out = t.withColumn("unconditional", F.greatest(lit(0.0), unconditional)).withColumn("independence", F.greatest(lit(0.0), independence))
    out = out.withColumn("conditional", F.col("unconditional") + F.col("independence"))
    return out.select(
        "series", "observations", "count", (n * p).alias("expected"), rate.alias("rate"), "n00", "n01", "n10", "n11",
        "unconditional", columns.chi_square_1_sf(F.col("unconditional")).alias("unconditional_p"), "independence", columns.chi_square_1_sf(F.col("independence")).alias("independence_p"),
        "conditional", F.exp(-F.col("conditional") / 2).alias("conditional_p"), (F.col("observations") < ADVISORY_MINIMUM).alias("advisory"),
    )


def unconditional_coverage(breaches: DataFrame, confidence: float) -> DataFrame:
    return coverage_tests(breaches, confidence).select("series", F.col("unconditional").alias("statistic"), F.col("unconditional_p").alias("p_value"), F.lit(1).alias("degrees"), "advisory")


def independence(breaches: DataFrame, confidence: float) -> DataFrame:
    return coverage_tests(breaches, confidence).select("series", F.col("independence").alias("statistic"), F.col("independence_p").alias("p_value"), F.lit(1).alias("degrees"), "advisory")


def conditional_coverage(breaches: DataFrame, confidence: float) -> DataFrame:
    return coverage_tests(breaches, confidence).select("series", F.col("conditional").alias("statistic"), F.col("conditional_p").alias("p_value"), F.lit(2).alias("degrees"), "advisory")


def rejects_at(tests: DataFrame, level: float) -> DataFrame:
    """Adds ``rejects``, p_value < level, to a frame of one test."""
    need(0 < level < 1, BadForecast, "a significance level must lie strictly between 0 and 1")
    return tests.withColumn("rejects", F.col("p_value") < level)


def rejected_at(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """(series, rejected): the names of the coverage tests that reject, from ``coverage_tests`` or ``validate``."""
    need(0 < level < 1, BadForecast, "a significance level must lie strictly between 0 and 1")
    names = ("unconditional", "independence", "conditional")
    return tests.select("series", F.array_compact(F.array(*[F.when(F.col(f"{n}_p") < level, F.lit(n)) for n in names])).alias("rejected"))


def traffic_light(breaches: DataFrame, confidence: float) -> DataFrame:
    """(series, observations, count, cumulative_probability, zone, plus_factor): P(X <= count) under the forecast; the plus factor is set only in the supervisory case."""
    t = breaches.groupBy("series").agg(F.count("*").alias("observations"), F.count_if("breach").alias("count"))
    p = 1 - confidence
    start = F.struct(F.exp(F.col("observations") * F.log1p(F.lit(-p))).alias("mass"), F.lit(0.0).alias("total"))
    n = F.col("observations").cast("double")

    def step(s, k):
        return F.struct((s["mass"] * (n - k) / (k + 1) * (p / confidence)).alias("mass"), (s["total"] + s["mass"]).alias("total"))

    cdf = F.aggregate(F.sequence(F.lit(0).cast("bigint"), F.col("count")), start, step)["total"]
    zone = F.when(F.col("cumulative_probability") < GREEN_CEILING, "green").when(F.col("cumulative_probability") < RED_FLOOR, "yellow").otherwise("red")
    out = t.withColumn("cumulative_probability", F.least(F.lit(1.0), cdf)).withColumn("zone", zone)
    plus = F.when(F.col("zone") == "red", 1.0)
    for k, v in PLUS_FACTOR.items():
        plus = plus.when(F.col("count") == k, v)
    plus = plus.otherwise(0.0)
    supervisory = (F.col("observations") == SUPERVISORY_OBSERVATIONS) & F.lit(abs(confidence - SUPERVISORY_CONFIDENCE) < 1e-12)
    return out.withColumn("plus_factor", F.when(supervisory, plus))


def expected_tail_loss_test(forecasts: DataFrame, confidence: float) -> DataFrame:
    """(series, observations, breaches, conditional, unconditional, realised_ratio, direction): Z1 and Z2 over the breaches."""
    bad = F.when(F.col("es") < F.col("var"), F.raise_error("an expected tail loss is below its value at risk")).otherwise(F.col("es"))
    hit = F.col("r") < -F.col("var")
    part = F.when(hit, F.col("r") / bad).otherwise(F.when(bad > 0, 0.0).otherwise(0.0))
    s = forecasts.groupBy("series").agg(F.count("*").alias("observations"), F.count_if(hit).alias("breaches"), F.sum(part).alias("s"))
    out = s.select(
        "series", "observations", "breaches", (F.try_divide(F.col("s"), F.col("breaches").cast("double")) + 1).alias("conditional"),
        (F.col("s") / (F.col("observations") * (1 - confidence)) + 1).alias("unconditional"),
    )
    ratio = 1 - F.col("conditional")
    direction = F.when(F.col("conditional").isNull(), "no breaches").when(F.abs(ratio - 1) <= NEUTRAL_BAND, "in line").when(ratio > 1, "understated").otherwise("overstated")
    return out.withColumn("realised_ratio", ratio).withColumn("direction", direction)


def simulate_expected_tail_loss_null(forecasts: DataFrame, confidence: float, distribution: Distribution = Distribution.NORMAL, degrees: float = 5.0, replications: int = 2000, seed: int = 0) -> DataFrame:
    """(series, replication, conditional, unconditional) under correct forecasts.

    Only breaches matter: a uniform below the tail probability is one, and its loss is its quantile over the tail's,
    times the forecast. Replications are rows of their own, so they spread over the cluster; uniforms are hashes.
    """
    p = 1 - confidence
    q, _ = unit_tail(confidence, distribution, degrees)
    rows = forecasts.select("series", "t", "var", "es").withColumn("replication", F.explode(F.sequence(F.lit(0), F.lit(replications - 1))))
    u = columns.uniform(F.col("series"), F.col("t"), F.col("replication"), seed=seed)
    hits = rows.withColumn("u", u)
    if distribution == Distribution.NORMAL:
        quantile = columns.ppf(F.col("u"))
    else:
        scale = ((degrees - 2) / degrees) ** 0.5

        @F.pandas_udf("double")
        def quantile_of(us):
            return us.map(lambda x: scale * special.student_t_ppf(x, degrees))

        quantile = quantile_of(F.col("u"))
    tail = hits.where(F.col("u") < p).withColumn("r", F.col("var") * quantile / abs(q))
    s = tail.groupBy("series", "replication").agg(F.count("*").alias("k"), F.sum(F.col("r") / F.col("es")).alias("s"))
    n = forecasts.groupBy("series").agg(F.count("*").alias("n")).withColumn("replication", F.explode(F.sequence(F.lit(0), F.lit(replications - 1))))
    both = n.join(s, ["series", "replication"], "left")
    return both.select("series", "replication", (F.col("s") / F.col("k") + 1).alias("conditional"), (F.coalesce("s", F.lit(0.0)) / (F.col("n") * p) + 1).alias("unconditional"))


def validate(forecasts: DataFrame, confidence: float, replications: int = 0, seed: int = 0, **shape) -> DataFrame:
    """All tests of each series in one row; with replications also one-sided p-values (worse + 1) / (replications + 1)."""
    hits = exceedances(forecasts)
    tests = coverage_tests(hits, confidence).drop("observations", "count")
    out = traffic_light(hits, confidence).join(tests, "series")
    if "es" in forecasts.columns:
        z = expected_tail_loss_test(forecasts, confidence).drop("observations")
        z = z.withColumnRenamed("conditional", "es_conditional").withColumnRenamed("unconditional", "es_unconditional")
        out = out.join(z, "series")
        if replications:
            null = simulate_expected_tail_loss_null(forecasts, confidence, replications=replications, seed=seed, **shape)
            worse = null.join(z.select("series", "es_unconditional"), "series").groupBy("series").agg(((F.count_if(F.col("unconditional") <= F.col("es_unconditional")) + 1) / (replications + 1)).alias("es_p_value"))
            out = out.join(worse, "series")
    return out
