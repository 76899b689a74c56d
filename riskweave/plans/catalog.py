"""Driver queries over the canonical inputs, with DuckDB SQL where SQL can express them.

Doubles are rounded alike on both sides, so that the last bits of differently ordered sums do not show.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.functions import spectra
from riskweave.operators import (
    backtest, bounds, cleaning, contributions, copula, covariance, drawdown, entropy, expectile, extreme, factors, frames, historical, horizon, lossgrid, mixture, parametric, quadratic, ranks, realised,
    saddlepoint, scoring, series, spectral, stress, volatility,
)
from riskweave.plans import inputs as I  # noqa: E741, N812

DIGITS = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(F.col(f"`{c}`"), DIGITS) + 0.0).alias(c) if k == "double" else F.col(f"`{c}`").cast("bigint").alias(c) if k == "int" else F.col(f"`{c}`") for c, k in df.dtypes])


def query(name: str, with_sql: str = "", select: str = "", doubles: str = ""):
    """Registers a query, and its SQL when given: CTEs, final select and the columns to round."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if select:
            cut = ", ".join(f"round(CAST({c} AS DOUBLE), {DIGITS}) + 0.0 AS {c}" for c in doubles.split())
            replace = f" REPLACE ({cut})" if cut else ""
            ORACLES[name] = f"WITH {'RECURSIVE ' if 'RECURSIVE' in with_sql else ''}{with_sql.replace('RECURSIVE', '')} SELECT *{replace} FROM ({select})"
        return f

    return register


ALPHA, CONF = 0.025, 0.975
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY r, t) AS rn, count(*) OVER (PARTITION BY series) AS n FROM panel)"


# --- series and panels ------------------------------------------------------------------------


@query("returns_from_prices", I.PANEL_LI, "SELECT series, t, r FROM panel", "r")
def _(spark, d):
    return I.panel_li(spark, d)


@query("log_simple_roundtrip", I.PANEL_LI, "SELECT series, t, ln(1 + r) AS log_r, exp(ln(1 + r)) - 1 AS back FROM panel", "log_r back")
def _(spark, d):
    p = series.to_log(I.panel_li(spark, d))
    return p.select("series", "t", F.col("r").alias("log_r")).join(series.to_simple(p).select("series", "t", F.col("r").alias("back")), ["series", "t"])


@query(
    "series_moments", I.PANEL_LI,
    "SELECT series, count(*) AS n, avg(r) AS mean, var_samp(r) AS variance, var_pop(r) AS variance_ml, stddev_samp(r) AS stdev, stddev_pop(r) AS stdev_ml, skewness(r) AS skewness, kurtosis(r) AS excess_kurtosis FROM panel GROUP BY 1",
    "mean variance variance_ml stdev stdev_ml skewness excess_kurtosis",
)
def _(spark, d):
    return series.moments(I.panel_li(spark, d)).drop("skewness_plain", "kurtosis_plain")


@query(
    "cumulative_annualised", I.PANEL_ORD_M,
    "SELECT series, exp(sum(ln(1 + r))) - 1 AS cumulative, exp(sum(ln(1 + r)) * 12 / count(*)) - 1 AS annualised_return, stddev_samp(r) * sqrt(12) AS annualised_volatility FROM panel GROUP BY 1",
    "cumulative annualised_return annualised_volatility",
)
def _(spark, d):
    return series.performance(I.panel_ord_m(spark, d), series.MONTHLY)


@query(
    "panel_aligned", I.PANEL_ORD_W,
    "SELECT series, t, r FROM panel WHERE t IN (SELECT t FROM panel GROUP BY t HAVING count(DISTINCT series) = (SELECT count(DISTINCT series) FROM panel))", "r",
)
def _(spark, d):
    return series.aligned(I.panel_ord_w(spark, d))


@query("panel_demeaned", I.PANEL_LI, "SELECT series, t, r - avg(r) OVER (PARTITION BY series) AS r FROM panel", "r")
def _(spark, d):
    return series.demeaned(I.panel_li(spark, d))


WEIGHTS = {"A": 0.5, "N": 0.3, "R": 0.2}
_W = "w AS (SELECT * FROM (VALUES ('A', 0.5::DOUBLE), ('N', 0.3::DOUBLE), ('R', 0.2::DOUBLE)) v(series, w))"
_BOOK = f"{I.PANEL_LI}, {_W}, book AS (SELECT t, sum(w * r) AS r FROM panel JOIN w USING (series) GROUP BY t HAVING count(*) = 3)"


@query("portfolio_returns", _BOOK, "SELECT 'portfolio' AS series, t, r FROM book", "r")
def _(spark, d):
    return series.portfolio(I.panel_li(spark, d), WEIGHTS)


# --- historical -------------------------------------------------------------------------------

_HIST = f"""SELECT series, -quantile_cont(r, {ALPHA}) AS value_at_risk, -sum(greatest(0.0, least(1.0, n * {ALPHA} - (rn - 1))) * r) / sum(greatest(0.0, least(1.0, n * {ALPHA} - (rn - 1)))) AS expected_tail_loss,
quantile_cont(r, {ALPHA}) AS quantile, {CONF}::DOUBLE AS confidence, count(*) AS observations, CAST(sum(CASE WHEN n * {ALPHA} > rn - 1 THEN 1 ELSE 0 END) AS BIGINT) AS tail_observations, count(*) * {ALPHA} AS effective_sample FROM ranked GROUP BY series"""
_HIST_D = "value_at_risk expected_tail_loss quantile confidence effective_sample"


@query("historical_var_es", f"{I.PANEL_LI}, {_RANKED}", _HIST, _HIST_D)
def historical_var_es(spark, d):
    return historical.historical_risk(I.panel_li(spark, d), CONF)


@query(
    "quantile_methods", f"{I.PANEL_LI}, s AS (SELECT series, list_sort(list(r)) AS x, count(*) AS n FROM panel GROUP BY 1), h AS (SELECT *, (n - 1) * 0.05 AS h, greatest(0.0, least(n - 1.0, (n + 1) * 0.05 - 1)) AS g FROM s)",
    """SELECT series, x[CAST(floor(h) AS BIGINT) + 1] AS lower, x[CAST(ceil(h) AS BIGINT) + 1] AS higher, x[CAST(floor(h) AS BIGINT) + 1] + (h - floor(h)) * (x[CAST(ceil(h) AS BIGINT) + 1] - x[CAST(floor(h) AS BIGINT) + 1]) AS linear,
x[CAST(floor(g) AS BIGINT) + 1] + (g - floor(g)) * (x[CAST(ceil(g) AS BIGINT) + 1] - x[CAST(floor(g) AS BIGINT) + 1]) AS weibull FROM h""",
    "lower higher linear weibull",
)
def _(spark, d):
    p, out = I.panel_li(spark, d), None
    for m in historical.QuantileMethod:
        q = historical.empirical_quantile(p, 0.05, m).withColumnRenamed("quantile", str(m))
        out = q if out is None else out.join(q, "series")
    return out


_SUB = f"""{I.PANEL_LI}, alls AS (SELECT series, t, r FROM panel UNION ALL SELECT '+', t, sum(r) FROM panel GROUP BY t), ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY r, t) AS rn, count(*) OVER (PARTITION BY series) AS n FROM alls),
es AS (SELECT series, -sum(greatest(0.0, least(1.0, n * {ALPHA} - (rn - 1))) * r) / sum(greatest(0.0, least(1.0, n * {ALPHA} - (rn - 1)))) AS v FROM ranked GROUP BY 1)"""


@query(
    "subadditivity", _SUB,
    "SELECT 'expected_tail_loss' AS measure, sum(CASE WHEN series = '+' THEN v ELSE 0 END) AS combined, sum(CASE WHEN series <> '+' THEN v ELSE 0 END) AS sum_of_parts, sum(CASE WHEN series = '+' THEN v ELSE -v END) AS penalty, sum(CASE WHEN series = '+' THEN v ELSE -v END) <= 1e-9 AS subadditive FROM es",
    "combined sum_of_parts penalty",
)
def _(spark, d):
    return historical.check_subadditivity(I.panel_li(spark, d), CONF, True)


_EWMA = f"""RECURSIVE {I.PANEL_LI}, o AS (SELECT series, t, r, row_number() OVER (PARTITION BY series ORDER BY t) AS k, var_pop(r) OVER (PARTITION BY series) AS v0 FROM panel),
e AS (SELECT series, t, r, k, v0 AS v FROM o WHERE k = 1 UNION ALL SELECT o.series, o.t, o.r, o.k, 0.94 * e.v + 0.06 * e.r * e.r FROM e JOIN o ON o.series = e.series AND o.k = e.k + 1),
x AS (SELECT series, t, r, sqrt(v) AS volatility, sqrt(last_value(0.94 * v + 0.06 * r * r) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next_volatility FROM e)"""


@query("ewma_volatility", _EWMA, "SELECT * FROM x", "r volatility next_volatility")
def _(spark, d):
    return historical.ewma_volatility(I.panel_li(spark, d))


@query(
    "filtered_historical", f"{_EWMA}, f AS (SELECT series, t, r / volatility * next_volatility AS r FROM x), ranked AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY r, t) AS rn, count(*) OVER (PARTITION BY series) AS n FROM f)",
    f"SELECT h.*, c.current_volatility, c.average_volatility, c.current_volatility / c.average_volatility AS scaling FROM ({_HIST}) h JOIN (SELECT series, max(next_volatility) AS current_volatility, sqrt(avg(volatility * volatility)) AS average_volatility FROM x GROUP BY 1) c USING (series)",
    _HIST_D + " current_volatility average_volatility scaling",
)
def _(spark, d):
    return historical.filtered_historical_risk(I.panel_li(spark, d), CONF)


@query("bootstrap_interval")
def _(spark, d):
    return historical.bootstrap_interval(I.panel_li(spark, d), 0.95)


# --- second moments -----------------------------------------------------------------------------

_COV = f"{I.PANEL_ORD_A}, cov AS (SELECT a.series AS i, b.series AS j, covar_samp(a.r, b.r) AS v FROM panel a JOIN panel b USING (t) GROUP BY 1, 2)"
_CORR = f"{_COV}, corr AS (SELECT c.i, c.j, CASE WHEN c.i = c.j THEN 1.0 ELSE c.v / sqrt(a.v * b.v) END AS v FROM cov c JOIN cov a ON a.i = c.i AND a.j = c.i JOIN cov b ON b.i = c.j AND b.j = c.j)"


def _aligned_m(spark, d):
    return frames.cut(series.aligned(I.panel_ord_m(spark, d)))


@query("covariance_long", _COV, "SELECT i, j, v FROM cov", "v")
def _(spark, d):
    return covariance.sample_covariance(_aligned_m(spark, d))


@query("correlation_long", _CORR, "SELECT i, j, v FROM corr", "v")
def _(spark, d):
    return covariance.correlation(covariance.sample_covariance(_aligned_m(spark, d)))


@query("average_correlation", _CORR, "SELECT avg(v) AS average_correlation FROM corr WHERE i < j", "average_correlation")
def _(spark, d):
    return covariance.average_correlation(covariance.sample_covariance(_aligned_m(spark, d)))


_LW = f"""{_COV}, m AS (SELECT series, t, r - avg(r) OVER (PARTITION BY series) AS x FROM panel),
pr AS (SELECT a.series AS i, b.series AS j, a.x, b.x AS y FROM m a JOIN m b USING (t)), s AS (SELECT i, j, avg(x * y) AS s, count(*) AS n FROM pr GROUP BY 1, 2),
wide AS (SELECT s.*, a.s AS sii, b.s AS sjj FROM s JOIN s a ON a.i = s.i AND a.j = s.i JOIN s b ON b.i = s.j AND b.j = s.j), rb AS (SELECT avg(s / sqrt(sii * sjj)) AS rbar FROM wide WHERE i < j),
dv AS (SELECT i, j, avg((x * y - s) * (x * y - s)) AS pi, avg((x * x - sii) * (x * y - s)) AS ti, avg((y * y - sjj) * (x * y - s)) AS tj, first(s) AS s, first(sii) AS sii, first(sjj) AS sjj, first(n) AS n FROM pr JOIN wide USING (i, j) GROUP BY 1, 2),
tot AS (SELECT max(n) AS periods, sum(pi) AS pi, sum(CASE WHEN i = j THEN pi ELSE rbar / 2 * (sqrt(sjj / sii) * ti + sqrt(sii / sjj) * tj) END) AS rho, sum(CASE WHEN i <> j THEN (rbar * sqrt(sii * sjj) - s) ** 2 ELSE 0 END) AS gamma, max(rbar) AS rbar FROM dv, rb),
k AS (SELECT *, greatest(0.0, least(1.0, (pi - rho) / gamma / periods)) AS intensity FROM tot)"""


@query(
    "ledoit_wolf", f"{_LW}, rs AS (SELECT avg(c.v / sqrt(a.v * b.v)) AS r FROM cov c JOIN cov a ON a.i = c.i AND a.j = c.i JOIN cov b ON b.i = c.j AND b.j = c.j WHERE c.i < c.j)",
    "SELECT c.i, c.j, intensity * CASE WHEN c.i = c.j THEN c.v ELSE rs.r * sqrt(a.v * b.v) END + (1 - intensity) * c.v AS v, c.v AS sample, CASE WHEN c.i = c.j THEN c.v ELSE rs.r * sqrt(a.v * b.v) END AS target, intensity FROM cov c JOIN cov a ON a.i = c.i AND a.j = c.i JOIN cov b ON b.i = c.j AND b.j = c.j, k, rs",
    "v sample target intensity",
)
def _(spark, d):
    return covariance.ledoit_wolf(_aligned_m(spark, d))


def _phi(z: str) -> str:
    """The normal distribution function in SQL: 1/2 + density * (z + z^3 / 3 + z^5 / 15 + ..)."""
    size = f"(2 * i + 1) * ln(abs({z}) + 1e-300) - lgamma(2 * i + 2) + i * ln(2::DOUBLE) + lgamma(i + 1)"
    return f"(0.5::DOUBLE + sign({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 160), lambda i: exp({size}))))"


def _bisected(name: str, levels: str, cdf: Callable[[str], str], low: float, high: float) -> str:
    """SQL of the quantiles (p, z) of a distribution function by bisection."""
    inside = f"{cdf('((lo + hi) / 2)')} < p"
    return f"""RECURSIVE {name}_steps AS (SELECT p, {low}::DOUBLE AS lo, {high}::DOUBLE AS hi, 0 AS k FROM (VALUES {levels}) v(p) UNION ALL
SELECT p, CASE WHEN {inside} THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {inside} THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM {name}_steps WHERE k < 60), {name} AS (SELECT p, (lo + hi) / 2 AS z FROM {name}_steps WHERE k = 60)"""


#: Normal quantiles and tail means; those of Student's t with 5 degrees, scaled to variance 1; the radius of 5 normal factors.
_NQ = _bisected("nq", "(0.01::DOUBLE), (0.05::DOUBLE)", _phi, -6, 6) + ", ntail AS (SELECT p, z AS q, -exp(-z * z / 2) / sqrt(2 * pi()) / p AS tl FROM nq)"
_T5 = _bisected("tq", "(0.01::DOUBLE)", lambda x: f"(0.5::DOUBLE + (atan({x} / sqrt(5)) + {x} / sqrt(5) / (1 + {x} * {x} / 5) * (1 + 2 / (3 + 3 * {x} * {x} / 5))) / pi())", -20, 0)
_T5 += ", ttail AS (SELECT p, sqrt(0.6) * z AS q, -sqrt(0.6) * (5 + z * z) / 4 * 8 / (3 * pi() * sqrt(5)) / pow(1 + z * z / 5, 3) / p AS tl FROM tq)"
_R5 = _bisected("radius", "(0.99::DOUBLE)", lambda r: f"(2 * {_phi(r)} - 1 - sqrt(2 / pi()) * {r} * exp(-{r} * {r} / 2) * (1 + {r} * {r} / 3))", 0, 9)


@query(
    "parametric_normal", f"{_NQ}, {I.PANEL_LI}, m AS (SELECT series, avg(r) AS mean, stddev_samp(r) AS volatility FROM panel GROUP BY 1)",
    "SELECT series, mean, volatility, -(mean + volatility * q) AS value_at_risk, -(mean + volatility * tl) AS expected_tail_loss, mean + volatility * q AS quantile FROM m, ntail WHERE p = 0.01",
    "mean volatility value_at_risk expected_tail_loss quantile",
)
def _(spark, d):
    return parametric.parametric_risk(I.panel_li(spark, d))


@query(
    "parametric_student_t", f"{_T5}, {I.PANEL_LI}, m AS (SELECT series, avg(r) AS mean, stddev_samp(r) AS volatility FROM panel GROUP BY 1)",
    "SELECT series, mean, volatility, -(mean + volatility * q) AS value_at_risk, -(mean + volatility * tl) AS expected_tail_loss, mean + volatility * q AS quantile FROM m, ttail",
    "mean volatility value_at_risk expected_tail_loss quantile",
)
def _(spark, d):
    return parametric.parametric_risk(I.panel_li(spark, d), distribution=parametric.Distribution.STUDENT_T)


@query(
    "cornish_fisher", f"""{_NQ}, {I.PANEL_ORD_M}, m AS (SELECT series, avg(r) AS mean, stddev_samp(r) AS volatility, skewness(r) AS skewness, kurtosis(r) AS excess_kurtosis FROM panel GROUP BY 1),
c AS (SELECT *, -skewness / 6 AS c0, 1 - excess_kurtosis / 8 + 5 * skewness * skewness / 36 AS c1, skewness / 6 AS c2, excess_kurtosis / 24 - skewness * skewness / 18 AS c3 FROM m),
n AS (SELECT q AS z, -tl * 0.05 AS f FROM ntail WHERE p = 0.05), g AS (SELECT series, bool_and(c1 + 2 * c2 * x + 3 * c3 * x * x > 0) AS ok FROM c, (SELECT -4.0::DOUBLE + (z + 4.0) * i / 400 AS x FROM n, range(401) t(i)) GROUP BY 1),
q AS (SELECT c.*, CASE WHEN ok THEN c0 + z * (c1 + z * (c2 + z * c3)) END AS q, CASE WHEN ok THEN (c0 * 0.05 - c1 * f + c2 * (0.05 - z * f) - c3 * (z * z + 2) * f) / 0.05 END AS tl FROM c JOIN g USING (series), n)""",
    "SELECT series, mean, volatility, -(mean + volatility * q) AS value_at_risk, -(mean + volatility * tl) AS expected_tail_loss, mean + volatility * q AS quantile, skewness, excess_kurtosis FROM q",
    "mean volatility value_at_risk expected_tail_loss quantile skewness excess_kurtosis",
)
def _(spark, d):
    return parametric.parametric_risk(I.panel_ord_m(spark, d), 0.95, parametric.Distribution.CORNISH_FISHER)


def _equal(frame: DataFrame) -> DataFrame:
    names = frame.select("series").distinct()
    n = names.agg(F.count("*").alias("n"))
    return names.crossJoin(F.broadcast(n)).select("series", (1.0 / F.col("n")).alias("w"))  # n is one row


_EQ = "w AS (SELECT DISTINCT series, 1.0::DOUBLE / (SELECT count(DISTINCT series) FROM panel) AS w FROM panel)"
_SW = f"{_COV}, {_EQ}, sw AS (SELECT i AS series, sum(v * w) AS value FROM cov JOIN w ON w.series = cov.j GROUP BY 1), vol AS (SELECT sqrt(sum(w * value)) AS volatility FROM sw JOIN w USING (series))"
_EULER = "SELECT series, w, value / volatility AS marginal, w * value / volatility AS component, volatility AS total, w * value / volatility / volatility AS share FROM sw JOIN w USING (series), vol"
_EULER_D = "w marginal component total share"


@query("euler_volatility", _SW, _EULER, _EULER_D)
def _(spark, d):
    p = _aligned_m(spark, d)
    return contributions.volatility_contributions(_equal(p), covariance.sample_covariance(p))


@query(
    "portfolio_risk", f"{_NQ}, {_SW}, mu AS (SELECT sum(w * m) AS mean FROM (SELECT series, avg(r) AS m FROM panel GROUP BY 1) JOIN w USING (series))",
    "SELECT mean, volatility, -(mean + volatility * q) AS value_at_risk, -(mean + volatility * tl) AS expected_tail_loss, mean + volatility * q AS quantile FROM mu, vol, ntail WHERE p = 0.01",
    "mean volatility value_at_risk expected_tail_loss quantile",
)
def _(spark, d):
    p = _aligned_m(spark, d)
    return parametric.portfolio_risk(_equal(p), covariance.sample_covariance(p), series.moments(p).select("series", "mean"))


@query(
    "diversification", f"{_SW}, c AS ({_EULER})",
    "SELECT sum(c.w * sqrt(cov.v)) / max(total) AS diversification_ratio, CASE WHEN min(share) >= 0 THEN exp(-sum(CASE WHEN share > 0 THEN share * ln(share) ELSE 0 END)) END AS effective_bets, sum(share * share) AS concentration, arg_max(c.series, (component, c.series)) AS largest FROM c JOIN cov ON cov.i = c.series AND cov.j = c.series",
    "diversification_ratio effective_bets concentration",
)
def _(spark, d):
    p = _aligned_m(spark, d)
    c = covariance.sample_covariance(p)
    return contributions.diversification(contributions.volatility_contributions(_equal(p), c), c)


@query(
    "euler_es_historical", f"{_BOOK}, k AS (SELECT t, greatest(0.0, least(1.0, count(*) OVER () * {ALPHA} - (row_number() OVER (ORDER BY r, t) - 1))) AS part FROM book), mm AS (SELECT series, -sum(part * r) / sum(part) AS marginal FROM panel JOIN k USING (t) WHERE part > 0 GROUP BY 1)",
    "SELECT series, w, marginal, w * marginal AS component, sum(w * marginal) OVER () AS total, w * marginal / sum(w * marginal) OVER () AS share FROM mm JOIN w USING (series)", _EULER_D,
)
def _(spark, d):
    return contributions.historical_tail_loss_contributions(I.panel_li(spark, d), frames.weights_frame(spark, WEIGHTS), CONF)


# --- paths -----------------------------------------------------------------------------------------

_WEALTH = f"""{I.PANEL_LI}, wl AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) AS k, t, exp(sum(ln(1 + r)) OVER (PARTITION BY series ORDER BY t)) AS wealth FROM panel UNION ALL SELECT DISTINCT series, 0, NULL, 1.0 FROM panel),
dd AS (SELECT *, (peak - wealth) / peak AS drawdown FROM (SELECT *, max(wealth) OVER (PARTITION BY series ORDER BY k) AS peak FROM wl))"""


@query("wealth_drawdown", _WEALTH, "SELECT series, k, t, wealth, peak, drawdown FROM dd", "wealth peak drawdown")
def _(spark, d):
    return drawdown.drawdown_series(I.panel_li(spark, d))


@query(
    "max_drawdown", f"""{_WEALTH}, worst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY drawdown DESC, k) AS o FROM dd) WHERE o = 1),
e AS (SELECT w.series, min(CASE WHEN x.wealth = w.peak THEN x.k END) AS peak_at, min(CASE WHEN x.k >= w.k AND x.wealth >= w.peak THEN x.k END) AS recovery_at FROM worst w JOIN dd x USING (series) GROUP BY 1)""",
    "SELECT series, drawdown AS depth, peak_at, w.k AS trough_at, recovery_at, w.k - peak_at AS decline_periods, coalesce(recovery_at, w.k) - peak_at AS underwater_periods, drawdown / (1 - drawdown) AS recovery_return FROM worst w JOIN e USING (series)",
    "depth recovery_return",
)
def _(spark, d):
    return drawdown.maximum_drawdown(I.panel_li(spark, d)).select("series", "depth", "peak_at", "trough_at", "recovery_at", "decline_periods", "underwater_periods", "recovery_return")


@query(
    "drawdown_episodes", f"""{_WEALTH}, isl AS (SELECT *, sum(CASE WHEN wealth >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY k) AS island, min(CASE WHEN wealth >= peak THEN k END) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM dd),
ep AS (SELECT series, max(drawdown) AS depth, min(k) AS peak_at, max(nt) AS recovery_at, arg_min(k, (-drawdown, k)) AS trough_at FROM isl GROUP BY series, island HAVING max(drawdown) >= 0.02)""",
    "SELECT series, depth, peak_at, trough_at, recovery_at, row_number() OVER (PARTITION BY series ORDER BY depth DESC, peak_at) AS rank FROM ep", "depth",
)
def _(spark, d):
    return drawdown.drawdowns(I.panel_li(spark, d), minimum_depth=0.02).select("series", "depth", "peak_at", "trough_at", "recovery_at", "rank")


@query(
    "longest_underwater", f"""{_WEALTH}, isl AS (SELECT *, sum(CASE WHEN wealth >= peak THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY k) AS island, min(CASE WHEN wealth >= peak THEN k END) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nt FROM dd),
ep AS (SELECT series, max(drawdown) AS depth, min(k) AS peak_at, arg_min(k, (-drawdown, k)) AS trough_at, max(nt) AS recovery_at FROM isl GROUP BY series, island HAVING max(drawdown) > 0)""",
    "SELECT series, depth, peak_at, trough_at, recovery_at, coalesce(recovery_at, trough_at) - peak_at AS underwater_periods FROM ep QUALIFY row_number() OVER (PARTITION BY series ORDER BY coalesce(recovery_at, trough_at) - peak_at DESC, depth DESC, peak_at) = 1", "depth",
)
def _(spark, d):
    return drawdown.longest_underwater(I.panel_li(spark, d))


@query(
    "ulcer_sortino_calmar", f"""{_WEALTH}, a AS (SELECT series, max(drawdown) AS max_depth, sqrt(avg(drawdown * drawdown)) AS ulcer_index FROM dd GROUP BY 1),
b AS (SELECT series, sqrt(sum(least(r, 0) ** 2) / count(*)) AS downside_deviation, avg(r) AS mean, exp(sum(ln(1 + r)) * 52 / count(*)) - 1 AS ann FROM panel GROUP BY 1)""",
    "SELECT series, max_depth, ulcer_index, ann / max_depth AS calmar, ann / ulcer_index AS martin_ratio, downside_deviation, mean * 52 / (downside_deviation * sqrt(52)) AS sortino FROM a JOIN b USING (series)",
    "max_depth ulcer_index calmar martin_ratio downside_deviation sortino",
)
def _(spark, d):
    return drawdown.path_ratios(I.panel_li(spark, d), series.WEEKLY)


@query(
    "rolling_volatility", f"{I.PANEL_LI}, x AS (SELECT series, t, stddev_samp(r) OVER w * sqrt(52) AS volatility, row_number() OVER (PARTITION BY series ORDER BY t) AS k FROM panel WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))",
    "SELECT series, t, volatility FROM x WHERE k >= 26", "volatility",
)
def _(spark, d):
    return drawdown.rolling_volatility(I.panel_li(spark, d), 26, series.WEEKLY)


_ROLL = f"""{I.PANEL_LI}, o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY t) AS k FROM panel), f AS (SELECT a.series, a.t, b.k, exp(sum(ln(1 + b.r)) OVER (PARTITION BY a.series, a.t ORDER BY b.k)) AS w FROM o a JOIN o b ON b.series = a.series AND b.k BETWEEN a.k - 12 AND a.k WHERE a.k >= 13),
g AS (SELECT series, t, 1 - w / greatest(1.0, max(w) OVER (PARTITION BY series, t ORDER BY k)) AS dd FROM f)"""


@query("rolling_max_drawdown", _ROLL, "SELECT series, t, greatest(0.0, max(dd)) AS max_drawdown FROM g GROUP BY 1, 2", "max_drawdown")
def _(spark, d):
    return drawdown.rolling_maximum_drawdown(I.panel_li(spark, d), 13)


@query("rolling_ulcer_index", _ROLL, "SELECT series, t, sqrt(sum(dd * dd) / 14) AS ulcer_index FROM g GROUP BY 1, 2", "ulcer_index")
def _(spark, d):
    return drawdown.rolling_ulcer_index(I.panel_li(spark, d), 13)


# --- ranks -------------------------------------------------------------------------------------------

_RK = f"{I.PANEL_ORD_M}, rk AS (SELECT series, t, r, rank() OVER (PARTITION BY series ORDER BY r) + (count(*) OVER (PARTITION BY series, r) - 1) / 2.0 AS rank FROM panel)"


@query("ranks", _RK, "SELECT series, t, r, rank FROM rk", "r rank")
def _(spark, d):
    return ranks.ranks_of(I.panel_ord_m(spark, d))


@query("spearman", _RK.replace(I.PANEL_ORD_M, I.PANEL_ORD_A), "SELECT a.series AS i, b.series AS j, CASE WHEN a.series = b.series THEN 1.0 ELSE corr(a.rank, b.rank) END AS v FROM rk a JOIN rk b USING (t) GROUP BY 1, 2", "v")
def _(spark, d):
    return ranks.spearman_matrix(_aligned_m(spark, d))


_KT = f"""{I.PANEL_ORD_A}, pp AS (SELECT a.series AS i, b.series AS j, t, a.r AS x, b.r AS y FROM panel a JOIN panel b USING (t)),
kt AS (SELECT p.i, p.j, sum(sign(p.x - q.x) * sign(p.y - q.y)) / sqrt(sum(abs(sign(p.x - q.x))) * sum(abs(sign(p.y - q.y)))) AS v FROM pp p JOIN pp q ON p.i = q.i AND p.j = q.j AND p.t < q.t GROUP BY 1, 2)"""


@query("kendall", _KT, "SELECT i, j, v FROM kt WHERE i < j", "v")
def _(spark, d):
    return ranks.kendall_matrix(_aligned_m(spark, d)).where("i < j")


@query("kendall_matrix", _KT, "SELECT i, j, v FROM kt", "v")
def _(spark, d):
    return ranks.kendall_matrix(_aligned_m(spark, d))


@query("rank_inversions", _KT, f"SELECT i, j, sin({math.pi!r} * v / 2) AS from_kendall FROM kt WHERE i < j", "from_kendall")
def _(spark, d):
    return ranks.kendall_matrix(_aligned_m(spark, d)).where("i < j").select("i", "j", F.sin(F.col("v") * math.pi / 2).alias("from_kendall"))


# --- backtests and scores -----------------------------------------------------------------------------

_FC = f"{I.PANEL_LI}, {I.forecasts_sql()}"
_BR = f"{_FC}, br AS (SELECT *, r < -var AS breach, lag(r < -var) OVER (PARTITION BY series ORDER BY t) AS before FROM forecasts)"


@query("breaches", _BR, "SELECT series, t, r, var, es, breach FROM br", "r var es")
def _(spark, d):
    return backtest.exceedances(I.forecasts(spark, d))


_XL = lambda x, y: f"(CASE WHEN {x} > 0 THEN {x} * ln({y}) ELSE 0 END)"
_COVER = f"""{_BR}, c AS (SELECT series, count(*)::DOUBLE AS n, sum(breach::INT)::DOUBLE AS x, sum((NOT before AND NOT breach)::INT)::DOUBLE AS n00, sum((NOT before AND breach)::INT)::DOUBLE AS n01,
sum((before AND NOT breach)::INT)::DOUBLE AS n10, sum((before AND breach)::INT)::DOUBLE AS n11 FROM br GROUP BY 1),
p AS (SELECT *, x / n AS rate, n01 / (n00 + n01) AS p0, CASE WHEN n10 + n11 > 0 THEN n11 / (n10 + n11) ELSE 0 END AS p1, (n01 + n11) / (n00 + n01 + n10 + n11) AS pp FROM c),
s AS (SELECT *, greatest(0.0, -2 * ((n - x) * ln({CONF}) + x * ln({ALPHA}) - {_XL("(n - x)", "(1 - rate)")} - {_XL("x", "rate")})) AS unconditional,
greatest(0.0, 2 * ({_XL("n00", "(1 - p0)")} + {_XL("n01", "p0")} + {_XL("n10", "(1 - p1)")} + {_XL("n11", "p1")} - {_XL("(n00 + n10)", "(1 - pp)")} - {_XL("(n01 + n11)", "pp")})) AS independence FROM p)"""


@query(
    "coverage_tests", _COVER,
    f"SELECT series, n::BIGINT AS observations, x::BIGINT AS count, n * {ALPHA} AS expected, rate, n00::BIGINT AS n00, n01::BIGINT AS n01, n10::BIGINT AS n10, n11::BIGINT AS n11, unconditional, independence, unconditional + independence AS conditional, exp(-(unconditional + independence) / 2) AS conditional_p, n < 100 AS advisory FROM s",
    "expected rate unconditional independence conditional conditional_p",
)
def _(spark, d):
    return backtest.coverage_tests(backtest.exceedances(I.forecasts(spark, d)), CONF).drop("unconditional_p", "independence_p")


@query("coverage_p_values", _COVER, f"SELECT series, 2 - 2 * {_phi('sqrt(unconditional)')} AS unconditional_p, 2 - 2 * {_phi('sqrt(independence)')} AS independence_p FROM s", "unconditional_p independence_p")
def _(spark, d):
    return backtest.coverage_tests(backtest.exceedances(I.forecasts(spark, d)), CONF).select("series", "unconditional_p", "independence_p")


@query(
    "traffic_light", f"""RECURSIVE {_BR}, c AS (SELECT series, count(*) AS n, sum(breach::INT)::BIGINT AS x FROM br GROUP BY 1),
m AS (SELECT series, n, x, 0::BIGINT AS k, exp(n * ln(1 - {ALPHA}::DOUBLE)) AS mass, exp(n * ln(1 - {ALPHA}::DOUBLE)) AS total FROM c
UNION ALL SELECT series, n, x, k + 1, mass * (n - k) / (k + 1) * ({ALPHA}::DOUBLE / {CONF}::DOUBLE), total + mass * (n - k) / (k + 1) * ({ALPHA}::DOUBLE / {CONF}::DOUBLE) FROM m WHERE k < x)""",
    "SELECT series, n AS observations, x AS count, least(1.0, total) AS cumulative_probability, CASE WHEN total < 0.95 THEN 'green' WHEN total < 0.9999 THEN 'yellow' ELSE 'red' END AS zone, CAST(NULL AS DOUBLE) AS plus_factor FROM m WHERE k = x", "cumulative_probability",
)
def _(spark, d):
    return backtest.traffic_light(backtest.exceedances(I.forecasts(spark, d)), CONF)


#: The supervisory case: 250 forecasts at 99 %, the last ones of each series.
_SUPERVISORY = f"""RECURSIVE {_FC}, br AS (SELECT series, r < -var AS breach FROM forecasts QUALIFY row_number() OVER (PARTITION BY series ORDER BY t DESC) <= 250), c AS (SELECT series, count(*) AS n, sum(breach::INT)::BIGINT AS x FROM br GROUP BY 1),
m AS (SELECT series, n, x, 0::BIGINT AS k, exp(n * ln(0.99::DOUBLE)) AS mass, exp(n * ln(0.99::DOUBLE)) AS total FROM c UNION ALL SELECT series, n, x, k + 1, mass * (n - k) / (k + 1) / 99, total + mass * (n - k) / (k + 1) / 99 FROM m WHERE k < x),
z AS (SELECT series, n, x, least(1.0, total) AS total FROM m WHERE k = x)"""


@query(
    "traffic_light_supervisory", _SUPERVISORY,
    """SELECT series, n AS observations, x AS count, total AS cumulative_probability, CASE WHEN total < 0.95 THEN 'green' WHEN total < 0.9999 THEN 'yellow' ELSE 'red' END AS zone,
CASE WHEN n = 250 THEN CASE WHEN total >= 0.9999 THEN 1.0 ELSE coalesce([0.4, 0.5, 0.65, 0.75, 0.85][CASE WHEN x >= 5 THEN x - 4 END], 0.0) END END AS plus_factor FROM z""", "cumulative_probability plus_factor",
)
def _(spark, d):
    last = Window.partitionBy("series").orderBy(F.desc("t"))
    f = I.forecasts(spark, d).withColumn("k", F.row_number().over(last)).where("k <= 250").drop("k")
    return backtest.traffic_light(backtest.exceedances(f), 0.99)


@query(
    "acerbi_szekely", f"{_BR}, z AS (SELECT series, count(*) AS observations, sum(breach::INT)::BIGINT AS breaches, sum(CASE WHEN breach THEN r / es ELSE 0 END) AS s FROM br GROUP BY 1)",
    f"SELECT series, observations, breaches, s / breaches + 1 AS conditional, s / (observations * {ALPHA}) + 1 AS unconditional, -s / breaches AS realised_ratio, CASE WHEN breaches = 0 THEN 'no breaches' WHEN abs(-s / breaches - 1) <= 0.03 THEN 'in line' WHEN -s / breaches > 1 THEN 'understated' ELSE 'overstated' END AS direction FROM z", "conditional unconditional realised_ratio",
)
def _(spark, d):
    return backtest.expected_tail_loss_test(I.forecasts(spark, d), CONF)


@query("expected_tail_loss_null")
def _(spark, d):
    return backtest.simulate_expected_tail_loss_null(I.forecasts(spark, d), CONF)


@query("validate")
def _(spark, d):
    return backtest.validate(I.forecasts(spark, d), CONF)


@query("pinball", _FC, f"SELECT series, t, (-r - var) * ({CONF} - CASE WHEN -r < var THEN 1 ELSE 0 END) AS score FROM forecasts", "score")
def _(spark, d):
    return scoring.quantile_loss(I.forecasts(spark, d), CONF)


@query("fz0", _FC, f"SELECT series, t, greatest(-r - var, 0) / ({ALPHA}::DOUBLE * es) + var / es + ln(es) - 1 AS score FROM forecasts", "score")
def _(spark, d):
    return scoring.fz0_loss(I.forecasts(spark, d), CONF)


_DM = f"""{_FC}, {I.forecasts_sql(52, "slow")}, sc AS (SELECT series, t, greatest(-a.r - a.var, 0) / ({ALPHA}::DOUBLE * a.es) + a.var / a.es + ln(a.es) - (greatest(-b.r - b.var, 0) / ({ALPHA}::DOUBLE * b.es) + b.var / b.es + ln(b.es)) AS d
FROM forecasts a JOIN slow b USING (series, t)), c AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY t) AS k, d - avg(d) OVER (PARTITION BY series) AS c, avg(d) OVER (PARTITION BY series) AS mean, count(*) OVER (PARTITION BY series) AS n FROM sc),
l AS (SELECT *, CAST(least(floor(4 * pow(n / 100.0, {2 / 9!r})), n - 1) AS BIGINT) AS lags FROM c),
v AS (SELECT a.series, max(a.mean) AS difference, max(a.n) AS observations, max(a.lags) AS lags, sum(CASE WHEN a.k = b.k THEN 1.0 ELSE 2 * (1 - (a.k - b.k) / (a.lags + 1.0)) END * a.c * b.c) / max(a.n) AS lr, sum(CASE WHEN a.k = b.k THEN a.c * b.c END) / max(a.n) AS sr FROM l a JOIN l b ON a.series = b.series AND a.k - b.k BETWEEN 0 AND a.lags GROUP BY 1)"""


@query(
    "diebold_mariano", _DM,
    "SELECT series, difference, sqrt(greatest(lr, 0) / observations) AS standard_error, difference / sqrt(greatest(lr, 0) / observations) AS statistic, lags, sqrt(sr / observations) AS naive_standard_error, observations, CASE WHEN difference < 0 THEN 1 WHEN difference > 0 THEN 2 END::BIGINT AS better FROM v",
    "difference standard_error statistic naive_standard_error",
)
def _(spark, d):
    return scoring.compare(scoring.fz0_loss(I.forecasts(spark, d), CONF), scoring.fz0_loss(I.forecasts(spark, d, 52), CONF)).drop("p_value")


# --- bars ----------------------------------------------------------------------------------------------


@query("ohlc_bars", I.BARS, "SELECT series, t, open, high, low, close FROM bars", "open high low close")
def _(spark, d):
    return I.bars(spark, d)


_K = 2 * math.log(2) - 1


@query(
    "realised_six", f"""{I.BARS}, g AS (SELECT *, ln(open / lag(close) OVER (PARTITION BY series ORDER BY t)) AS gap, ln(close / open) AS co, ln(high / low) AS hl, ln(high / open) AS ho, ln(low / open) AS lo FROM bars),
e AS (SELECT *, 0.5 * hl * hl - {_K!r} * co * co AS gk, ho * (ho - co) + lo * (lo - co) AS rs FROM g),
a AS (SELECT series, count(*) AS bars, var_samp(gap + co) AS close_to_close, avg(hl * hl) / {4 * math.log(2)!r} AS parkinson, avg(gk) AS garman_klass, avg(rs) AS rogers_satchell, avg(CASE WHEN gap IS NOT NULL THEN gk + gap * gap END) AS garman_klass_yang_zhang,
var_samp(gap) AS vg, var_samp(CASE WHEN gap IS NOT NULL THEN co END) AS vc, avg(CASE WHEN gap IS NOT NULL THEN rs END) AS vr FROM e GROUP BY 1), k AS (SELECT *, 0.34 / (1.34 + bars / (bars - 2.0)) AS k FROM a)""",
    "SELECT series, bars, close_to_close, parkinson, garman_klass, rogers_satchell, garman_klass_yang_zhang, vg + k * vc + (1 - k) * vr AS yang_zhang FROM k",
    "close_to_close parkinson garman_klass rogers_satchell garman_klass_yang_zhang yang_zhang",
)
def _(spark, d):
    return realised.realised_variances(I.bars(spark, d))


@query("estimator_efficiency")
def _(spark, d):
    return realised.efficiency(I.bars(spark, d), realised.Estimator.PARKINSON)


# --- weighted tails ---------------------------------------------------------------------------------------

_SP = {"tail": spectra.TailSpectrum(0.05), "exponential": spectra.ExponentialSpectrum(20.0), "power": spectra.PowerSpectrum(10.0), "mixture": spectra.MixtureSpectrum(((0.01, 1.0), (0.1, 2.0)))}
_MASS = {
    "tail": "(least(b, 0.05) - least(a, 0.05)) / 0.05", "exponential": f"(exp(-20 * a) - exp(-20 * b)) / {-math.expm1(-20.0)!r}", "power": "pow(1 - a, 10) - pow(1 - b, 10)",
    "mixture": "(least(b, 0.01) - least(a, 0.01)) / 0.01 / 3 + (least(b, 0.1) - least(a, 0.1)) / 0.1 * 2 / 3",
}
_AB = f"{I.PANEL_LI}, {_RANKED}, ab AS (SELECT series, r, (rn - 1) / n::DOUBLE AS a, rn / n::DOUBLE AS b, avg(r) OVER (PARTITION BY series) AS mean FROM ranked)"


@query("spectral_risks", _AB, "SELECT series, " + ", ".join(f"sum(({m}) * r) AS {k}" for k, m in _MASS.items()) + " FROM ab GROUP BY 1", " ".join(_MASS))
def _(spark, d):
    return spectral.spectral_risks(I.panel_li(spark, d), _SP)


@query("spectral_wang")
def _(spark, d):
    return spectral.spectral_risks(I.panel_li(spark, d), {"wang": spectra.WangSpectrum(1.5)})


@query(
    "tail_share", _AB,
    f"SELECT series, sum(({_MASS['exponential']}) * (mean - r)) AS charge, sum((exp(-20 * least(a, 0.01)) - exp(-20 * least(b, 0.01))) / {-math.expm1(-20.0)!r} * (mean - r)) AS extreme, 0.01::DOUBLE AS probability, sum((exp(-20 * least(a, 0.01)) - exp(-20 * least(b, 0.01))) * (mean - r)) / sum((exp(-20 * a) - exp(-20 * b)) * (mean - r)) AS share FROM ab GROUP BY 1",
    "charge extreme probability share",
)
def _(spark, d):
    return spectral.tail_shares(I.panel_li(spark, d), _SP["exponential"], 0.01)


@query(
    "sample_expectile", f"""{I.PANEL_LI}, g AS (SELECT series, -r AS x, count(*) AS c FROM panel GROUP BY 1, 2),
q AS (SELECT series, x, lead(x) OVER (PARTITION BY series ORDER BY x) AS nx, sum(c) OVER (PARTITION BY series ORDER BY x) AS nb, sum(c * x) OVER (PARTITION BY series ORDER BY x) AS sb, sum(c) OVER (PARTITION BY series) AS n, sum(c * x) OVER (PARTITION BY series) AS s FROM g),
e AS (SELECT *, ({CONF} * (s - sb) + {ALPHA} * sb) / ({CONF} * (n - nb) + {ALPHA} * nb) AS e FROM q)""",
    f"SELECT series, {CONF}::DOUBLE AS level, e AS value, ((s - sb) - (n - nb) * e) / n AS upper, (nb * e - sb) / n AS lower, s / n AS mean FROM e WHERE (nx IS NULL OR (e >= x AND e <= nx)) QUALIFY row_number() OVER (PARTITION BY series ORDER BY x) = 1",
    "level value upper lower mean",
)
def _(spark, d):
    return expectile.sample_expectiles(I.panel_li(spark, d).select("series", (-F.col("r")).alias("loss")), CONF)


#: The level by 50 halvings: the mean of level * excess - (1 - level) * shortfall grows with the level.
_LEVEL = f"""RECURSIVE {I.PANEL_LI}, ls AS (SELECT series, -r AS x FROM panel), g AS (SELECT series, quantile_disc(x, 0.975) AS target FROM ls GROUP BY 1),
b AS (SELECT series, target, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM g UNION ALL
SELECT series, target, CASE WHEN s < 0 THEN m ELSE lo END, CASE WHEN s < 0 THEN hi ELSE m END, step + 1 FROM (SELECT b.series, target, lo, hi, step, (lo + hi) / 2 AS m, sum(CASE WHEN x > target THEN (lo + hi) / 2 * (x - target) ELSE (1 - (lo + hi) / 2) * (x - target) END) AS s FROM b JOIN ls ON ls.series = b.series WHERE step < 50 GROUP BY ALL))"""


@query("matching_levels", _LEVEL, "SELECT series, target, (lo + hi) / 2 AS level FROM b WHERE step = 50", "target level")
def _(spark, d):
    losses = I.panel_li(spark, d).select("series", (-F.col("r")).alias("loss"))
    return expectile.matching_levels(losses, losses.groupBy("series").agg(F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY loss)").alias("target")))


_WT = f"{I.PANEL_LI}, wt AS (SELECT series, t, r, (t % 7 + 1) / sum(t % 7 + 1) OVER (PARTITION BY series) AS w FROM panel), cu AS (SELECT *, sum(w) OVER (PARTITION BY series ORDER BY r, t) AS cum FROM wt)"


def _weighted_li(spark, d):
    w = (F.pmod(F.col("t"), F.lit(7)) + 1).cast("double")
    return I.panel_li(spark, d).withColumn("w", w / F.sum(w).over(frames.of_series()))


@query("weighted_quantile", _WT, "SELECT series, min(r) AS quantile FROM cu WHERE cum >= 0.05 - 1e-15 GROUP BY 1", "quantile")
def _(spark, d):
    return entropy.weighted_quantile(_weighted_li(spark, d), 0.05)


@query("weighted_expected_tail_loss", _WT, "SELECT series, sum(w * r) / sum(w) AS tail_mean, sum(w) AS mass FROM cu WHERE cum - w < 0.05 - 1e-15 GROUP BY 1", "tail_mean mass")
def _(spark, d):
    return entropy.weighted_expected_tail_loss(_weighted_li(spark, d), 0.05)


@query(
    "stressed_risk", f"{_WT}, m AS (SELECT series, sum(w * r) AS mean, sum(w * r * r) AS sq FROM wt GROUP BY 1), q AS (SELECT series, min(r) AS q FROM cu WHERE cum >= 0.05 - 1e-15 GROUP BY 1), tl AS (SELECT series, sum(w * r) / sum(w) AS tm FROM cu WHERE cum - w < 0.05 - 1e-15 GROUP BY 1)",
    "SELECT series, -q AS value_at_risk, -tm AS expected_tail_loss, mean, sqrt(greatest(0.0, sq - mean * mean)) AS volatility FROM m JOIN q USING (series) JOIN tl USING (series)", "value_at_risk expected_tail_loss mean volatility",
)
def _(spark, d):
    return entropy.stressed_risk(_weighted_li(spark, d), 0.95)


@query(
    "relative_entropy", f"{I.PANEL_LI}, wt AS (SELECT (t % 7 + 1)::DOUBLE / sum(t % 7 + 1) OVER () AS w, count(*) OVER () AS n FROM panel)",
    "SELECT sum(w * ln(w * n)) AS relative_entropy, exp(-sum(w * ln(w))) AS effective_scenarios FROM wt", "relative_entropy effective_scenarios",
)
def _(spark, d):
    rows = I.panel_li(spark, d).withColumn("w", (F.pmod(F.col("t"), F.lit(7)) + 1).cast("double"))
    total = rows.agg(F.sum("w").alias("total"))
    return entropy.relative_entropy(rows.crossJoin(F.broadcast(total)).withColumn("w", F.col("w") / F.col("total")))  # total is one row


@query(
    "probability_view", f"{I.PANEL_LI}, s AS (SELECT series, t, r, r < 0 AS inside, 1.0::DOUBLE / count(*) OVER () AS p FROM panel), m AS (SELECT sum(CASE WHEN inside THEN p ELSE 0 END) AS mi FROM s)",
    "SELECT series, t, r, CASE WHEN inside THEN p * 0.6 / mi ELSE p * 0.4 / (1 - mi) END AS w FROM s, m", "r w",
)
def _(spark, d):
    p = I.panel_li(spark, d)
    n = p.agg(F.count("*").alias("n"))
    s = p.crossJoin(F.broadcast(n)).select("series", "t", "r", (F.col("r") < 0).alias("inside"), (1.0 / F.col("n")).alias("p"))  # n is one row
    return entropy.tilt_to_probability(s, "inside", 0.6).select("series", "t", "r", "w")


@query("entropy_pool")
def _(spark, d):
    p = frames.cut(I.panel_li(spark, d).select("series", "t", "r", (F.col("r") * F.col("r")).alias("r2")))
    m = p.agg(F.avg("r"), F.stddev_samp("r"), F.avg("r2")).first()
    post = entropy.pool(p, [entropy.mean_view("r", m[0] - 0.2 * m[1]), entropy.mean_view("r2", 1.2 * m[2])])
    return post.scenarios.select("series", "t", "r", "w")


@query(
    "mean_excess", f"""{I.PANEL_LI}, ls AS (SELECT series, -r AS loss, row_number() OVER (PARTITION BY series ORDER BY -r) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM panel),
b AS (SELECT series, max(n) AS n, CAST(floor(max(n) * 0.5) AS BIGINT) AS f, max(n) - 11 AS l FROM ls GROUP BY 1), gr AS (SELECT DISTINCT series, f + CAST(floor((l - f) * i / 19.0) AS BIGINT) AS i FROM b, range(20) x(i)),
th AS (SELECT DISTINCT series, loss AS threshold FROM ls JOIN gr USING (series, i))""",
    "SELECT series, threshold, count(*) AS exceedances, avg(loss - threshold) AS mean_excess, stddev_samp(loss - threshold) / sqrt(count(*)) AS standard_error FROM th JOIN ls USING (series) WHERE loss > threshold GROUP BY 1, 2 HAVING count(*) >= 10",
    "threshold mean_excess standard_error",
)
def _(spark, d):
    return extreme.mean_excess_curve(extreme.losses_of(I.panel_li(spark, d)))


@query(
    "hill_curve", f"""{I.PANEL_LI}, ls AS (SELECT series, -r AS loss, row_number() OVER (PARTITION BY series ORDER BY r) AS k FROM panel WHERE r < 0),
h AS (SELECT series, k - 1 AS m, loss, sum(ln(loss)) OVER (PARTITION BY series ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM ls)""",
    "SELECT series, m AS order_statistics, s / m - ln(loss) AS shape, (s / m - ln(loss)) / sqrt(m) AS standard_error, loss AS threshold FROM h WHERE m >= 10", "shape standard_error threshold",
)
def _(spark, d):
    return extreme.hill_curve(extreme.losses_of(I.panel_li(spark, d)), points=None)


_PWM = f"""{I.PANEL_LI}, ls AS (SELECT series, -r AS loss, row_number() OVER (PARTITION BY series ORDER BY r) AS k, count(*) OVER (PARTITION BY series) AS n FROM panel),
u AS (SELECT series, loss AS threshold, n FROM ls WHERE k = round_even(n * 0.1, 0)), ex AS (SELECT series, threshold, u.n, loss - threshold AS y, row_number() OVER (PARTITION BY series ORDER BY loss) AS rn, count(*) OVER (PARTITION BY series) AS m FROM ls JOIN u USING (series) WHERE loss > threshold),
a AS (SELECT series, max(threshold) AS threshold, count(*) AS exceedances, max(n) AS observations, avg(y) AS a0, avg((1 - (rn - 0.35) / m) * y) AS a1 FROM ex GROUP BY 1),
g AS (SELECT series, threshold, exceedances, observations, 2 - a0 / (a0 - 2 * a1) AS shape, 2 * a0 * a1 / (a0 - 2 * a1) AS scale FROM a)"""


@query("gpd_pwm", _PWM, "SELECT * FROM g", "threshold shape scale")
def _(spark, d):
    return extreme.pwm_tails(extreme.losses_of(I.panel_li(spark, d)), 0.1)


@query(
    "extreme_risk_pwm", f"{_PWM}, v AS (SELECT *, threshold + scale * (pow(0.01 * observations / exceedances, -shape) - 1) / shape AS value_at_risk FROM g), bb AS (SELECT series, sum((loss >= value_at_risk)::INT)::BIGINT AS observed_beyond FROM ls JOIN v USING (series) GROUP BY 1)",
    "SELECT series, shape, scale, value_at_risk, (value_at_risk + scale - shape * threshold) / (1 - shape) AS expected_tail_loss, observed_beyond, observed_beyond = 0 AS is_extrapolated FROM v JOIN bb USING (series)",
    "shape scale value_at_risk expected_tail_loss",
)
def _(spark, d):
    x = extreme.extreme_risk(I.panel_li(spark, d), 0.99, 0.1, extreme.TailMethod.PROBABILITY_WEIGHTED_MOMENTS)
    return x.select("series", "shape", "scale", "value_at_risk", "expected_tail_loss", "observed_beyond", "is_extrapolated")


@query("extreme_risk_mle")
def _(spark, d):
    return extreme.extreme_risk(I.panel_li(spark, d), 0.99, 0.1)


# --- recursions, factors ------------------------------------------------------------------------------------

_GARCH = f"""RECURSIVE {I.PANEL_LI}, o AS (SELECT series, t, r, row_number() OVER (PARTITION BY series ORDER BY t) AS k, var_pop(r) OVER (PARTITION BY series) AS v0 FROM panel),
e AS (SELECT series, t, r, k, v0 AS v FROM o WHERE k = 1 UNION ALL SELECT o.series, o.t, o.r, o.k, 1e-4::DOUBLE + 0.08::DOUBLE * e.r * e.r + 0.9::DOUBLE * e.v FROM e JOIN o ON o.series = e.series AND o.k = e.k + 1)"""


@query("garch_variances_fixed", _GARCH, "SELECT series, t, r, v AS variance, last_value(1e-4::DOUBLE + 0.08::DOUBLE * r * r + 0.9::DOUBLE * v) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS next_variance FROM e", "r variance next_variance")
def _(spark, d):
    return volatility.garch_variances(I.panel_li(spark, d), omega=1e-4, alpha=0.08, beta=0.9)


@query("garch_fit")
def _(spark, d):
    return volatility.fit_garch_models(I.panel_li(spark, d))


@query("garch_forecast_series")
def _(spark, d):
    return volatility.garch_forecast_series(I.panel_li(spark, d))


@query("fat_tail_test")
def _(spark, d):
    def test(pdf):
        t = volatility.fat_tail_test(pdf.sort_values("t")["r"].to_numpy())
        return pd.DataFrame({"series": pdf["series"].iloc[:1], "statistic": t.statistic, "p_value": t.p_value, "degrees": t.degrees, "fat": t.fat})

    return I.panel_li(spark, d).groupBy("series").applyInPandas(test, "series string, statistic double, p_value double, degrees double, fat boolean")


@query("horizon_risk")
def _(spark, d):
    panel, rows = frames.cut(I.panel_li(spark, d)), []
    for name in sorted(r[0] for r in panel.select("series").distinct().collect()):
        x = series.ReturnSeries(panel, name).values()
        h = horizon.horizon_risk(spark, volatility.fit_garch(x, strict=False), x, steps=10)
        rows.append((name, h.value_at_risk, h.expected_tail_loss, h.additive_value_at_risk, h.standard_error, h.compounding_factor))
    return spark.createDataFrame(rows, "series string, value_at_risk double, expected_tail_loss double, additive_value_at_risk double, standard_error double, compounding_factor double")


_F1 = f"""{I.PANEL_ORD_A}, f AS (SELECT t, avg(r) AS f FROM panel GROUP BY 1), b AS (SELECT series, t, r, f FROM panel JOIN f USING (t)),
g AS (SELECT series, regr_slope(r, f) AS beta, regr_intercept(r, f) AS alpha, regr_r2(r, f) AS r_squared, count(*) AS observations FROM b GROUP BY 1),
e AS (SELECT series, t, r - alpha - beta * f AS e FROM b JOIN g USING (series)), dw AS (SELECT series, sum(e * e) AS sse, sum(dd * dd) AS ssd FROM (SELECT series, e, e - lag(e) OVER (PARTITION BY series ORDER BY t) AS dd FROM e) GROUP BY 1)"""


@query("single_factor_regression", _F1, "SELECT series, beta, alpha, r_squared, observations, sse / (observations - 2) AS specific_variance, ssd / sse AS durbin_watson FROM g JOIN dw USING (series)", "beta alpha r_squared specific_variance durbin_watson")
def _(spark, d):
    p = _aligned_m(spark, d)
    return factors.single_factor(p, p.groupBy("t").agg(F.avg("r").alias("f")))


def _model(spark, d):
    p = _aligned_m(spark, d)
    f = p.groupBy("t").agg(F.avg("r").alias("r")).select(F.lit("market").alias("series"), "t", "r")
    return p, factors.fit_factor_model(p, f)


@query(
    "factor_attribution", f"{_F1}, {_EQ}, x AS (SELECT sum(w * beta) AS x, sum(w * w * sse / (observations - 2)) AS s2 FROM g JOIN dw USING (series) JOIN w USING (series)), v AS (SELECT x, s2, x * x * (SELECT var_samp(f) FROM f) AS f2 FROM x)",
    "SELECT 'market' AS factor, x AS exposure, f2 / sqrt(f2 + s2) AS component, sqrt(f2 + s2) AS total, sqrt(f2) AS factor_volatility, sqrt(s2) AS specific_volatility, f2 / (f2 + s2) AS factor_share FROM v",
    "exposure component total factor_volatility specific_volatility factor_share",
)
def _(spark, d):
    p, m = _model(spark, d)
    return factors.attribute_risk(_equal(p), m)


@query("factor_implied_covariance", f"{_F1}, vf AS (SELECT var_samp(f) AS vf FROM f)", "SELECT a.series AS i, b.series AS j, a.beta * b.beta * vf + CASE WHEN a.series = b.series THEN dw.sse / (a.observations - 2) ELSE 0 END AS v FROM g a, g b, vf, dw WHERE dw.series = a.series", "v")
def _(spark, d):
    return _model(spark, d)[1].implied_covariance()


@query("residual_correlations", _F1, "SELECT a.series AS i, b.series AS j, CASE WHEN a.series = b.series THEN 1.0 ELSE corr(a.e, b.e) END AS v FROM e a JOIN e b USING (t) GROUP BY 1, 2", "v")
def _(spark, d):
    return _model(spark, d)[1].residual_correlations()


# --- obligors, small matrices, fits --------------------------------------------------------------------------


@query("obligor_moments", I.OBLIGORS, "SELECT count(*) AS names, sum(probability * exposure) AS mean, sum(probability * (1 - probability) * exposure * exposure) AS variance, sum(exposure) AS maximum FROM obligors", "mean variance maximum")
def _(spark, d):
    return saddlepoint.portfolio_moments(I.obligors(spark, d))


@query(
    "obligor_cumulants", f"{I.OBLIGORS}, q AS (SELECT *, probability / (probability + (1 - probability) * exp(-0.01::DOUBLE * exposure)) AS q FROM obligors)",
    "SELECT sum(ln(1 + probability * (exp(0.01::DOUBLE * exposure) - 1))) AS cumulant, sum(q * exposure) AS first, sum(q * (1 - q) * exposure ** 2) AS second, sum(q * (1 - q) * (1 - 2 * q) * exposure ** 3) AS third FROM q", "cumulant first second third",
)
def _(spark, d):
    return saddlepoint.cumulants_at(I.obligors(spark, d), 0.01)


@query("obligor_tail")
def _(spark, d):
    p = saddlepoint.grouped(I.obligors(spark, d))
    levels = [round(p.mean + k * math.sqrt(p.variance)) for k in (0, 1, 2, 3)]
    return spark.createDataFrame([(float(x), saddlepoint.exceedance_probability(p, x), saddlepoint.normal_tail(p, x)) for x in levels], "level double, probability double, normal double")


#: Masses by one convolution step an obligor, and their tails.
_MASSES = f"""{I.OBLIGORS}, o AS (SELECT probability AS p, CAST(exposure AS BIGINT) AS k, row_number() OVER (ORDER BY obligor) AS i FROM obligors),
RECURSIVE c AS (SELECT 0::BIGINT AS i, [1.0::DOUBLE] AS m UNION ALL
  SELECT o.i, list_transform(list_zip(list_concat(list_transform(m, lambda x: x * (1 - p)), list_transform(range(0, k), lambda x: 0.0::DOUBLE)), list_concat(list_transform(range(0, k), lambda x: 0.0::DOUBLE), list_transform(m, lambda x: x * p))), lambda z: z[1] + z[2]) FROM c JOIN o ON o.i = c.i + 1),
masses AS MATERIALIZED (SELECT x, mass, coalesce(sum(mass) OVER (ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tail FROM (SELECT unnest(m) AS mass, unnest(range(0, len(m))) AS x FROM c WHERE i = (SELECT count(*) FROM o))),
level AS (SELECT CAST(round(sum(p * k) + 2 * sqrt(sum(p * (1 - p) * k * k))) AS BIGINT) AS a FROM o)"""


def _obligor_level(obligors) -> float:
    m = saddlepoint.portfolio_moments(obligors).first()
    return float(round(m["mean"] + 2 * math.sqrt(m["variance"])))


@query("obligor_exact", _MASSES, "SELECT CAST(x AS DOUBLE) AS loss, mass, tail FROM masses WHERE mass >= 1e-9", "mass tail")
def _(spark, d):
    return lossgrid.tails(lossgrid.exact_masses(I.obligors(spark, d))).where("mass >= 1e-9")


@query(
    "obligor_exact_tail", f"{_MASSES}, l AS (SELECT a + 0.0 AS level FROM level UNION ALL SELECT 0.0)", "SELECT level, sum(mass) AS probability, sum(mass * x) / sum(mass) AS tail_loss FROM l JOIN masses ON x > level GROUP BY level", "level probability tail_loss",
)
def _(spark, d):
    o = I.obligors(spark, d)
    return lossgrid.exact_tail(lossgrid.exact_masses(o), [0.0, _obligor_level(o)])


@query(
    "obligor_contributions", f"""{_MASSES}, q AS (SELECT DISTINCT p, k, a FROM o, level),
g AS (SELECT p, k, a, (a - k) % k AS y, (tail - p) / (1 - p) AS g FROM q JOIN masses ON x = (a - k) % k WHERE a >= k UNION ALL
  SELECT p, k, a, y + k, (tail - p * g) / (1 - p) FROM g JOIN masses ON x = y + k WHERE y + k <= a - k)""",
    "SELECT obligor, probability, exposure, exposure * probability * coalesce(g, 1) / (SELECT sum(mass) FROM masses, level WHERE x > a) AS contribution FROM obligors CROSS JOIN level LEFT JOIN g ON g.p = probability AND g.k = exposure AND y = level.a - g.k", "probability exposure contribution",
)
def _(spark, d):
    o = I.obligors(spark, d)
    return lossgrid.tail_contributions(o, _obligor_level(o))


@query(
    "mp_band", f"{I.PANEL_ORD_A}, n AS (SELECT count(DISTINCT series) AS n, count(DISTINCT t) AS t FROM panel)", "SELECT n AS assets, t AS observations, (1 - sqrt(n / t::DOUBLE)) ** 2 AS lower, (1 + sqrt(n / t::DOUBLE)) ** 2 AS upper, sqrt(n / t::DOUBLE) AS detection FROM n", "lower upper detection",
)
def _(spark, d):
    p = _aligned_m(spark, d)
    n, t = p.select("series").distinct().count(), p.select("t").distinct().count()
    low, high = cleaning.marchenko_pastur_edges(n, t)
    return spark.createDataFrame([(n, t, low, high, cleaning.detection_threshold(n, t))], "assets bigint, observations bigint, lower double, upper double, detection double")


@query("clip_spectrum")
def _(spark, d):
    c = cleaning.clip_spectrum(_aligned_m(spark, d))
    return frames.matrix_frame(spark, c.names, c.covariance)


@query("compare_estimators")
def _(spark, d):
    return spark.createDataFrame([(o.estimator, o.variance, o.concentration) for o in cleaning.compare_estimators(_aligned_m(spark, d))], "estimator string, variance double, concentration double")


@query("risk_parity")
def _(spark, d):
    names, m = frames.matrix(covariance.sample_covariance(_aligned_m(spark, d)))
    r = contributions.risk_parity(m, names=names)
    return spark.createDataFrame([(n, float(w), float(b)) for n, w, b in zip(r.names, r.weights, r.budgets, strict=True)], "series string, weight double, budget double")


@query("principal_bets")
def _(spark, d):
    names, m = frames.matrix(covariance.sample_covariance(_aligned_m(spark, d)))
    b = contributions.principal_bets([1 / len(names)] * len(names), m)
    return spark.createDataFrame([(k, float(p), float(v)) for k, (p, v) in enumerate(zip(b.distribution, b.variances, strict=True))], "bet int, share double, variance double")


def _book(spark, d):
    """A book that holds each series in inverse proportion to its deviation, with its skewness as curvature."""
    p = _aligned_m(spark, d)
    names, m = frames.matrix(covariance.sample_covariance(p))
    own = {r["series"]: r for r in series.moments(p).collect()}
    size = [1 / own[n]["stdev"] for n in names]
    return quadratic.Exposure(np.array(size) / sum(size), np.diag([own[n]["skewness"] for n in names])), m


@query("quadratic_risk")
def _(spark, d):
    e, m = _book(spark, d)
    f = quadratic.standard_form(e, m)
    r = quadratic.quadratic_risk(f, 0.99)
    return spark.createDataFrame([tuple(map(float, (r.value_at_risk, r.expected_tail_loss, r.skewness, -quadratic.delta_normal_quantile(f, 0.01))))], "value_at_risk double, expected_tail_loss double, skewness double, delta_normal double")


@query("worst_case_scenario")
def _(spark, d):
    e, m = _book(spark, d)
    r = stress.radius_for(0.99, len(m))
    return spark.createDataFrame([tuple(map(float, (stress.worst_case_scenario(e, m, r).loss, stress.one_at_a_time(e, m, r).worst, r)))], "loss double, one_at_a_time double, radius double")


@query("linear_maximum_loss", f"{_R5}, {_SW}", "SELECT z * volatility AS loss FROM radius, vol", "loss")
def _(spark, d):
    names, m = frames.matrix(covariance.sample_covariance(_aligned_m(spark, d)))
    loss = stress.linear_maximum_loss([1 / len(names)] * len(names), m, stress.radius_for(0.99, len(names)))
    return spark.createDataFrame([(float(loss),)], "loss double")


@query(
    "mixture_convolve", f"{I.PANEL_LI}, h AS (SELECT series, t % 2 AS half, -avg(r) AS mean, stddev_samp(r) AS deviation FROM panel GROUP BY 1, 2), c AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY half) AS weight FROM h)",
    "SELECT a.weight * b.weight AS weight, a.mean + b.mean AS mean, sqrt(a.deviation * a.deviation + b.deviation * b.deviation) AS deviation FROM c a JOIN c b ON a.half = 0 AND b.half = 1", "weight mean deviation",
)
def _(spark, d):
    h = I.panel_li(spark, d).groupBy("series", (F.col("t") % 2).alias("half")).agg((-F.avg("r")).alias("mean"), F.stddev_samp("r").alias("deviation"))
    c = h.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("half"))).select("half", "weight", "mean", "deviation")
    return mixture.convolve_frames(c.where("half = 0").drop("half"), c.where("half = 1").drop("half"))


_EM_STEPS, _LN_TAU = 10, "0.5 * ln(2 * pi())"
#: Steps of expectation maximisation: each joins every loss with both components and adds up.
_EM = f"""RECURSIVE {I.PANEL_LI}, ls AS (SELECT series, -r AS loss FROM panel), c AS (SELECT series, count(*) AS n, avg(loss) AS centre, stddev_samp(loss) AS sd, quantile_disc(loss, 0.25) AS a, quantile_disc(loss, 0.75) AS b FROM ls GROUP BY 1),
x AS (SELECT series, n, loss - centre AS x FROM ls JOIN c USING (series)),
em AS (SELECT series, 0 AS step, 0.5::DOUBLE AS w1, a - centre AS m1, sd AS s1, 0.5::DOUBLE AS w2, b - centre AS m2, sd AS s2, 0.0::DOUBLE AS ll FROM c UNION ALL
SELECT series, step + 1, sum(p) / max(n), sum(p * x) / sum(p), sqrt(sum(p * x * x) / sum(p) - (sum(p * x) / sum(p)) ** 2), sum(1 - p) / max(n), sum((1 - p) * x) / sum(1 - p), sqrt(sum((1 - p) * x * x) / sum(1 - p) - (sum((1 - p) * x) / sum(1 - p)) ** 2), sum(ln(l1 + l2))
FROM (SELECT series, step, n, x, l1, l2, l1 / (l1 + l2) AS p FROM (SELECT em.*, n, x, w1 / s1 * exp(-(x - m1) * (x - m1) / s1 / s1 / 2 - {_LN_TAU}) AS l1, w2 / s2 * exp(-(x - m2) * (x - m2) / s2 / s2 / 2 - {_LN_TAU}) AS l2 FROM em JOIN x USING (series) WHERE step < {_EM_STEPS})) GROUP BY series, step),
parts AS (SELECT series, w1 AS weight, m1 + centre AS mean, s1 AS deviation, ll AS log_likelihood FROM em JOIN c USING (series) WHERE step = {_EM_STEPS} UNION ALL SELECT series, w2, m2 + centre, s2, ll FROM em JOIN c USING (series) WHERE step = {_EM_STEPS})"""


@query("mixture_steps", _EM, "SELECT series, row_number() OVER (PARTITION BY series ORDER BY deviation) - 1 AS component, weight, mean, deviation, log_likelihood FROM parts", "weight mean deviation log_likelihood")
def _(spark, d):
    return mixture.fit_by_steps(extreme.losses_of(I.panel_li(spark, d)), steps=_EM_STEPS, every=5, tolerance=0.0)


@query("mixture_fit")
def _(spark, d):
    return mixture.fit_mixtures(extreme.losses_of(I.panel_li(spark, d)))


@query("regime_horizon")
def _(spark, d):
    """Calm and stressed periods of each series by the size of their returns, how long either lasts, and the loss over ten periods."""
    rows = I.panel_li(spark, d)
    middle = rows.groupBy("series").agg(F.percentile(F.abs("r"), F.lit(0.8)).alias("middle"))
    rows = rows.join(middle, "series").select("series", "t", (-F.col("r")).alias("x"), (F.abs("r") > F.col("middle")).alias("stressed"))
    rows = rows.withColumn("after", F.lead("stressed").over(Window.partitionBy("series").orderBy("t")))
    kind = lambda f, c, s: f(F.when(F.col("stressed") == s, F.col(c)))
    stay = lambda s: (F.count_if((F.col("stressed") == s) & (F.col("after") == s)) / F.count_if((F.col("stressed") == s) & F.col("after").isNotNull()))
    stats = rows.groupBy("series").agg(*[c.alias(f"{n}{k}") for k, s in enumerate((False, True)) for n, c in (("mean", kind(F.avg, "x", s)), ("sd", kind(F.stddev_samp, "x", s)), ("stay", stay(s)))])

    def run(parts):
        for part in parts:
            out = []
            for r in part.itertuples():
                chain = (float(r.stay0), float(r.stay1))
                h = mixture.horizon_mixture(mixture.Component(1, r.mean0, r.sd0), mixture.Component(1, r.mean1, r.sd1), chain, mixture.stationary(chain), 10)
                risk = mixture.mixture_risk(h, 0.99)
                out.append((r.series, risk.value_at_risk, risk.expected_tail_loss, risk.averaging_error))
            yield pd.DataFrame(out, columns=["series", "value_at_risk", "expected_tail_loss", "averaging_error"])

    return stats.mapInPandas(run, "series string, value_at_risk double, expected_tail_loss double, averaging_error double")


@query("dependence_bounds")
def _(spark, d):
    m = series.moments(I.panel_li(spark, d)).orderBy("series").collect()
    b = bounds.dependence_bounds([bounds.normal_loss(-r["mean"], r["stdev"], label=r["series"]) for r in m], points=128)
    return spark.createDataFrame([(*b.enclosing, *b.attainable, b.comonotonic, b.ratio)], "lower double, upper double, attained_low double, attained_high double, comonotonic double, ratio double")


@query("copula_fit")
def _(spark, d):
    f = copula.fit_copula(series.aligned(I.panel_li(spark, d)))
    return spark.createDataFrame([(*t.pair, t.correlation, t.coefficient, f.degrees_of_freedom) for t in f.tail_dependence()], "i string, j string, correlation double, coefficient double, degrees double")


@query("copula_risk")
def _(spark, d):
    r = copula.copula_risk(I.panel_li(spark, d), WEIGHTS, degrees_of_freedom=5.0)
    return spark.createDataFrame([(r.value_at_risk, r.expected_tail_loss, r.gaussian_expected_tail_loss, r.tail_dependence_premium)], "value_at_risk double, expected_tail_loss double, gaussian_expected_tail_loss double, premium double")
