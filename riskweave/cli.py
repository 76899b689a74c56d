"""Command line: 20 commands over files, printed as a table or as JSON (``--json`` before or after the command)."""

from __future__ import annotations

import argparse
import dataclasses
import math
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.errors import InputError
from riskweave.functions import special
from riskweave.functions.spectra import ExponentialSpectrum, PowerSpectrum, TailSpectrum, WangSpectrum
from riskweave.operators import (
    backtest, bounds, cleaning, contributions, copula, covariance, drawdown, entropy, expectile, extreme, factors, frames, historical, horizon, lossgrid, mixture, parametric, quadratic, realised, saddlepoint,
    scoring, series, spectral, stress, volatility,
)
from riskweave.sources import readers


def _rows(frame: DataFrame) -> list[dict]:
    return [r.asDict() for r in frame.collect()]


class Input:
    """The returns file of a command, with weights (equal where none are given)."""

    def __init__(self, spark: SparkSession, a) -> None:
        self.spark = spark
        self.panel, self.names = readers.read_returns(spark, a.returns)
        self.panel = self.panel.cache()
        given = getattr(a, "weights", None)
        values = [float(x) for x in given.split(",")] if given else [1 / len(self.names)] * len(self.names)
        if len(values) != len(self.names):
            raise InputError(f"{len(self.names)} weights are needed")
        self.weights = dict(zip(self.names, values, strict=True))
        self.w = frames.weights_frame(spark, self.weights)
        self.shrink = bool(getattr(a, "shrink", False))

    def covariance(self) -> DataFrame:
        return covariance.ledoit_wolf(self.panel).select("i", "j", "v") if self.shrink else covariance.sample_covariance(self.panel)

    def array(self) -> np.ndarray:
        names, m = frames.matrix(self.covariance())
        order = [names.index(n) for n in self.names]
        return m[np.ix_(order, order)]

    def book(self) -> DataFrame:
        return series.portfolio(self.panel, self.weights)

    def column(self, name: str | None) -> np.ndarray:
        one = self.book() if name is None else self.panel.where(F.col("series") == name)
        x = np.array([r[0] for r in one.orderBy("t").select("r").collect()])
        if not len(x):
            raise InputError(f"no column {name}")
        return x


def risk(spark, a):
    x = Input(spark, a)
    d = parametric.Distribution(a.distribution)
    shape = {"degrees": a.degrees} if d == parametric.Distribution.STUDENT_T else {}
    if d == parametric.Distribution.CORNISH_FISHER:
        m = series.moments(x.book()).first()
        shape = {"skewness": m["skewness"], "excess_kurtosis": m["excess_kurtosis"]}
    model = _rows(parametric.portfolio_risk(x.w, x.covariance(), series.moments(x.panel).select("series", "mean"), a.confidence, d, **shape))[0]
    own = _rows(historical.historical_risk(x.book(), a.confidence))[0]
    out = {"distribution": str(d), **model, **{f"historical_{k}": own[k] for k in ("value_at_risk", "expected_tail_loss", "effective_sample")}}
    if a.periods:
        out["annualised_volatility"] = out["volatility"] * math.sqrt(a.periods)
    return [out]


def contributions_(spark, a):
    x = Input(spark, a)
    c = x.covariance()
    if a.measure == "volatility":
        return _rows(contributions.volatility_contributions(x.w, c).orderBy("series"))
    return _rows(contributions.risk_contributions(x.w, c, series.moments(x.panel), a.confidence, of_expected_tail_loss=a.measure == "es").orderBy("series"))


def parity(spark, a):
    x = Input(spark, a)
    p = contributions.risk_parity(x.array(), names=x.names)
    return [{"series": n, "weight": float(w)} for n, w in zip(p.names, p.weights, strict=True)]


def _exposure(x: Input, a) -> quadratic.Exposure:
    n = len(x.names)
    delta = [float(v) for v in a.delta.split(",")]
    gamma = readers.read_gamma(x.spark, a.gamma, n) if a.gamma else np.diag([float(v) for v in a.gamma_diagonal.split(",")]) if a.gamma_diagonal else np.zeros((n, n))
    return quadratic.Exposure(np.array(delta), gamma, getattr(a, "theta", 0.0))


def curvature(spark, a):
    x = Input(spark, a)
    e, m = _exposure(x, a), x.array()
    if a.theta_funded:
        e = quadratic.Exposure(e.delta, e.gamma, -0.5 * float(np.trace(e.gamma @ m)))
    f = quadratic.standard_form(e, m)
    r = quadratic.quadratic_risk(f, a.confidence)
    return [{"value_at_risk": r.value_at_risk, "expected_tail_loss": r.expected_tail_loss, "delta_normal": -quadratic.delta_normal_quantile(f, 1 - a.confidence), "skewness": r.skewness, "floor": r.floor}]


def drawdown_(spark, a):
    b = Input(spark, a).book()
    return _rows(drawdown.maximum_drawdown(b).join(drawdown.path_ratios(b, a.periods or 252).drop("max_depth"), "series"))


def factors_(spark, a):
    x = Input(spark, a)
    names = a.factors.split(",")
    f, assets = x.panel.where(F.col("series").isin(names)), x.panel.where(~F.col("series").isin(names))
    m = factors.fit_factor_model(assets, f)
    w = x.w.where(~F.col("series").isin(names))
    return {"exposures": _rows(m.exposures), "attribution": _rows(factors.attribute_risk(w, m)), "worst_residual_correlation": _rows(m.worst_residual_correlation())}


def volatility_(spark, a):
    r = Input(spark, a).column(a.column)
    kind = volatility.Innovation.STUDENT_T if a.innovation == "student-t" or (a.innovation == "auto" and volatility.fat_tail_test(r, variance_targeting=a.variance_targeting).fat) else volatility.Innovation.NORMAL
    g = volatility.fit_garch(r, innovation=kind, variance_targeting=a.variance_targeting, strict=False)
    own = g.risk(confidence=a.confidence, last_return=float(r[-1]))
    out = {"innovation": str(kind), "omega": g.omega, "alpha": g.alpha, "beta": g.beta, "degrees": g.degrees, "half_life": g.half_life, "value_at_risk": own.value_at_risk, "expected_tail_loss": own.expected_tail_loss, "horizon_volatility": math.sqrt(g.horizon_variance(a.horizon, last_return=float(r[-1])))}
    if a.paths:
        h = horizon.horizon_risk(spark, g, r, steps=a.horizon, confidence=a.confidence, paths=a.paths, innovations=horizon.Innovations(a.draw), seed=a.seed, convention=series.Convention(a.convention))
        out |= {"horizon_value_at_risk": h.value_at_risk, "horizon_expected_tail_loss": h.expected_tail_loss, "standard_error": h.standard_error}
    return [out]


def tail(spark, a):
    r = Input(spark, a).column(a.column)
    fit = extreme.fit_tail(-r, tail_fraction=a.tail_fraction, threshold=a.threshold, method=extreme.TailMethod(a.method))
    out = {"shape": fit.shape, "scale": fit.scale, "threshold": fit.threshold, "exceedances": fit.exceedances, "value_at_risk": fit.quantile(a.confidence), "expected_tail_loss": fit.expected_tail_loss(a.confidence) if fit.shape < 1 else None, "historical": float(-np.quantile(r, 1 - a.confidence))}
    if a.curve:
        losses = spark.createDataFrame([("all", float(-v)) for v in r], "series string, loss double")
        return {"fit": out, "curve": _rows(extreme.mean_excess_curve(losses, a.curve).orderBy("threshold"))}
    return [out]


def copula_(spark, a):
    x = Input(spark, a)
    r = copula.copula_risk(x.panel.select("series", "t", "r"), x.weights, a.confidence, copula.Family(a.family), copula.Marginal(a.marginal), a.degrees, a.paths, a.seed)
    pairs = sorted(r.copula.tail_dependence(), key=lambda t: -t.coefficient)[: a.pairs]
    return {"risk": {"value_at_risk": r.value_at_risk, "expected_tail_loss": r.expected_tail_loss, "degrees": r.copula.degrees_of_freedom, "premium": r.tail_dependence_premium, "standard_error": r.standard_error}, "pairs": [dataclasses.asdict(p) for p in pairs]}


def score(spark, a):
    def one(k):
        f = readers.read_forecasts(spark, a.forecasts, a.returns_column, a.var_columns[k], a.es_columns[k] if a.es_columns else None)
        return scoring.fz0_loss(f, a.confidence) if a.es_columns else scoring.quantile_loss(f, a.confidence)

    return _rows(scoring.compare(one(0), one(1), a.lags))


def validate(spark, a):
    f = readers.read_forecasts(spark, a.forecasts, a.returns_column, a.var_column, a.es_column)
    return _rows(backtest.validate(f, a.confidence, a.replications, a.seed, **({"distribution": parametric.Distribution(a.distribution), "degrees": a.degrees} if a.replications else {})))


def expectile_(spark, a):
    r = -Input(spark, a).column(None)
    m, s = float(r.mean()), float(r.std(ddof=1))
    es = float(parametric.parametric(mean=-m, volatility=s, confidence=a.confidence).expected_tail_loss)
    match = expectile.matching_level(es, lambda p: expectile.normal_expectile(mean=m, volatility=s, level=p).value)
    return [{"sample": expectile.sample_expectile(r, a.level).value, "normal": expectile.normal_expectile(mean=m, volatility=s, level=a.level).value, "student_t": expectile.student_t_expectile(mean=m, volatility=s, level=a.level, degrees=a.degrees).value, "level_matching_es": match.level, "sample_at_that_level": expectile.sample_expectile(r, match.level).value, "expected_tail_loss": es}]


def spectrum(spark, a):
    r = Input(spark, a).column(None)
    charge = -spectral.spectral_risk(r, TailSpectrum(1 - a.confidence))
    frame = spark.createDataFrame([("all", k, float(v)) for k, v in enumerate(r)], "series string, t long, r double")

    def matched(make, low, high):
        return make(special._root(lambda k: -spectral.spectral_risk(r, make(k)) - charge, low, high, 60))

    found = [TailSpectrum(1 - a.confidence), matched(ExponentialSpectrum, 1e-6, 500.0), PowerSpectrum(a.exponent) if a.exponent else matched(PowerSpectrum, 1.0, 500.0), matched(WangSpectrum, 0.0, 8.0)]
    return [{"spectrum": s.name, "charge": -spectral.spectral_risk(r, s), "deep_share": spectral.tail_shares(frame, s, a.deep).first()["share"]} for s in found]


def portfolio(spark, a):
    obligors = readers.read_obligors(spark, a.obligors)
    p = saddlepoint.grouped(obligors)
    levels = [a.level] if a.level is not None else [p.mean * k for k in (1, 1.5, 2, 3) if p.mean * k < p.maximum]
    fits = bool(p.span) and p.maximum / p.span < a.exact_points
    exact = {r["level"]: r["probability"] for r in lossgrid.exact_tail(lossgrid.exact_masses(obligors, unit=p.span), levels, p.span).collect()} if fits else {}
    out = [{"level": x, "saddlepoint": saddlepoint.exceedance_probability(p, x), "normal": saddlepoint.normal_tail(p, x), "exact": exact.get(float(x))} for x in levels]
    c = saddlepoint.tail_loss_contributions(p, levels[-1])
    top = sorted(zip(p.p, p.e, c, strict=True), key=lambda t: -t[2])[: a.top]
    note = {} if fits else {"note": "no exact column: exposures on no lattice" if not p.span else f"no exact column: {p.maximum / p.span:.0f} lattice points, see --exact-points"}
    return {"tail": out, **note, "contributions": [{"probability": float(q), "exposure": float(e), "contribution": float(v)} for q, e, v in top]}


def bounds_(spark, a):
    x = Input(spark, a)
    m, c = {r["series"]: r["mean"] for r in series.moments(x.panel).collect()}, x.array()
    tails = [bounds.normal_loss(-x.weights[n] * m[n], abs(x.weights[n]) * math.sqrt(c[k, k]), label=n) for k, n in enumerate(x.names) if x.weights[n]]
    b = bounds.dependence_bounds(tails, confidence=a.confidence, points=a.points)
    own = _rows(parametric.portfolio_risk(x.w, x.covariance(), series.moments(x.panel), a.confidence))[0]["value_at_risk"]
    return [{"best": b.estimated[0], "worst": b.estimated[1], "enclosing": b.enclosing, "attainable": b.attainable, "comonotonic": b.comonotonic, "fitted": own}]


def clean(spark, a):
    x = Input(spark, a)
    c = cleaning.clip_spectrum(x.panel)
    out = [{"eigenvalue": float(v), "cleaned": float(k), "upper_edge": c.upper_edge} for v, k in list(zip(c.observed, c.cleaned, strict=True))[: a.show]]
    if not a.compare:
        return out
    return {"spectrum": out, "estimators": [{"estimator": o.estimator, "variance": o.variance, "concentration": o.concentration} for o in cleaning.compare_estimators(x.panel, a.split)]}


def worst_case(spark, a):
    x = Input(spark, a)
    e, m = _exposure(x, a), x.array()
    radius = a.radius or stress.radius_for(a.confidence, len(m))
    s, o = stress.worst_case_scenario(e, m, radius), stress.one_at_a_time(e, m, radius)
    return {"loss": s.loss, "one_at_a_time": o.worst, "radius": radius, "moves": dict(zip(x.names, map(float, s.move), strict=True))}


def stress_(spark, a):
    x = Input(spark, a)
    wide = series.to_columns(x.panel.select("series", "t", "r"), x.names).join(x.book().select("t", F.col("r").alias("__book")), "t").cache()
    on = a.on or x.names[0]
    views = []
    if a.mean is not None:
        views.append(entropy.mean_view(on, a.mean))
    if a.below is not None:
        share = wide.agg(F.avg((F.col(on) < a.below).cast("double"))).first()[0]
        wide = wide.withColumn("__below", (F.col(on) < a.below).cast("double"))
        views.append(entropy.probability_view("__below", a.probability or min(0.99, share * a.multiple)))
    if not views:
        raise InputError("a view is needed: --mean or --below")
    post = entropy.pool(wide, views)
    n = post.count
    tilted = entropy.temper(post.scenarios.withColumn("p", F.lit(1.0 / n)), a.confidence_in_view)
    frame = lambda w: tilted.select(F.lit("book").alias("series"), "t", F.col("__book").alias("r"), F.col(w).alias("w"))
    risk_rows = [{"when": k, **_rows(entropy.stressed_risk(frame(c), a.confidence))[0]} for k, c in (("before", "p"), ("after", "w"))]
    return {"risk": risk_rows, "relative_entropy": post.relative_entropy, "effective_scenarios": post.effective_scenarios}


def regime(spark, a):
    r = -Input(spark, a).column(None)
    f = mixture.fit_mixture(r, a.components, floor=a.floor)
    out = mixture.mixture_risk(f.mixture, a.confidence)
    payload = {"components": [dataclasses.asdict(c) for c in f.mixture.components], "value_at_risk": out.value_at_risk, "expected_tail_loss": out.expected_tail_loss, "responsibility": out.responsibility, "averaged": out.averaged}
    if a.components == 2:
        chain = (a.stay_calm, a.stay_stressed)
        h = mixture.mixture_risk(mixture.horizon_mixture(*f.mixture.components, chain, mixture.stationary(chain), a.horizon), a.confidence)
        payload["horizon"] = {"periods": a.horizon, "value_at_risk": h.value_at_risk, "against_square_root_of_time": h.value_at_risk / (out.value_at_risk * math.sqrt(a.horizon))}
    return payload


def bars(spark, a):
    v = _rows(realised.realised_variances(readers.read_bars(spark, a.bars)))[0]
    bias = realised.tick_bias_factor(a.ticks) if a.ticks else 1.0
    ranged = {"parkinson", "garman_klass", "rogers_satchell", "garman_klass_yang_zhang", "yang_zhang"}
    return [{"estimator": str(e), "volatility": math.sqrt(v[str(e)] * a.periods / (bias if str(e) in ranged else 1.0)) if v[str(e)] is not None else None} for e in realised.Estimator]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="riskweave", description=__doc__)
    p.add_argument("--json", action="store_true")
    p.add_argument("--version", action="version", version="riskweave 0.1")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, *options, file="returns"):
        c = sub.add_parser(name)
        if file.startswith("--"):
            c.add_argument(file, required=True)
        else:
            c.add_argument(file)
        c.add_argument("--json", action="store_true", default=argparse.SUPPRESS)
        c.set_defaults(run=run)
        for flag, kind, default in options:
            if kind is bool:
                c.add_argument(flag, action="store_true")
            elif kind is list:
                c.add_argument(flag, nargs=2, default=default)
            else:
                c.add_argument(flag, type=kind, default=default)

    w, s, c = ("--weights", str, None), ("--shrink", bool, False), ("--confidence", float, 0.99)
    book = (("--delta", str, None), ("--gamma", str, None), ("--gamma-diagonal", str, None))
    add("risk", risk, w, s, c, ("--distribution", str, "normal"), ("--degrees", float, 5.0), ("--periods", float, None))
    add("contributions", contributions_, w, s, c, ("--measure", str, "volatility"))
    add("parity", parity, s)
    add("curvature", curvature, s, c, *book, ("--theta", float, 0.0), ("--theta-funded", bool, False))
    add("drawdown", drawdown_, w, s, ("--periods", float, None))
    add("factors", factors_, w, s, ("--factors", str, ""))
    add("volatility", volatility_, w, s, c, ("--column", str, None), ("--horizon", int, 10), ("--innovation", str, "auto"), ("--paths", int, 0), ("--convention", str, "simple"), ("--draw", str, "bootstrap"), ("--seed", int, 0), ("--variance-targeting", bool, False))
    add("tail", tail, w, s, ("--confidence", float, 0.999), ("--column", str, None), ("--tail-fraction", float, 0.05), ("--threshold", float, None), ("--method", str, "maximum-likelihood"), ("--curve", int, 0))
    add("copula", copula_, w, c, ("--family", str, "student_t"), ("--marginal", str, "empirical"), ("--degrees", float, None), ("--paths", int, 40_000), ("--pairs", int, 10), ("--seed", int, 0))
    add("score", score, ("--returns-column", str, "return"), ("--var-columns", list, ["var_a", "var_b"]), ("--es-columns", list, None), ("--confidence", float, 0.975), ("--lags", int, None), file="forecasts")
    add("validate", validate, c, ("--returns-column", str, "return"), ("--var-column", str, "var"), ("--es-column", str, None), ("--replications", int, 0), ("--distribution", str, "normal"), ("--degrees", float, 5.0), ("--seed", int, 0), file="forecasts")
    add("expectile", expectile_, w, ("--level", float, 0.99), ("--confidence", float, 0.975), ("--degrees", float, 5.0))
    add("spectrum", spectrum, w, ("--confidence", float, 0.975), ("--deep", float, 0.005), ("--exponent", float, None))
    add("portfolio", portfolio, ("--level", float, None), ("--top", int, 10), ("--exact-points", int, 20_000), file="obligors")
    add("bounds", bounds_, w, s, c, ("--points", int, 512))
    add("clean", clean, ("--show", int, 10), ("--compare", bool, False), ("--split", float, 0.5))
    add("worst-case", worst_case, s, c, *book, ("--radius", float, None))
    add("stress", stress_, w, c, ("--on", str, None), ("--mean", float, None), ("--below", float, None), ("--multiple", float, 2.0), ("--probability", float, None), ("--confidence-in-view", float, 1.0))
    add("regime", regime, w, c, ("--components", int, 2), ("--floor", float, mixture.DEFAULT_FLOOR), ("--horizon", int, 1), ("--stay-calm", float, 0.98), ("--stay-stressed", float, 0.9))
    add("bars", bars, ("--periods", float, 252.0), ("--ticks", int, None), file="--bars")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("riskweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out = a.run(spark, a)
    except (InputError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    if a.json:
        print(readers.json_text(out))
    elif isinstance(out, list):
        print(readers.table_text(out))
    else:
        for k, v in out.items():
            print(readers.table_text(v) if isinstance(v, list) and v and isinstance(v[0], dict) else f"{k}: {v}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
