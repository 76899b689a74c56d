"""Closed forms, published figures and identities of the risk operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.errors import BadBar, BadForecast, OutOfDomain, ViewsInfeasible
from riskweave.functions import columns, linalg, special, spectra
from riskweave.operators import backtest, bounds, cleaning, contributions, covariance, drawdown, entropy, expectile, extreme, factors, historical, mixture, parametric, quadratic, ranks, realised, saddlepoint, series, spectral, stress, volatility


def panel_of(spark, **columns_):
    return spark.createDataFrame([(s, t, float(r)) for s, xs in columns_.items() for t, r in enumerate(xs)], "series string, t long, r double")


def test_published_quantiles():
    assert abs(special.normal_ppf(0.99) - 2.326348) < 1e-6
    assert abs(special.normal_pdf(special.normal_ppf(0.975)) / 0.025 - 2.337803) < 1e-6
    for v, var, es in ((8, 2.5084, 2.5720), (5, 2.6065, 2.7278), (4, 2.6495, 2.8239), (3, 2.6216, 2.9096)):
        assert abs(parametric.student_t_risk(mean=0, volatility=1, confidence=0.99, degrees=v).value_at_risk - var) < 1e-4
        assert abs(parametric.student_t_risk(mean=0, volatility=1, confidence=0.975, degrees=v).expected_tail_loss - es) < 1e-4
    for k, r in ((1, 2.576), (3, 3.368), (10, 4.818), (50, 8.727)):
        assert abs(stress.radius_for(0.99, k) - r) < 1e-3
    assert abs(special.chi_square_cdf(9, 50) / 1.85e-11 - 1) < 0.01


def test_special_functions():
    assert abs(special.binomial_cdf(3, 10, 0.3) - sum(math.comb(10, k) * 0.3**k * 0.7 ** (10 - k) for k in range(4))) < 1e-14
    assert abs(special.student_t_cdf(1.0, 1.0) - 0.75) < 1e-14
    assert abs(special.chi_square_sf(3.0, 2) - math.exp(-1.5)) < 1e-15
    assert abs(special.student_t_ppf(0.01, 4) - -3.7469473879791) < 1e-9


def test_normal_columns(spark):
    xs = [-9.0, -3.0, -0.1, 0.0, 0.5, 2.0, 6.0]
    for x, c, q in spark.createDataFrame([(x,) for x in xs], "x double").select("x", columns.cdf(F.col("x")), columns.ppf(columns.cdf(F.col("x")))).collect():
        assert abs(c / special.normal_cdf(x) - 1) < 1e-12
        assert x > 5 or abs(q - x) < 1e-9


def test_tail_of_a_small_sample(spark):
    p = panel_of(spark, a=[-0.04, -0.03, -0.02, 0.0, 0.01, 0.02, 0.03, 0.05, 0.06, 0.07])
    r = historical.historical_risk(p, 0.85).first()
    assert abs(r["expected_tail_loss"] - (0.04 + 0.5 * 0.03) / 1.5) < 1e-12
    assert abs(r["quantile"] - np.quantile([-0.04, -0.03, -0.02, 0.0, 0.01, 0.02, 0.03, 0.05, 0.06, 0.07], 0.15)) < 1e-12


def test_subadditivity_counterexample(spark):
    n, half = 1000, [-1.0 if k < 8 else 0.01 for k in range(1000)]
    other = [-1.0 if 8 <= k < 16 else 0.01 for k in range(n)]
    p = panel_of(spark, a=[x * 0.5 for x in half], b=[x * 0.5 for x in other])
    assert not historical.check_subadditivity(p, 0.99).first()["subadditive"]
    assert historical.check_subadditivity(p, 0.99, True).first()["subadditive"]


def test_bad_returns_fail(spark):
    with pytest.raises(Exception, match="not a return"):
        series.checked(panel_of(spark, a=[0.1, -1.0])).collect()


def test_drawdown_ties(spark):
    p = panel_of(spark, a=[0.1, -0.5, 1.0, -0.5, 1.0])
    d = drawdown.maximum_drawdown(p).first()
    assert (d["peak_at"], d["trough_at"], d["recovery_at"]) == (1, 2, 3) and abs(d["depth"] - 0.5) < 1e-12
    assert [r["trough_at"] for r in drawdown.drawdowns(p).orderBy("rank").collect()] == [2, 4]


def test_kendall_routes():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    assert abs(ranks.kendall_tau(x, y) - ranks.kendall_tau_quadratic(x, y)) < 1e-14


def test_linear_algebra():
    m = np.array([[4.0, 1, 0], [1, 3, -1], [0, -1, 2]])
    values, vectors = linalg.eigh(m)
    assert np.allclose(linalg.reconstruct(values, vectors), m) and np.allclose(linalg.cholesky(m) @ linalg.cholesky(m).T, m)
    beta, r = linalg.least_squares([[1, 0], [1, 1], [1, 2]], [1, 3, 5])
    assert np.allclose(beta, [1, 2]) and np.allclose(linalg.upper_inverse_gram(r), np.linalg.inv(np.array([[3, 3], [3, 5]])))


def test_parity_and_bets():
    m = np.array([[0.04, 0.01], [0.01, 0.09]])
    p = contributions.risk_parity(m)
    assert np.allclose(p.weights, [0.6, 0.4]) and p.converged
    assert abs(contributions.principal_bets([0.5, 0.5], m).distribution.sum() - 1) < 1e-12


def test_expectiles():
    rng = np.random.default_rng(2)
    x = rng.standard_normal(500)
    e = expectile.sample_expectile(x, 0.9)
    assert abs(e.identity) < 1e-12 and abs(expectile.sample_expectile(x, 0.5).value - x.mean()) < 1e-12
    n = expectile.normal_expectile(mean=1, volatility=2, level=0.95)
    assert abs(n.identity) < 1e-9
    assert abs(expectile.matching_level(n.value, lambda p: expectile.normal_expectile(mean=1, volatility=2, level=p).value).level - 0.95) < 1e-6


def test_spectra():
    for s in (spectra.TailSpectrum(0.05), spectra.ExponentialSpectrum(20), spectra.PowerSpectrum(4), spectra.WangSpectrum(1.0), spectra.MixtureSpectrum(((0.01, 1), (0.1, 3)))):
        assert abs(s.mass(0.0, 1.0) - 1) < 1e-12
    assert abs(spectral.normal_spectral(mean=0, volatility=1, spectrum=spectra.TailSpectrum(0.025)) + 2.337803) < 1e-5
    assert spectral.check_coherence([1, 2, 3, 4], [4, 1, 3, 2], spectra.ExponentialSpectrum(5)).subadditive


def test_mixture_risk_is_not_an_average():
    m = mixture.NormalMixture.two_regime(stress=0.1, stress_deviation=3)
    assert abs(m.survival(m.quantile(0.99)) - 0.01) < 1e-12
    r = mixture.mixture_risk(m, 0.99)
    assert r.averaged < r.expected_tail_loss and abs(sum(r.responsibility) - 1) < 1e-12
    assert abs(mixture.convolve(m, m).variance - 2 * m.variance) < 1e-12
    law = mixture.occupation_law((0.9, 0.8), (0.5, 0.5), 6)
    assert abs(sum(law.probability) - 1) < 1e-12
    rng = np.random.default_rng(0)
    f = mixture.fit_mixture(np.concatenate([rng.normal(0, 1, 3000), rng.normal(0, 4, 1000)]))
    assert abs(f.mixture.components[1].deviation - 4) < 0.5


def test_saddlepoint_against_convolution():
    rng = np.random.default_rng(3)
    p = saddlepoint.LossPortfolio.of([(float(a), float(b)) for a, b in zip(rng.uniform(0.01, 0.1, 60), rng.integers(1, 8, 60), strict=True)]).detected()
    exact = saddlepoint.exact_distribution(p)
    for level in (10, 20, 30, 45):
        assert abs(saddlepoint.exceedance_probability(p, level) / saddlepoint.exact_tail(exact, level) - 1) < 0.02
    assert abs(saddlepoint.saddlepoint_tail_loss(p, 30) / saddlepoint.exact_tail_loss(exact, 30) - 1) < 0.02


def test_tails():
    rng = np.random.default_rng(4)
    y = (rng.uniform(size=5000) ** -0.25 - 1) / 0.25
    assert abs(extreme.fit_generalised_pareto(y).shape - 0.25) < 0.06
    g = extreme.GeneralisedPareto(0.2, 1.0, 2.0, 100, 1000)
    assert abs(g.tail_probability(g.quantile(0.995)) - 0.005) < 1e-12


def test_bounds_and_cleaning():
    b = bounds.dependence_bounds([bounds.uniform_loss()] * 3, confidence=0.9, points=64)
    assert b.best.lower <= b.best.upper <= b.comonotonic * 1.01 and b.worst.lower <= b.worst.upper + 1e-12
    assert abs(b.worst.upper - 3 * 0.95) < 1e-12
    assert abs(cleaning.implied_spike(cleaning.spike_location(3.0, 50, 200), 50, 200) - 3.0) < 1e-9


def test_quadratic():
    f = quadratic.StandardForm(0.0, np.array([3.0, 5.0]), np.array([1.0, 2.0]))
    assert abs(quadratic.cumulants(f)[2] - 186) < 1e-9 and abs(quadratic.cumulants(quadratic.negated(f))[2] + 186) < 1e-9
    line = quadratic.StandardForm(0.0, np.array([3.0, 4.0]), np.zeros(2))
    assert abs(quadratic.quadratic_quantile(line, 0.01) - 5 * special.normal_ppf(0.01)) < 1e-6
    rng = np.random.default_rng(5)
    u = rng.standard_normal((400_000, 2))
    v = u @ f.linear + 0.5 * (u * u) @ f.curvature
    assert abs(quadratic.quadratic_cdf(f, -4.0) - (v <= -4).mean()) < 0.01
    hard = stress.maximum_loss(quadratic.StandardForm(0.0, np.array([0.0, 1.0]), np.array([-2.0, 1.0])), 2.0)
    assert hard.hard_case and abs(np.linalg.norm(hard.point) - 2) < 1e-9


def test_garch_recovers():
    rng = np.random.default_rng(6)
    v, xs = 1e-4, []
    for _ in range(3000):
        r = math.sqrt(v) * rng.standard_normal()
        xs.append(r)
        v = 2e-6 + 0.09 * r * r + 0.89 * v
    g = volatility.fit_garch(xs, strict=False)
    assert abs(g.persistence - 0.98) < 0.03 and abs(g.alpha - 0.09) < 0.04


def test_entropy_pool(spark):
    rng = np.random.default_rng(8)
    s = spark.createDataFrame([(float(a), float(a < 0)) for a in rng.standard_normal(400)], "x double, down double")
    p = entropy.pool(s, [entropy.probability_view("down", 0.7)])
    got = p.scenarios.agg(F.sum("w"), F.sum(F.col("w") * F.col("down"))).first()
    assert abs(got[0] - 1) < 1e-9 and abs(got[1] - 0.7) < 1e-9


def test_bars():
    assert abs(realised.tick_bias_factor(64) ** 0.5 - 0.909) < 1e-3


def test_tied_returns_share_their_rank(spark):
    from riskweave.operators import copula

    frame = spark.createDataFrame([("a", k, r) for k, r in enumerate([0.1, 0.1, -0.2, 0.3])], "series string, t long, r double")
    got = {r["t"]: r["u"] for r in copula.pseudo_observations(frame).collect()}
    assert got == {0: 0.5, 1: 0.5, 2: 0.2, 3: 0.8}


def test_mixing_tolerance_and_zero_mean():
    from types import SimpleNamespace as N

    from riskweave.operators import bounds

    case = lambda mean, lower: bounds.WorstCase(lower, mean, mean, mean, N(points=100, mean=mean))
    assert case(1.0, 0.985).mixes() and not case(1.0, 0.97).mixes()
    assert case(0.0, -0.01).mixes() and not case(0.0, -0.5).mixes()


def test_mixture_refuses_samples_without_components():
    from riskweave.errors import BadMixture
    from riskweave.operators import mixture

    for sample in ([1.0] * 10, [1.0, float("nan"), 2.0, 3.0, 4.0], [1.0, 2.0]):
        with pytest.raises(BadMixture):
            mixture.fit_mixture(sample)


def test_forecasts_refuse_bad_cells(spark, tmp_path):
    from riskweave.errors import InputError
    from riskweave.sources import readers

    for cell in ("x", "", "inf", "nan"):
        (tmp_path / "f.csv").write_text(f"return,var,es\n0.01,0.02,0.03\n0.01,{cell},0.03\n")
        with pytest.raises(InputError):
            readers.read_forecasts(spark, str(tmp_path / "f.csv"))
    (tmp_path / "f.csv").write_text("return,var,es\n0.01,0.02,0.03\n")
    assert readers.read_forecasts(spark, str(tmp_path / "f.csv")).count() == 1


def test_identity_of_an_allocation(spark):
    weights = spark.createDataFrame([("a", 0.6), ("b", -0.4)], "series string, w double")
    cov = spark.createDataFrame([("a", "a", 0.04), ("a", "b", 0.03), ("b", "a", 0.03), ("b", "b", 0.09)], "i string, j string, v double")
    out = contributions.volatility_contributions(weights, cov)
    row = contributions.euler_identity(out).first()
    vol = math.sqrt(0.36 * 0.04 + 0.16 * 0.09 - 2 * 0.24 * 0.03)
    assert row["assets"] == 2 and abs(row["total"] - vol) < 1e-15 and row["identity_error"] < 1e-15 and not row["has_negative_contribution"]
    assert abs(contributions.contribution_of(out, "a") - 0.6 * (0.6 * 0.04 - 0.4 * 0.03) / vol) < 1e-15
    with pytest.raises(KeyError):
        contributions.contribution_of(out, "c")
    with pytest.raises(Exception, match="an incomplete allocation: a"):
        contributions.euler_identity(out.withColumn("w", F.when(F.col("series") != "a", F.col("w")))).collect()


def test_identity_of_an_attribution(spark):
    rng = np.random.default_rng(3)
    f = rng.normal(size=(200, 2)) * 0.01
    own = f @ np.array([[1.0, 0.2, -0.5], [0.1, 0.8, 0.3]]) + rng.normal(size=(200, 3)) * 0.004
    model = factors.fit_factor_model(panel_of(spark, a=own[:, 0], b=own[:, 1], c=own[:, 2]), panel_of(spark, f=f[:, 0], g=f[:, 1]))
    out = factors.attribute_risk(spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "series string, w double"), model).cache()
    row = factors.attribution_identity(out).first()
    assert row["identity_error"] < 1e-12 and row["specific_contribution"] > 0
    parts = {r["factor"]: r["component"] for r in out.collect()}
    assert factors.attribution_of(out, "g") == parts["g"]
    assert tuple(factors.largest_factor(out).first()) == max(parts.items(), key=lambda x: abs(x[1]))


def test_rejections(spark):
    rows = [("s", t, -0.02 if t % 10 == 0 else 0.01, 0.015) for t in range(200)] + [("u", t, -0.02 if t in (20, 110) else 0.01, 0.015) for t in range(200)]
    tests = backtest.coverage_tests(backtest.exceedances(spark.createDataFrame(rows, "series string, t long, r double, var double")), 0.99).cache()
    named = {r["series"]: r["rejected"] for r in backtest.rejected_at(tests).collect()}
    assert "unconditional" in named["s"] and "conditional" in named["s"] and named["u"] == []
    one = {r["series"]: r["rejects"] for r in backtest.rejects_at(tests.select("series", F.col("unconditional_p").alias("p_value")), 0.05).collect()}
    assert one == {"s": True, "u": False}
    with pytest.raises(BadForecast):
        backtest.rejected_at(tests, 1.0)


def test_bars_of_rows(spark):
    bars = realised.Bars.from_rows(spark, "x", [(10, 12, 9, 11), (11, 11.5, 10.5, 11)])
    assert len(bars) == 2 and [b["close"] for b in bars] == [11.0, 11.0] and bars.closes.columns == ["series", "t", "close"]
    assert abs(bars.overnight().where("t = 1").first()["gap"]) < 1e-15
    for rows, said in (([(10, 12, 9, 11), (10, 9, 8, 9)], "row 1"), ([(1, 2, 3)], "3 values"), ([], "no bars")):
        with pytest.raises(BadBar, match=said):
            realised.bars_from_rows(spark, "x", rows)


def test_construction_guards(spark):
    with pytest.raises(OutOfDomain):
        bounds.LossTail(lambda p: p, upper_endpoint=0.0, lower_endpoint=1.0)
    with pytest.raises(OutOfDomain):
        bounds.uniform_loss().value_at_risk(1.0)
    with pytest.raises(ViewsInfeasible):
        entropy.mean_view("x", math.nan)
    tails = spark.createDataFrame([("a", 0.1, 0.02, 0.03, 50, 1000)], "series string, shape double, scale double, threshold double, exceedances bigint, observations bigint")
    assert extreme.tail_risk(tails, 0.9).first()["value_at_risk"] is None
    with pytest.raises(Exception, match="says nothing"):
        extreme.tail_risk(tails, 0.9, strict=True).collect()
    assert abs(historical.with_tail_probability(extreme.tail_risk(tails, 0.99)).first()["tail_probability"] - 0.01) < 1e-15


def test_variance_filters_against_loops(spark):
    rng = np.random.default_rng(8)
    xs, ys = rng.normal(size=60) * 0.01, rng.normal(size=3) * 0.02
    p = panel_of(spark, a=xs, b=ys).orderBy(F.desc("t"))
    ewma, garch = historical.ewma_volatility(p, 0.9).collect(), volatility.garch_variances(p, omega=1e-6, alpha=0.1, beta=0.85, mean=0.001).collect()
    assert len(ewma) == len(garch) == 63
    for name, x in (("a", xs), ("b", ys)):
        v = float(np.var(x))
        want = volatility.variances(x, 1e-6, 0.1, 0.85, 0.001)
        for r, g, k in zip(sorted((r for r in ewma if r["series"] == name), key=lambda r: r["t"]), sorted((r for r in garch if r["series"] == name), key=lambda r: r["t"]), range(len(x)), strict=True):
            assert abs(r["volatility"] / math.sqrt(v) - 1) < 1e-12 and abs(g["variance"] / want[k] - 1) < 1e-12
            v = 0.9 * v + 0.1 * x[k] ** 2
        assert abs(r["next_volatility"] / math.sqrt(v) - 1) < 1e-12


def test_shrinkage_of_few_assets(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 1)) * 0.01 + rng.normal(size=(80, 3)) * 0.01
    two = covariance.ledoit_wolf(panel_of(spark, a=x[:, 0], b=x[:, 1])).collect()
    assert len(two) == 4 and all(r["intensity"] == 1.0 and abs(r["v"] - r["sample"]) < 1e-18 for r in two)
    d = x - x.mean(axis=0)
    s = d.T @ d / 80
    size = np.sqrt(np.outer(np.diag(s), np.diag(s)))
    r = (s / size)[np.triu_indices(3, 1)].mean()
    off, pi = ~np.eye(3, dtype=bool), ((d[:, :, None] * d[:, None, :] - s) ** 2).mean(axis=0)
    theta = ((d[:, :, None] ** 2 - np.diag(s)[:, None]) * (d[:, :, None] * d[:, None, :] - s)).mean(axis=0)
    rho = np.diag(pi).sum() + (off * r * np.sqrt(np.diag(s) / np.diag(s)[:, None]) * theta).sum()
    gamma = (off * (r * size - s) ** 2).sum()
    k = float(np.clip((pi.sum() - rho) / gamma / 80, 0, 1))
    want = (k * np.where(off, r * size, s) + (1 - k) * s) * 80 / 79
    got = {(q["i"], q["j"]): q["v"] for q in covariance.ledoit_wolf(panel_of(spark, a=x[:, 0], b=x[:, 1], c=x[:, 2])).collect()}
    assert all(abs(got["abc"[i], "abc"[j]] - want[i, j]) < 1e-15 for i in range(3) for j in range(3))
