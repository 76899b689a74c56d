"""Operators whose work is spread: the loss lattice, moving states, recursions by chunks, order statistics by counting."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.errors import BadMixture, SaddlepointError
from riskweave.operators import copula, drawdown, expectile, factors, gram, historical, lossgrid, mixture, recursion, saddlepoint


def book(spark, rows):
    return spark.createDataFrame([(i, float(p), float(e)) for i, (p, e) in enumerate(rows)], "obligor long, probability double, exposure double")


@pytest.fixture(scope="module")
def names():
    rng = random.Random(3)
    return [(rng.choice([0.01, 0.02, 0.3, 0.5, 0.7, 0.95]), rng.randrange(1, 9)) for _ in range(60)] + [(1.0, 4), (0.0, 3)] + [(0.013, 2)] * 300


@pytest.mark.parametrize("leaf", [16, 100, 1 << 16])
def test_masses_equal_one_convolution_step_an_obligor(spark, names, leaf):
    want = saddlepoint.exact_distribution(saddlepoint.LossPortfolio.of([n for n in names if n[0]]))
    got = {r["loss"]: r["mass"] for r in lossgrid.exact_masses(book(spark, names), leaf_points=leaf).collect()}
    assert all(abs(got.get(float(x), 0.0) - m) < 1e-14 for x, m in enumerate(want)) and abs(sum(got.values()) - 1) < 1e-12
    assert min(got) >= 4  # the certain default


def test_tilted_masses_keep_relative_precision_far_out(spark):
    rows = [(0.01, 1 + k % 3) for k in range(400)]
    want = saddlepoint.exact_distribution(saddlepoint.LossPortfolio.of(rows))
    p = saddlepoint.LossPortfolio.of(rows).detected()
    got = {r["loss"]: r["mass"] for r in lossgrid.exact_masses(book(spark, rows), tilt=saddlepoint.saddlepoint(p, 90.0), leaf_points=200).collect()}
    assert want[90] < 1e-20 and all(abs(got[float(x)] / want[x] - 1) < 1e-9 for x in range(80, 101))


def test_tails_levels_and_units(spark, names):
    masses = lossgrid.exact_masses(book(spark, [(p, e / 4) for p, e in names]), unit=0.25)
    dense = saddlepoint.exact_distribution(saddlepoint.LossPortfolio.of([n for n in names if n[0]]))
    for r in lossgrid.exact_tail(masses, [0.0, 20.25, 1e9], 0.25).collect():
        x = r["level"] * 4
        assert abs(r["probability"] - saddlepoint.exact_tail(dense, x)) < 1e-12
        assert r["tail_loss"] is None if r["level"] > 1e6 else abs(r["tail_loss"] * 4 - saddlepoint.exact_tail_loss(dense, x)) < 1e-9
    for r in lossgrid.tails(masses, 0.25).collect():
        assert abs(r["tail"] - saddlepoint.exact_tail(dense, r["loss"] * 4)) < 1e-12


@pytest.mark.parametrize("level", [2.0, 30.0, 60.0, 110.0])
def test_contributions_equal_leaving_one_out(spark, names, level):
    got = {r["obligor"]: r["contribution"] for r in lossgrid.tail_contributions(book(spark, names), level).collect()}
    dense = saddlepoint.exact_distribution(saddlepoint.LossPortfolio.of([n for n in names if n[0]]))
    above = saddlepoint.exact_tail(dense, level)
    assert len(got) == len(names) and abs(sum(got.values()) / saddlepoint.exact_tail_loss(dense, level) - 1) < 1e-9
    for i in range(0, 65):
        p, e = names[i]
        rest = saddlepoint.exact_distribution(saddlepoint.LossPortfolio.of([n for k, n in enumerate(names) if k != i and n[0]]))
        beyond = saddlepoint.exact_tail(rest, level - e) if level >= e else 1.0
        assert abs(got[i] - e * p * beyond / above) < 1e-9


def test_books_without_risk_and_bad_books(spark):
    assert [tuple(r) for r in lossgrid.exact_masses(book(spark, [(0.0, 3)])).collect()] == [(0.0, 1.0)]
    assert [tuple(r) for r in lossgrid.exact_masses(book(spark, [])).collect()] == [(0.0, 1.0)]
    with pytest.raises(Exception, match="multiple of the unit"):
        lossgrid.exact_masses(book(spark, [(0.1, 2.5)])).collect()
    with pytest.raises(SaddlepointError):
        lossgrid.tail_contributions(book(spark, [(0.1, 2)]), 2.0)
    with pytest.raises(SaddlepointError):
        lossgrid.exact_masses(book(spark, [(0.1, 2)]), unit=0.0)


def test_long_factors_go_through_transforms(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = (x / x.sum() for x in rng.random((2, 700)))
    direct = lossgrid.convolve(a, b)
    monkeypatch.setattr(lossgrid, "DIRECT", 10)
    assert np.abs(lossgrid.convolve(a, b) - direct).max() < 1e-16


def recursed(rows, a, b, start):
    out, v = [], start
    for r in rows:
        out.append(v)
        v = a(r) + b * v
    return out, v


@pytest.mark.parametrize(("b", "chunk", "run"), [(0.94, 1 << 16, 1 << 12), (0.94, 50, 7), (0.0, 40, 9), (0.3, 7, 3), (1.0, 60, 10), (0.999, 1, 1)])
def test_recursions_by_chunks(spark, b, chunk, run):
    rng = random.Random(8)
    series = {"a": 300, "b": 1, "hot": 900}
    rows = [(s, int(t * t / 7) if s == "hot" else t, rng.gauss(0, 0.02)) for s, n in series.items() for t in range(n)]
    rng.shuffle(rows)
    panel = spark.createDataFrame(rows, "series string, t long, r double")
    got = recursion.affine(panel, 1e-5 + 0.1 * F.col("r") * F.col("r"), b, F.var_pop("r"), chunk=chunk, run=run).collect()
    assert len(got) == len(rows)
    for s in series:
        own = sorted((t, r) for x, t, r in rows if x == s)
        want, last = recursed([r for _, r in own], lambda r: 1e-5 + 0.1 * r * r, b, float(np.var([r for _, r in own])))
        mine = sorted((x["t"], x["r"], x["v"], x["next_v"]) for x in got if x["series"] == s)
        assert np.allclose([x[2] for x in mine], want, rtol=1e-10, atol=1e-18) and np.allclose([x[3] for x in mine], last, rtol=1e-10)


def test_recursions_over_dates_texts_and_nothing(spark):
    rows = [("a", f"2024-01-{d:02d}", 0.01 * d) for d in range(1, 29)]
    panel = spark.createDataFrame(rows, "series string, t string, r double")
    want = recursed([r for *_, r in rows], lambda r: r, 0.5, 2.0)[0]
    for t in (F.col("t"), F.to_date("t"), F.to_timestamp("t")):
        got = recursion.affine(panel.withColumn("t", t), F.col("r"), 0.5, F.max(F.lit(2.0)), chunk=5).orderBy("t").collect()
        assert np.allclose([r["v"] for r in got], want)
    assert recursion.affine(panel.where("false"), F.col("r"), 0.5, F.max(F.lit(2.0))).count() == 0


def test_binomial_masses():
    for n, p in itertools.product([1, 7, 500], [0.0, 1e-6, 0.3, 0.999, 1.0]):
        want = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)] if n < 500 or p in (0.0, 1.0) else None
        got = lossgrid.binomial(n, p)
        assert abs(got.sum() - 1) < 1e-12 and abs((got * np.arange(n + 1)).sum() - n * p) < 1e-8
        assert want is None or np.allclose(got, want, rtol=1e-11, atol=0)


@pytest.mark.parametrize("blocks", [None, 1, 3])
def test_pair_moments_by_blocks(spark, blocks):
    rng = random.Random(6)
    rows = [(f"s{k:02d}", t, rng.gauss(0, 1 + k / 9)) for k in range(11) for t in range(60) if not (k == 4 and t % 5 == 0)] + [("s01", None, 1.0), ("s02", 61, None), ("lone", 999, 0.5)]
    panel = spark.createDataFrame(rows, "series string, t long, r double")
    got = {(r["i"], r["j"]): r for r in gram.pair_moments(panel, blocks).collect()}
    own = {}
    for s, t, r in rows:
        if r is not None and t is not None:
            own.setdefault(s, {})[t] = r
    mean = {s: sum(x.values()) / len(x) for s, x in own.items()}
    pairs = [(i, j) for i in own for j in own if i <= j and set(own[i]) & set(own[j])]
    assert set(got) == set(pairs)
    for i, j in pairs:
        both = sorted(set(own[i]) & set(own[j]))
        x, y = (np.array([own[s][t] - mean[s] for t in both]) for s in (i, j))
        want = (len(both), (x * y).mean(), (x * x).mean(), (y * y).mean(), (x * x * y * y).mean(), (x**3 * y).mean(), (x * y**3).mean())
        assert np.allclose([got[i, j][c] for c in gram.NAMES], want, rtol=1e-10, atol=1e-12)
    assert gram.pair_moments(panel.where("false")).count() == 0
    dates = gram.pair_moments(panel.selectExpr("try_cast(substr(series, 2) as int) as series", "date_add(date'2024-01-01', cast(t as int)) as t", "r").where("series is not null"), blocks)
    assert dict(dates.dtypes)["i"] == "int" and dates.where("i > j").count() == 0


@pytest.mark.parametrize("intercept", [True, False])
@pytest.mark.parametrize("chunk", [1 << 16, 9])
def test_regressions_from_triangles(spark, monkeypatch, intercept, chunk):
    monkeypatch.setattr(factors, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    f = rng.normal(0, 0.01, (90, 3)) + 5
    y = {"a": f @ [0.5, -1, 2] + rng.normal(0, 0.01, 90), "b": rng.normal(0, 1, 90)}
    rows = [(s, t, float(v)) for s, x in y.items() for t, v in enumerate(x) if not (s == "b" and t > 70)] + [("a", 500, 1.0)]
    panel = spark.createDataFrame(rows, "series string, t long, r double")
    market = spark.createDataFrame([(n, t, float(f[t, k])) for k, n in enumerate("xyz") for t in range(90)] + [("x", 600, 1.0)], "series string, t long, r double")
    model = factors.fit_factor_model(panel, market, intercept)
    for s, n in (("a", 90), ("b", 71)):
        want = factors.regress(y[s][:n], f[:n], names=list("xyz"), intercept=intercept)
        got = {r["factor"]: r for r in model.regression(s).collect()}
        assert [k for k in sorted(got)] == list("xyz")
        assert np.allclose([got[k]["beta"] for k in "xyz"], want.betas, rtol=1e-6)
        one = got["x"]
        assert np.allclose([one["alpha"], one["specific_variance"], one["r_squared"], one["durbin_watson"], one["observations"]], [want.alpha, want.specific_variance, want.r_squared, want.durbin_watson, n], rtol=1e-6)


@pytest.mark.parametrize("window", [1, 2, 7, 60, 150])
def test_rolling_drawdowns_of_any_length(spark, window):
    rng = random.Random(window)
    own = {"a": [rng.gauss(0, 0.05) for _ in range(150)], "b": [0.01] * 40, "c": [-1.0 if k == 30 else rng.gauss(0, 0.1) for k in range(90)], "d": []}
    panel = spark.createDataFrame([(s, 3 * t, r) for s, x in own.items() for t, r in enumerate(x)], "series string, t long, r double")
    got = {(r["series"], r["t"] // 3): r["max_drawdown"] for r in drawdown.rolling_maximum_drawdown(panel, window).collect()}
    want = {}
    for s, x in own.items():
        for t in range(window - 1, len(x)):
            w = peak = 1.0
            deep = 0.0
            for r in x[t - window + 1 : t + 1]:
                w *= 1 + r
                peak = max(peak, w)
                deep = max(deep, (peak - w) / peak)
            want[s, t] = deep
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-10 for k in want)


def test_tails_of_long_series_are_ranked_alone(spark, monkeypatch):
    rng = random.Random(1)
    rows = [("hot", t, round(rng.gauss(0, 1), 2)) for t in range(4000)] + [("cold", t, rng.gauss(0, 1)) for t in range(50)]
    panel = spark.createDataFrame(rows, "series string, t long, r double")
    whole = sorted(map(tuple, historical.historical_risk(panel, 0.975).collect()))
    etl = sorted(map(tuple, historical.sample_expected_tail_loss(panel, 0.03).collect()))
    monkeypatch.setattr(historical, "ACCURACY", 200)
    few = historical.ranked(panel, "r", 0.025)
    assert few.where("series = 'hot'").count() < 400 and few.where("series = 'cold'").count() == 50
    assert sorted(map(tuple, historical.historical_risk(panel, 0.975).collect())) == whole
    assert sorted(map(tuple, historical.sample_expected_tail_loss(panel, 0.03).collect())) == etl


def test_mixtures_of_all_series_by_steps(spark):
    rng = np.random.default_rng(12)
    own = {"a": np.where(rng.random(400) < 0.3, rng.normal(0.05, 0.04, 400), rng.normal(0, 0.01, 400)), "b": rng.normal(5, 1, 300)}
    losses = spark.createDataFrame([(s, float(x)) for s, v in own.items() for x in v], "series string, loss double")
    got = mixture.fit_by_steps(losses, steps=12, every=4, tolerance=0.0).orderBy("series", "component").collect()
    for s in own:
        x = np.sort(own[s])
        mean, sd, weight = x[[math.ceil(q * len(x)) - 1 for q in (0.25, 0.75)]], np.full(2, x.std(ddof=1)), np.full(2, 0.5)
        for _ in range(12):
            like = weight / sd * np.exp(-(((x[:, None] - mean) / sd) ** 2) / 2) / math.sqrt(2 * math.pi)
            fit = np.log(like.sum(axis=1)).sum()
            r = like / like.sum(axis=1, keepdims=True)
            weight, mean = r.mean(axis=0), (r * x[:, None]).sum(axis=0) / r.sum(axis=0)
            sd = np.sqrt((r * (x[:, None] - mean) ** 2).sum(axis=0) / r.sum(axis=0))
        mine = [r for r in got if r["series"] == s]
        order = np.argsort(sd)
        assert np.allclose([(r["weight"], r["mean"], r["deviation"]) for r in mine], np.column_stack([weight, mean, sd])[order], rtol=1e-7)
        assert abs(mine[0]["log_likelihood"] / fit - 1) < 1e-9
    early = mixture.fit_by_steps(losses, steps=400, every=3, tolerance=0.1).collect()
    assert len(early) == 4
    with pytest.raises(Exception, match="equal losses"):
        mixture.fit_by_steps(spark.createDataFrame([("c", 1.0)] * 9, "series string, loss double"))
    with pytest.raises(BadMixture):
        mixture.fit_by_steps(losses, floor=0.0)


def test_copula_likelihoods_by_blocks(spark):
    rng = np.random.default_rng(7)
    u = np.array([rng.permutation(60) + 1 for _ in range(3)]).T / 61
    rho = np.array([[1, 0.3, 0.1], [0.3, 1, -0.2], [0.1, -0.2, 1]])
    periods = spark.createDataFrame([([float(x) for x in row],) for row in u], "u array<double>").repartition(3)
    n, (gauss, five, forty) = copula.log_likelihoods(periods, rho, [None, 5.0, 40.0])
    assert n == 60 and abs(gauss - copula.gaussian_copula_log_likelihood(u, rho)) < 1e-9
    assert all(abs(x - copula.student_t_copula_log_likelihood(u, rho, v)) < 1e-8 for x, v in ((five, 5.0), (forty, 40.0)))
    assert copula.log_likelihoods(periods.where("false"), rho, [None]) == (0, [0.0])


def test_levels_of_all_series_match_their_targets(spark):
    rng = np.random.default_rng(9)
    own = {"a": rng.normal(0, 1, 200), "b": rng.exponential(2, 90), "flat": np.full(5, 3.0)}
    losses = spark.createDataFrame([(s, float(x)) for s, v in own.items() for x in v], "series string, loss double")
    targets = {"a": 1.2, "b": 0.4, "flat": 3.0, "unknown": 1.0}
    got = {r["series"]: r["level"] for r in expectile.matching_levels(losses, spark.createDataFrame(list(targets.items()), "series string, target double")).collect()}
    assert set(got) == set(own) and got["flat"] is None
    assert all(abs(expectile.sample_expectile(own[s], got[s]).value - targets[s]) < 1e-9 for s in "ab")
    outside = expectile.matching_levels(losses, spark.createDataFrame([("a", 99.0)], "series string, target double")).first()
    assert outside["level"] is None
