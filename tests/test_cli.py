"""Every command over small files."""

import json
import math

import numpy as np
import pytest

from riskweave import cli
from riskweave.sources import readers


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Paths of a returns, forecast, two-model, bar, obligor and gamma file."""
    at = tmp_path_factory.mktemp("cli")
    rng = np.random.default_rng(5)

    def write(name, header, rows):
        (at / name).write_text("\n".join([header] * bool(header) + [",".join(str(x) for x in r) for r in rows]) + "\n")
        return str(at / name)

    market = rng.normal(0.0004, 0.011, 300)
    own = market[:, None] * np.array([1.1, 0.7, -0.2]) + rng.normal(0, 0.006, (300, 3))
    days = [f"2020-{1 + k // 28:02d}-{1 + k % 28:02d}" for k in range(300)]
    r = rng.normal(0, 0.012, 250)
    steps = np.exp(np.cumsum(rng.normal(0, 0.001, (60, 50)).ravel())).reshape(60, 50)
    return {
        "returns": write("returns.csv", "date,alpha,beta,gamma", [(d, *map(float, x)) for d, x in zip(days, own, strict=False)]),
        "own": own,
        "forecasts": write("forecasts.csv", "return,var,es", [(float(x), 0.0279, 0.032) for x in r]),
        "breaches": int((r < -0.0279).sum()),
        "models": write("models.csv", "return,var_a,var_b", [(float(x), 0.0235, 0.01) for x in r]),
        "bars": write("bars.csv", "open,high,low,close", [(float(x[0]), float(x.max()), float(x.min()), float(x[-1])) for x in steps]),
        "obligors": write("obligors.csv", "probability,exposure", [(0.01 + 0.0005 * k, 1 + k % 20) for k in range(60)]),
        "gamma": write("gamma.csv", "", [(-2, 0, 0), (0, -1, 0), (0, 0, 1)]),
        "bad": write("bad.csv", "return,var", [(0.01, 0.02), ("x", 0.02)]),
    }


@pytest.fixture
def run(spark, capsys):
    def call(*argv):
        assert cli.main(["--json", *argv], spark) == 0
        return json.loads(capsys.readouterr().out)

    return call


def test_risk(run, files):
    out = run("risk", files["returns"], "--periods", "252")[0]
    book = files["own"].mean(axis=1)
    want = 2.3263478740408408 * book.std(ddof=1) - book.mean()
    assert abs(out["value_at_risk"] - want) < 1e-9 and abs(out["historical_value_at_risk"] + np.quantile(book, 0.01)) < 1e-9
    assert abs(out["annualised_volatility"] - book.std(ddof=1) * math.sqrt(252)) < 1e-9
    assert run("risk", files["returns"], "--shrink", "--distribution", "cornish-fisher")[0]["value_at_risk"] > 0


def test_allocations(run, files):
    parts = run("contributions", files["returns"], "--weights", "0.5,0.3,0.2")
    assert abs(sum(p["component"] for p in parts) - parts[0]["total"]) < 1e-12
    assert abs(sum(p["weight"] for p in run("parity", files["returns"])) - 1) < 1e-12
    out = run("factors", files["returns"], "--factors", "alpha")
    assert {e["series"] for e in out["exposures"]} == {"beta", "gamma"}


def test_paths(run, files):
    book = np.cumprod(1 + files["own"].mean(axis=1))
    deepest = float((1 - book / np.maximum.accumulate(np.append(1.0, book))[1:]).max())
    assert any(isinstance(v, float) and abs(abs(v) - deepest) < 1e-9 for v in run("drawdown", files["returns"])[0].values())
    out = run("volatility", files["returns"], "--innovation", "normal", "--horizon", "5")[0]
    assert 0 < out["alpha"] + out["beta"] < 1 and out["horizon_volatility"] > 0


def test_tails(run, files):
    assert run("tail", files["returns"], "--confidence", "0.99", "--tail-fraction", "0.1")[0]["exceedances"] >= 20
    out = run("copula", files["returns"], "--paths", "10000", "--pairs", "2")
    assert len(out["pairs"]) == 2 and out["risk"]["expected_tail_loss"] >= out["risk"]["value_at_risk"]
    out = run("bounds", files["returns"], "--points", "64")[0]
    assert out["best"] <= out["comonotonic"] <= out["worst"] * (1 + 1e-9)
    found = run("regime", files["returns"])
    assert len(found["components"]) == 2 and found["value_at_risk"] > 0


def test_measures(run, files):
    out = run("expectile", files["returns"])[0]
    assert out["sample"] > 0 and 0.5 < out["level_matching_es"] < 1
    rows = run("spectrum", files["returns"])
    assert len(rows) == 4 and max(r["charge"] for r in rows) - min(r["charge"] for r in rows) < 1e-6


def test_quadratic_books(run, files):
    base = ("--delta", "1,0.5,0.2", "--gamma", files["gamma"])
    assert run("curvature", files["returns"], *base)[0]["value_at_risk"] > 0
    out = run("worst-case", files["returns"], *base)
    assert out["loss"] >= out["one_at_a_time"] - 1e-12 and set(out["moves"]) == {"alpha", "beta", "gamma"}


def test_views_and_cleaning(run, files):
    out = run("stress", files["returns"], "--on", "alpha", "--mean", "-0.005")
    before, after = (r["expected_tail_loss"] for r in out["risk"])
    assert after > before and out["relative_entropy"] > 0
    assert len(run("clean", files["returns"])) == 3


def test_forecast_files(run, files, spark, capsys):
    out = run("validate", files["forecasts"], "--es-column", "es")[0]
    assert out["count"] == files["breaches"] and out["observations"] == 250
    assert run("score", files["models"], "--confidence", "0.975")
    assert cli.main(["validate", files["bad"]], spark) == 2
    assert "not a finite number" in capsys.readouterr().err
    assert cli.main(["validate", files["forecasts"], "--var-column", "nope"], spark) == 2


def test_obligors(run, files):
    out = run("portfolio", files["obligors"], "--top", "3")
    assert len(out["contributions"]) == 3 and "note" not in out
    assert all(abs(t["saddlepoint"] - t["exact"]) < 0.05 for t in out["tail"][1:])
    assert "lattice points" in run("portfolio", files["obligors"], "--exact-points", "10")["note"]


def test_bars(run, files):
    rows = {r["estimator"]: r["volatility"] for r in run("bars", "--bars", files["bars"])}
    assert len(rows) == 6 and all(v > 0 for v in rows.values())
    watched = {r["estimator"]: r["volatility"] for r in run("bars", "--bars", files["bars"], "--ticks", "50")}
    assert watched["parkinson"] > rows["parkinson"] and watched["close_to_close"] == rows["close_to_close"]


def test_cells_stay_whole(spark, tmp_path):
    """Digits at the ends of a cell are not blanks, whatever its column."""
    (tmp_path / "r.csv").write_text("a,b,c\n 0.10,0.11,0.22\n-0.10 ,0.01,-0.2\n\n")
    panel, names = readers.read_returns(spark, str(tmp_path / "r.csv"))
    assert names == ["a", "b", "c"]
    assert sorted((r["series"], r["r"]) for r in panel.collect()) == [("a", -0.1), ("a", 0.1), ("b", 0.01), ("b", 0.11), ("c", -0.2), ("c", 0.22)]
    (tmp_path / "g.csv").write_text("10,0,0\n0,11,1\n0,1,22\n")
    assert readers.read_gamma(spark, str(tmp_path / "g.csv"), 3).tolist() == [[10, 0, 0], [0, 11, 1], [0, 1, 22]]


def test_bad_input(spark, files, capsys):
    assert cli.main(["risk", files["returns"], "--weights", "1,2"], spark) == 2
    assert "3 weights" in capsys.readouterr().err
    assert cli.main(["tail", files["returns"], "--column", "nope"], spark) == 2


def test_tables(spark, files, capsys):
    assert cli.main(["parity", files["returns"]], spark) == 0
    assert "alpha" in capsys.readouterr().out
