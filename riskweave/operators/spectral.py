"""Spectral risk: the sorted sample weighted by a spectrum's mass."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.errors import BadSpectrum
from riskweave.functions import special
from riskweave.functions.spectra import ExponentialSpectrum, MixtureSpectrum, PowerSpectrum, TailSpectrum, WangSpectrum
from riskweave.operators.frames import need
from riskweave.operators.historical import ranked

Spectrum = TailSpectrum | ExponentialSpectrum | PowerSpectrum | WangSpectrum | MixtureSpectrum


def spectral_risks(panel: DataFrame, spectra: dict[str, Spectrum], value: str = "r") -> DataFrame:
    """(series, one column per spectrum): signed weighted averages, worst first; all spectra share one sort."""
    rows = ranked(panel, value).select("series", F.col(value).alias("x"), ((F.col("rn") - 1) / F.col("n")).alias("a"), (F.col("rn") / F.col("n")).alias("b"))
    return rows.groupBy("series").agg(*[F.sum(s.mass(F.col("a"), F.col("b")) * F.col("x")).alias(name) for name, s in spectra.items()])


def spectral_risk(returns, spectrum: Spectrum) -> float:
    x = np.sort(np.asarray(returns, float))
    n = len(x)
    need(n > 0, BadSpectrum, "no returns")
    return math.fsum(spectrum.mass(k / n, (k + 1) / n) * v for k, v in enumerate(x))


def tail_shares(panel: DataFrame, spectrum: Spectrum, probability: float, value: str = "r") -> DataFrame:
    """(series, charge, extreme, probability, share): the spectrum's charge against the mean, and the part from below the probability."""
    rows = ranked(panel, value).withColumn("mean", F.avg(value).over(Window.partitionBy("series")))
    a, b = (F.col("rn") - 1) / F.col("n"), F.col("rn") / F.col("n")
    cut = lambda c: F.least(c, F.lit(probability))
    gap = F.col("mean") - F.col(value)
    out = rows.groupBy("series").agg(F.sum(spectrum.mass(a, b) * gap).alias("charge"), F.sum(spectrum.mass(cut(a), cut(b)) * gap).alias("extreme"))
    return out.select("series", "charge", "extreme", F.lit(probability).alias("probability"), F.try_divide("extreme", "charge").alias("share"))


@dataclass(frozen=True)
class Coherent:
    subadditivity: float
    comonotonic: float
    spectrum_is_coherent: bool

    @property
    def subadditive(self) -> bool:
        return self.subadditivity <= 1e-12


def check_coherence(first, second, spectrum: Spectrum) -> Coherent:
    """Gaps rho(X) + rho(Y) - rho(X + Y) of signed averages: as paired, and paired by rank."""
    x, y = np.asarray(first, float), np.asarray(second, float)
    apart = spectral_risk(x, spectrum) + spectral_risk(y, spectrum)
    return Coherent(apart - spectral_risk(x + y, spectrum), apart - spectral_risk(np.sort(x) + np.sort(y), spectrum), spectrum.is_coherent)


def normal_spectral(*, mean: float, volatility: float, spectrum: Spectrum, nodes: int = 64) -> float:
    """Signed spectral average of a normal return; Gauss-Legendre on panels graded towards both ends and cut at the spectrum's breaks."""
    if isinstance(spectrum, WangSpectrum):
        return mean - volatility * spectrum.shift
    edges = {0.0, 0.5, 1.0, *spectrum.breaks} | {10.0**-k for k in range(1, 16)} | {1 - 10.0**-k for k in range(1, 15)}
    grid = sorted(edges)
    u, w = np.polynomial.legendre.leggauss(nodes)
    total = 0.0
    for a, b in zip(grid, grid[1:], strict=False):
        p = a + (u + 1) / 2 * (b - a)
        total += (b - a) / 2 * sum(wk * spectrum.density(pk) * special.normal_ppf(min(max(pk, 1e-300), 1 - 1e-16)) for wk, pk in zip(w, p, strict=True))
    return mean + volatility * total


def matching_shift(target: float, *, mean: float, volatility: float) -> float:
    """The Wang shift whose normal spectral average is the target."""
    shift = (mean - target) / volatility
    need(shift >= 0, BadSpectrum, "the target lies above the mean")
    return shift
