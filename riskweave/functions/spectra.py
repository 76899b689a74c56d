"""Risk spectra: weight functions on [0, 1] with their mass over an interval, for numbers, arrays or Columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.errors import BadSpectrum
from riskweave.functions import columns, special
from riskweave.operators.frames import need


def _least(a, b):
    return F.least(a, F.lit(b)) if isinstance(a, Column) else min(a, b)


def _exp(a):
    return F.exp(a) if isinstance(a, Column) else math.exp(a)


def _pow(a, b):
    return F.pow(a, F.lit(b)) if isinstance(a, Column) else math.pow(a, b)


@dataclass(frozen=True)
class TailSpectrum:
    probability: float

    def __post_init__(self) -> None:
        need(0 < self.probability <= 1, BadSpectrum, "the probability must lie in (0, 1]")

    name = property(lambda self: f"expected tail loss at {1 - self.probability:.4%}")
    is_coherent = property(lambda self: True)
    breaks = property(lambda self: (self.probability,))

    def density(self, level: float) -> float:
        return (level < self.probability) / self.probability

    def mass(self, lower, upper):
        return (_least(upper, self.probability) - _least(lower, self.probability)) / self.probability


@dataclass(frozen=True)
class ExponentialSpectrum:
    aversion: float

    def __post_init__(self) -> None:
        need(self.aversion > 0 and math.isfinite(self.aversion), BadSpectrum, "the aversion must be positive")

    name = property(lambda self: f"exponential at aversion {self.aversion:g}")
    is_coherent = property(lambda self: True)
    breaks = property(lambda self: ())
    scale = property(lambda self: -math.expm1(-self.aversion))

    def density(self, level: float) -> float:
        return self.aversion * math.exp(-self.aversion * level) / self.scale

    def mass(self, lower, upper):
        return (_exp(-self.aversion * lower) - _exp(-self.aversion * upper)) / self.scale


@dataclass(frozen=True)
class PowerSpectrum:
    exponent: float

    def __post_init__(self) -> None:
        need(self.exponent > 0 and math.isfinite(self.exponent), BadSpectrum, "the exponent must be positive")

    name = property(lambda self: f"power at exponent {self.exponent:g}")
    is_coherent = property(lambda self: self.exponent >= 1)
    breaks = property(lambda self: ())

    def density(self, level: float) -> float:
        return self.exponent * math.pow(1 - level, self.exponent - 1)

    def mass(self, lower, upper):
        return _pow(1 - lower, self.exponent) - _pow(1 - upper, self.exponent)


@dataclass(frozen=True)
class WangSpectrum:
    shift: float

    def __post_init__(self) -> None:
        need(self.shift >= 0 and math.isfinite(self.shift), BadSpectrum, "the shift must not be negative")

    name = property(lambda self: f"Wang transform at shift {self.shift:g}")
    is_coherent = property(lambda self: True)
    breaks = property(lambda self: ())

    def density(self, level: float) -> float:
        return math.exp(-self.shift * special.normal_ppf(level) - self.shift**2 / 2)

    def _below(self, p):
        if isinstance(p, Column):
            return F.when(p <= 0, 0.0).when(p >= 1, 1.0).otherwise(columns.cdf(columns.ppf(p) + self.shift))
        return 0.0 if p <= 0 else 1.0 if p >= 1 else special.normal_cdf(special.normal_ppf(p) + self.shift)

    def mass(self, lower, upper):
        return self._below(upper) - self._below(lower)


@dataclass(frozen=True)
class MixtureSpectrum:
    """A convex mix of tail spectra: pairs (probability, weight), weights in proportion."""

    components: tuple

    def __post_init__(self) -> None:
        need(bool(self.components) and all(0 < p <= 1 and w > 0 for p, w in self.components), BadSpectrum, "probabilities in (0, 1] and positive weights")

    total = property(lambda self: sum(w for _, w in self.components))
    name = property(lambda self: "mixture of (" + ", ".join(f"{w / self.total:g} at {1 - p:.4%}" for p, w in self.components) + ")")
    is_coherent = property(lambda self: True)
    breaks = property(lambda self: tuple(sorted({p for p, _ in self.components})))

    def density(self, level: float) -> float:
        return sum(w * TailSpectrum(p).density(level) for p, w in self.components) / self.total

    def mass(self, lower, upper):
        out = 0.0
        for p, w in self.components:
            out = out + TailSpectrum(p).mass(lower, upper) * (w / self.total)
        return out
