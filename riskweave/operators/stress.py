"""The worst a plausible set of factor moves can do: the trust-region problem on the Mahalanobis ellipsoid."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from riskweave.functions import linalg, special
from riskweave.operators.quadratic import Exposure, StandardForm, whitening

# Fixed values.
BISECTIONS = 200
DEGENERATE = 1e-12


def radius_for(probability: float, factors: int) -> float:
    """The radius that holds the probability of a joint normal move."""
    return math.sqrt(special.chi_square_ppf(probability, factors))


@dataclass(frozen=True)
class MaximumLoss:
    loss: float
    point: np.ndarray
    radius: float
    multiplier: float
    interior: bool
    hard_case: bool


def _value(form: StandardForm, u: np.ndarray) -> float:
    return float(form.constant + form.linear @ u + 0.5 * form.curvature @ (u * u))


def maximum_loss(form: StandardForm, radius: float) -> MaximumLoss:
    """Least value over |u| <= radius: u = -b / (c + m) with the smallest m >= 0 that makes the form convex and stays inside."""
    b, c = form.linear, form.curvature
    low = c.min()
    scale = max(np.abs(c).max(), np.abs(b).max(), 1e-300)
    if low > 0 and np.linalg.norm(b / c) <= radius:
        u = -b / c
        return MaximumLoss(-_value(form, u), u, radius, 0.0, True, False)
    floor = max(0.0, -low)
    bottom = c - low <= DEGENERATE * scale
    norm = lambda m: float(np.linalg.norm(b / (c + m)))
    if low <= 0 and np.abs(b[bottom]).max() <= DEGENERATE * scale:
        rest = np.zeros(len(b))
        rest[~bottom] = -b[~bottom] / (c[~bottom] + floor)
        left = radius**2 - float(rest @ rest)
        if left >= 0:  # nothing pulls along the most concave axis: go there as far as the ball allows
            u = rest.copy()
            u[int(np.flatnonzero(bottom)[0])] = math.sqrt(left)
            return MaximumLoss(-_value(form, u), u, radius, floor, False, True)
    high = floor + float(np.linalg.norm(b)) / radius + scale
    a = floor + (high - floor) * 1e-16
    m = special._root(lambda x: radius - norm(x), a, high, BISECTIONS)
    u = -b / (c + m)
    u *= radius / np.linalg.norm(u)
    return MaximumLoss(-_value(form, u), u, radius, m, False, False)


def linear_maximum_loss(delta, covariance, radius: float) -> float:
    return radius * math.sqrt(linalg.quadratic_form(delta, covariance))


@dataclass(frozen=True)
class Scenario:
    loss: float
    move: np.ndarray
    standardised: np.ndarray
    detail: MaximumLoss

    mahalanobis = property(lambda self: float(np.linalg.norm(self.detail.point)))


def worst_case_scenario(exposure: Exposure, covariance, radius: float) -> Scenario:
    w = whitening(exposure, covariance)
    d = maximum_loss(w.form, radius)
    move = w.to_factors(d.point)
    return Scenario(d.loss, move, move / np.sqrt(np.diag(np.asarray(covariance, float))), d)


@dataclass(frozen=True)
class OneAtATime:
    losses: np.ndarray
    worst: float
    worst_factor: int
    total: float
    moves: np.ndarray
    inside: bool


def one_at_a_time(exposure: Exposure, covariance, radius: float, *, on_the_ellipsoid: bool = True) -> OneAtATime:
    """Each factor moved alone both ways, to the ellipsoid or by radius deviations."""
    m = np.asarray(covariance, float)
    inverse = np.linalg.inv(m)
    step = radius / np.sqrt(np.diag(inverse)) if on_the_ellipsoid else radius * np.sqrt(np.diag(m))
    curve = 0.5 * np.diag(exposure.gamma) * step**2
    up, down = -(exposure.constant + exposure.delta * step + curve), -(exposure.constant - exposure.delta * step + curve)
    losses = np.maximum(up, down)
    k = int(losses.argmax())
    moves = np.where(up >= down, step, -step)
    inside = bool((moves**2 * np.diag(inverse) <= radius**2 * (1 + 1e-9)).all())
    return OneAtATime(losses, float(losses[k]), k, float(losses.sum()), moves, inside)
