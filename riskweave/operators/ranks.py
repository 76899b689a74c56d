"""Rank correlation and its inversion to a copula correlation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions import linalg
from riskweave.operators.frames import require_rows

# Fixed value.
MINIMUM_RANK_OBSERVATIONS = 20


def ranks_of(panel: DataFrame, value: str = "r") -> DataFrame:
    """The panel with ``rank``, ties sharing their mean rank."""
    order = Window.partitionBy("series").orderBy(value)
    return panel.withColumn("rank", F.rank().over(order) + (F.count("*").over(Window.partitionBy("series", value)) - 1) / 2)


def _pairs(panel: DataFrame, value: str) -> DataFrame:
    a = panel.select("t", F.col("series").alias("i"), F.col(value).alias("x"))
    return a.join(panel.select("t", F.col("series").alias("j"), F.col(value).alias("y")), "t").where("i < j")


def _full(upper: DataFrame, panel: DataFrame) -> DataFrame:
    own = panel.select(F.col("series").alias("i")).distinct().select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    return upper.unionByName(upper.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")).unionByName(own)


def spearman_matrix(panel: DataFrame) -> DataFrame:
    """(i, j, v): Pearson correlation of mean ranks, of an aligned panel; null beside a constant series."""
    s = _pairs(ranks_of(panel), "rank").groupBy("i", "j").agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return _full(s.select("i", "j", F.try_divide(F.col("c"), F.col("sx") * F.col("sy")).alias("v")), panel)


def kendall_tau(x, y) -> float:
    """tau-b in O(n log n): discordant pairs are inversions of y in order of x, counted by merging."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    require_rows(len(x), MINIMUM_RANK_OBSERVATIONS, "a rank correlation")
    order = np.lexsort((y, x))
    x, y = x[order], np.unique(y[order], return_inverse=True)[1]
    n = len(x)

    def tied(*keys) -> int:
        counts = np.unique(np.stack(keys, 1), axis=0, return_counts=True)[1].astype(object)
        return int((counts * (counts - 1) // 2).sum())

    swaps, width, z = 0, 1, y.copy()
    while width < n:
        for at in range(0, n - width, 2 * width):
            left, right = z[at : at + width], z[at + width : at + 2 * width]
            swaps += int((len(left) - np.searchsorted(left, right, "right")).sum())
            z[at : at + len(left) + len(right)] = np.sort(z[at : at + len(left) + len(right)], kind="stable")
        width *= 2
    pairs, tx, ty, both = n * (n - 1) // 2, tied(x), tied(y), tied(x, y)
    spread = math.sqrt((pairs - tx) * (pairs - ty))
    return (pairs - tx - ty + both - 2 * swaps) / spread if spread else 0.0


def kendall_tau_quadratic(x, y) -> float:
    """The same from all pairs, for tests."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    spread = math.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / spread) if spread else 0.0


def spearman_rho(x, y) -> float:
    require_rows(len(x), MINIMUM_RANK_OBSERVATIONS, "a rank correlation")
    a, b = pd.Series(x).rank(), pd.Series(y).rank()
    a, b = a - a.mean(), b - b.mean()
    spread = math.sqrt((a @ a) * (b @ b))
    return float(a @ b / spread) if spread else 0.0


def kendall_matrix(panel: DataFrame) -> DataFrame:
    """(i, j, v): tau-b of every pair of series, each pair in a task of its own."""

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "j": [pdf["j"].iloc[0]], "v": [kendall_tau(pdf["x"], pdf["y"])]})

    return _full(_pairs(panel, "r").groupBy("i", "j").applyInPandas(pair, "i string, j string, v double"), panel)


def correlation_from_kendall(tau: float) -> float:
    return math.sin(math.pi * tau / 2)


def correlation_from_spearman(rho: float) -> float:
    return 2 * math.sin(math.pi * rho / 6)


def elliptical_correlation(rank_matrix, *, floor: float = 1e-8) -> tuple[np.ndarray, bool]:
    """(correlation, projected): Kendall's matrix inverted entry by entry; not positive semidefinite, it is clipped and its diagonal renewed."""
    m = np.sin(np.pi * np.asarray(rank_matrix, float) / 2)
    np.fill_diagonal(m, 1.0)
    if linalg.is_positive_semidefinite(m, tolerance=1e-8):
        return m, False
    m = linalg.nearest_psd(m, floor=floor)
    d = np.sqrt(np.diag(m))
    m = m / np.outer(d, d)
    np.fill_diagonal(m, 1.0)
    return m, True
