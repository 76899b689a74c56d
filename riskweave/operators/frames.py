"""Windows, guards and matrix helpers that the operators share.

A panel is a long frame (series, t, r): one row per series and period. All operators work per series in one plan,
so ten thousand series cost one query. Raw facts must be aggregated to periods before any ordered window.
"""

from __future__ import annotations

import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.errors import Misaligned, TooShort


def by_time(series: str = "series", t: str = "t"):
    return Window.partitionBy(series).orderBy(t)


def so_far(series: str = "series", t: str = "t"):
    return by_time(series, t).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def of_series(series: str = "series"):
    return Window.partitionBy(series)


def at_least(frame: DataFrame, minimum: int, what: str, series: str = "series") -> DataFrame:
    """The frame, failing in the plan where a series has fewer than ``minimum`` rows."""
    n = F.count("*").over(of_series(series))
    return frame.withColumn("__n", F.when(n < minimum, F.raise_error(F.concat(F.lit(f"{what} needs {minimum} observations; "), F.col(series).cast("string"), F.lit(" has "), n.cast("string")))).otherwise(n)).where("__n >= 0").drop("__n")


def cut(frame: DataFrame) -> DataFrame:
    """The frame, evaluated once and read back from the folder of ``spark.checkpoint.dir``, which driver and executors share; unset, a local session gets one of its own."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        need(bool(found) or context.master.startswith("local"), ValueError, "spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="riskweave-checkpoints-"))
    return frame.checkpoint()


def matrix(frame: DataFrame, i: str = "i", j: str = "j", v: str = "v") -> tuple[list, np.ndarray]:
    """Names and array of a matrix-long frame (assets by assets: a few thousand rows at most)."""
    rows = frame.select(i, j, v).collect()
    names = sorted({r[0] for r in rows} | {r[1] for r in rows})
    place = {n: k for k, n in enumerate(names)}
    out = np.full((len(names), len(names)), np.nan)
    for a, b, x in rows:
        out[place[a], place[b]] = x
        if np.isnan(out[place[b], place[a]]):
            out[place[b], place[a]] = x
    if np.isnan(out).any():
        raise Misaligned("the matrix has holes")
    return names, out


def matrix_frame(spark, names, values) -> DataFrame:
    """A matrix-long frame (i, j, v) of an array."""
    return spark.createDataFrame([(a, b, float(values[p][q])) for p, a in enumerate(names) for q, b in enumerate(names)], "i string, j string, v double")


def weights_frame(spark, weights: dict) -> DataFrame:
    return spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "series string, w double")


def need(ok: bool, error: type[Exception], message: str) -> None:
    if not ok:
        raise error(message)


def require_rows(n: int, minimum: int, what: str) -> None:
    need(n >= minimum, TooShort, f"{what} needs {minimum} observations, got {n}")


def positive_share(x: Column, total: Column) -> Column:
    return F.when(total != 0, x / total)
