"""Readers and writers: returns, bars, obligors, gamma matrices, forecasts; text tables and JSON.

Files are read by Spark, so any store it knows will do. Guards run as one aggregation over the parsed rows.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.errors import InputError
from riskweave.operators.series import Convention, from_columns



def _rows(spark: SparkSession, path: str) -> DataFrame:
    """(line, cells) of the lines that are not blank; line counts all lines of a file from 1."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return text.where(F.trim("value") != "").select((F.col("line") + 1).alias("line"), F.transform(F.split("value", ","), lambda x: F.trim(x)).alias("cells"))


def _refuse(frame: DataFrame, bad: Column, what: str) -> None:
    row = frame.where(bad).orderBy("line").select("line").first()
    if row is not None:
        raise InputError(f"line {row[0]}: {what}")


def read_returns(spark: SparkSession, path: str, convention: Convention = Convention.SIMPLE) -> tuple[DataFrame, list[str]]:
    """(panel, names) of a CSV with a header and, where the first cell of the first row is no number, a first column of labels.

    Refused: no rows, ragged rows, cells that are not finite numbers, repeated names, values of -1 or less, and columns
    whose typical size is above 1 (prices or percentages). Panels keep the file's order as t and the labels as label.
    """
    rows = _rows(spark, path).cache()
    first = rows.orderBy("line").limit(2).collect()
    if len(first) < 2:
        raise InputError("the file has no rows below its header")
    header, sample = first[0]["cells"], first[1]["cells"]

    def is_number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    labelled = not is_number(sample[0])
    names = header[int(labelled) :]
    if len(set(names)) != len(names) or not names:
        raise InputError("column names are missing or repeated")
    body = rows.where(F.col("line") > first[0]["line"])
    _refuse(body, F.size("cells") != len(header), f"a row of other than {len(header)} cells")
    values = [F.col("cells")[k + labelled].try_cast("double") for k in range(len(names))]
    wrong = [v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) for v in values]
    _refuse(body, reduce(lambda a, b: a | b, wrong), "a cell that is not a finite number")
    wide = body.select(F.col("line").cast("bigint").alias("t"), (F.col("cells")[0] if labelled else F.col("line").cast("string")).alias("label"), *[v.alias(f"c{k}") for k, v in enumerate(values)])
    _refuse(wide.withColumnRenamed("t", "line"), reduce(lambda a, b: a | b, [F.col(f"c{k}") <= -1 for k in range(len(names))]), "a return of -1 or less")
    typical = wide.agg(*[F.percentile_approx(F.abs(f"c{k}"), 0.5) for k in range(len(names))]).first()
    for name, size in zip(names, typical, strict=True):
        if size > 1:
            raise InputError(f"{name}: prices or percentages, not returns")
    panel = from_columns(wide, [f"c{k}" for k in range(len(names))], "t", convention)
    renamed = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (f"c{k}", n)])
    return panel.withColumn("series", renamed[F.col("series")]).join(wide.select("t", "label"), "t"), names


def read_forecasts(spark: SparkSession, path: str, returns: str = "return", var: str = "var", es: str | None = "es") -> DataFrame:
    """(series, t, r, var[, es]) of a CSV with a header."""
    raw = spark.read.csv(path, header=True)
    wanted = {"r": returns, "var": var} | ({"es": es} if es and es in raw.columns else {})
    if missing := [c for c in wanted.values() if c not in raw.columns]:
        raise InputError(f"no column {missing[0]}")
    parsed = raw.select(F.lit("portfolio").alias("series"), F.monotonically_increasing_id().alias("t"), *[F.col(f"`{c}`").try_cast("double").alias(k) for k, c in wanted.items()])
    bad = reduce(lambda a, b: a | b, [F.col(k).isNull() | F.isnan(k) | (F.abs(k) == float("inf")) for k in wanted])
    _refuse(parsed.withColumnRenamed("t", "line"), bad, "a forecast that is not a finite number")
    return parsed


def read_bars(spark: SparkSession, path: str, name: str = "bars") -> DataFrame:
    """(series, t, open, high, low, close): the last four cells of each line, with or without a header."""
    rows = _rows(spark, path)
    cells = [F.try_element_at("cells", F.lit(-4 + k)).try_cast("double") for k in range(4)]
    parsed = rows.select(F.col("line").cast("bigint").alias("t"), *[c.alias(n) for c, n in zip(cells, ("open", "high", "low", "close"), strict=True)])
    start = parsed.agg(F.min("t")).first()[0]
    body = parsed.where((F.col("t") > start) | F.col("open").isNotNull())
    _refuse(body.withColumnRenamed("t", "line"), F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull(), "a bar that is not four numbers")
    return body.select(F.lit(name).alias("series"), "t", "open", "high", "low", "close")


def read_obligors(spark: SparkSession, path: str) -> DataFrame:
    """(obligor, probability, exposure): two numbers a line, by commas or blanks; # starts a comment, a header may lead."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    cut = text.select("line", F.trim(F.regexp_replace("value", "#.*", "")).alias("value")).where("value <> ''")
    cells = F.split("value", r"[,\s]+")
    rows = cut.select(F.col("line").cast("bigint").alias("obligor"), F.get(cells, F.lit(0)).try_cast("double").alias("probability"), F.get(cells, F.lit(1)).try_cast("double").alias("exposure"))
    start = rows.agg(F.min("obligor")).first()[0]
    body = rows.where((F.col("obligor") > start) | F.col("probability").isNotNull())
    _refuse(body.withColumnRenamed("obligor", "line"), F.col("probability").isNull() | ~F.col("probability").between(0, 1) | ~(F.col("exposure") > 0), "not a probability and a positive exposure")
    return body


def read_gamma(spark: SparkSession, path: str, size: int) -> np.ndarray:
    rows = [[float(x) for x in r["cells"]] for r in _rows(spark, path).orderBy("line").collect()]
    if len(rows) != size or any(len(r) != size for r in rows):
        raise InputError(f"a gamma matrix of {size} by {size} is needed")
    return np.array(rows)


def table_text(rows: list[dict]) -> str:
    """An aligned text table."""
    if not rows:
        return ""
    names = list(rows[0])
    cells = [[f"{v:.6g}" if isinstance(v, float) else str(v) for v in r.values()] for r in rows]
    width = [max(len(n), *(len(c[k]) for c in cells)) for k, n in enumerate(names)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, width, strict=True)).rstrip() for line in [names, *cells])


def json_text(payload) -> str:
    return json.dumps(payload, indent=2, default=str)
