"""Recursions v' = a + b v along every series, as a prefix scan of affine maps.

Periods are cut into chunks by time, which any task can tell from a row and the ends of its series; a hot series is many
chunks. A chunk's rows fall into runs short enough for b**run to stay in range. Within a run the sums of b**-i a_i give
the recursion from 0; a run as a whole is one affine map. Maps are composed once a series, a few numbers for thousands
of periods, and what enters each run is joined back and applied. All of it are built-in aggregates and windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, NumericType, TimestampNTZType, TimestampType

#: Periods of a chunk, on average, and of a run, at most.
CHUNK, RUN = 1 << 16, 1 << 12
#: b**run stays within exp(+-LOGS).
LOGS = 500.0
_BLOCK = 256


def clock(t: Column, kind: DataType) -> Column:
    """A number that grows with a period's key; 0 for keys that are no numbers, dates or times, whose series are one chunk."""
    if isinstance(kind, NumericType):
        return t.cast("double")
    if isinstance(kind, DateType):
        return F.unix_date(t).cast("double")
    if isinstance(kind, TimestampType | TimestampNTZType):
        return F.unix_micros(t.cast("timestamp")).cast("double")
    return F.lit(0.0)


def chunked(panel: DataFrame, size: int, *also: Column) -> DataFrame:
    """The panel with ``chunk`` and the aggregates ``also`` of each series."""
    at = clock(F.col("t"), panel.schema["t"].dataType)
    ends = panel.groupBy("series").agg(F.min(at).alias("lo"), F.max(at).alias("hi"), F.count("*").alias("n"), *also)
    parts = F.ceil(F.col("n") / size)
    share = F.when(F.col("hi") > F.col("lo"), (at - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    chunk = F.least(F.floor(share * parts), parts - 1).cast("bigint")
    return panel.join(ends, "series").withColumn("chunk", chunk).drop("lo", "hi", "n")


def affine(panel: DataFrame, a: Column, b: float, start: Column, *, chunk: int = CHUNK, run: int = RUN) -> DataFrame:
    """(series, t, r, v, next_v): v is the value before a period, from the aggregate ``start`` at the first; next_v the one after the last.

    ``a`` is a column of the panel's rows. Periods of a series are ordered by t, equal ones by r.
    """
    run = max(1, min(run, int(LOGS / abs(math.log(b))) if b not in (0.0, 1.0) else (1 if b == 0.0 else run)))
    rows = chunked(panel.select("series", "t", "r"), chunk, start.cast("double").alias("v0"))
    place = (F.row_number().over(Window.partitionBy("series", "chunk").orderBy("t", "r")) - 1).cast("bigint")
    rows = rows.withColumn("k", place).withColumn("run", F.floor(F.col("k") / run)).withColumn("j", F.col("k") % run)
    scaled = a * F.pow(F.lit(float(b)), -F.col("j"))
    before = Window.partitionBy("series", "chunk", "run").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    maps = rows.groupBy("series", "chunk", "run").agg(F.count("*").alias("m"), F.sum(scaled).alias("s"), F.max("v0").alias("v0"))
    maps = maps.select("series", "v0", F.struct("chunk", "run", (F.col("s") * F.pow(F.lit(float(b)), F.col("m") - 1)).alias("a"), F.pow(F.lit(float(b)), F.col("m")).alias("b")).alias("map"))
    carried = maps.groupBy("series").agg(F.array_sort(F.collect_list("map")).alias("maps"), F.max("v0").alias("v0"))
    carried = carried.select("series", _composed(F.col("maps"), F.col("v0")).alias("c"))
    enters = carried.select("series", F.col("c.v").alias("next_v"), F.explode("c.enters").alias("e")).select("series", "e.chunk", "e.run", F.col("e.v").alias("enter"), "next_v")
    inside = F.coalesce(F.sum(scaled).over(before), F.lit(0.0)) * F.pow(F.lit(float(b)), F.col("j") - 1)
    rows = rows.withColumn("inside", F.when(F.col("j") > 0, inside).otherwise(0.0))
    return rows.join(enters, ["series", "chunk", "run"]).select("series", "t", "r", (F.col("inside") + F.pow(F.lit(float(b)), F.col("j")) * F.coalesce("enter", "v0")).alias("v"), "next_v")  # v0 keeps both uses of the rows one shuffle


def _composed(maps: Column, start: Column) -> Column:
    """What enters each map of a sorted array, and what leaves the last; finished blocks are put aside, so that appending stays cheap."""
    kind = "array<struct<chunk:bigint,run:bigint,v:double>>"
    first = F.struct(start.alias("v"), F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("part"))

    def step(s, x):
        full = F.size(s["part"]) >= _BLOCK
        part = F.when(full, F.array().cast(kind)).otherwise(s["part"])
        more = F.concat(part, F.array(F.struct(x["chunk"].alias("chunk"), x["run"].alias("run"), s["v"].alias("v"))))
        return F.struct((x["a"] + x["b"] * s["v"]).alias("v"), F.when(full, F.concat(s["done"], F.array(s["part"]))).otherwise(s["done"]).alias("done"), more.alias("part"))

    return F.aggregate(maps, first, step, lambda s: F.struct(s["v"].alias("v"), F.flatten(F.concat(s["done"], F.array(s["part"]))).alias("enters")))
