"""Moments of all pairs of series without joining the panel to itself: outer products of period chunks, added per block of series.

A chunk holds whole periods (they are dealt by a hash into as many chunks as the session has shuffle partitions) as a dense
matrix with a mask. For every two blocks of at most about ``BLOCK`` series it emits one row of matrix products, and rows of
the same blocks are added up as a stream. What is shuffled is the panel once and, for each chunk, one square of moments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Series of a block, on average.
BLOCK = 256
#: Moments of a pair over the periods both have: count, xy, xx, yy, xxyy, xxxy, xyyy.
NAMES = ("n", "s", "sii", "sjj", "xy2", "x3y", "xy3")
_KINDS = 7
_ROWS = "a bigint, b bigint, left array<string>, right array<string>, m array<double>"
_CELLS = "inner boolean, i string, j string, n bigint, " + ", ".join(f"{c} double" for c in NAMES[1:])


def _chunk(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)).select(["series", "block", "t", "x"]).combine_chunks()
    series, t = (table[c].combine_chunks().dictionary_encode() for c in ("series", "t"))
    names, x = series.dictionary.to_pylist(), np.asarray(table["x"])
    row, column = np.asarray(t.indices), np.asarray(series.indices)
    wide, mask = np.zeros((len(t.dictionary), len(names))), np.zeros((len(t.dictionary), len(names)))
    wide[row, column], mask[row, column] = x, 1.0
    block = np.zeros(len(names), np.int64)
    block[column] = np.asarray(table["block"])
    members = {b: np.flatnonzero(block == b) for b in sorted(set(block.tolist()))}
    for a, p in members.items():
        xa, ma = wide[:, p], mask[:, p]
        for b, q in members.items():
            if a > b:
                continue
            xb, mb = wide[:, q], mask[:, q]
            parts = [ma.T @ mb, xa.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb), (xa * xa).T @ (xb * xb), (xa**3).T @ xb, xa.T @ xb**3]
            yield _row(a, b, [names[k] for k in p], [names[k] for k in q], np.stack(parts))


def _row(a: int, b: int, left: list[str], right: list[str], m: np.ndarray) -> pa.RecordBatch:
    text, flat = pa.list_(pa.string()), pa.ListArray.from_arrays(pa.array([0, m.size], pa.int32()), pa.array(m.ravel()))
    return pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([b], pa.int64()), pa.array([left], text), pa.array([right], text), flat], names=["a", "b", "left", "right", "m"])


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the rows of two blocks, by name as chunks may lack series; emits their pairs, those inside a block in both orders."""
    left: dict[str, int] = {}
    right: dict[str, int] = {}
    total = np.zeros((_KINDS, 0, 0))
    for batch in batches:
        for k in range(batch.num_rows):
            own = [batch.column(c)[k].as_py() for c in (2, 3)]
            for known, names in ((left, own[0]), (right, own[1])):
                for name in names:
                    known.setdefault(name, len(known))
            total = np.pad(total, ((0, 0), (0, len(left) - total.shape[1]), (0, len(right) - total.shape[2])))
            at = np.ix_(range(_KINDS), [left[x] for x in own[0]], [right[x] for x in own[1]])
            total[at] += np.asarray(batch.column(4)[k].values).reshape(_KINDS, len(own[0]), len(own[1]))
    over = np.divide(total[1:], total[0], out=np.zeros_like(total[1:]), where=total[0] > 0)
    others = pa.array(list(right))
    for name, k in left.items():
        columns = [pa.array([key[0] == key[1]] * len(right)), pa.array([name] * len(right)), others, pa.array(total[0, k].astype(np.int64)), *(pa.array(m[k]) for m in over)]
        yield pa.RecordBatch.from_arrays(columns, names=["inner", "i", "j", *NAMES])


def pair_moments(panel: DataFrame, blocks: int | None = None) -> DataFrame:
    """(i, j, n, s, sii, sjj, xy2, x3y, xy3), i <= j: averages over the n periods that both series have, of returns less each series' own mean.

    ``blocks``: of series; by default one for each ``BLOCK`` of them. Rows without a return take no part.
    """
    kind, spark = panel.schema["series"].dataType, panel.sparkSession
    rows = panel.select("series", "t", "r").where("r is not null and t is not null")
    means = rows.groupBy("series").agg(F.avg("r").alias("mean"))
    parts = F.lit(blocks) if blocks else F.ceil(F.count("*").over(Window.partitionBy(F.lit(0))) / BLOCK)  # one row a series
    means = means.withColumn("block", F.pmod(F.xxhash64("series"), parts).cast("bigint"))
    chunks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.pmod(F.xxhash64("t"), F.lit(chunks))
    dealt = rows.join(means, "series").select(chunk.alias("chunk"), F.col("series").cast("string").alias("series"), "block", F.col("t").cast("string").alias("t"), (F.col("r") - F.col("mean")).alias("x"))
    cells = dealt.groupBy("chunk").applyInArrow(_chunk, _ROWS).groupBy("a", "b").applyInArrow(_added, _CELLS)
    cells = cells.where("n > 0").withColumn("i", F.col("i").cast(kind)).withColumn("j", F.col("j").cast(kind))
    own = F.struct("i", "j", "n", "s", "sii", "sjj", "xy2", "x3y", "xy3")
    turned = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "n", "s", F.col("sjj").alias("sii"), F.col("sii").alias("sjj"), "xy2", F.col("xy3").alias("x3y"), F.col("x3y").alias("xy3"))
    return cells.where(~F.col("inner") | (F.col("i") <= F.col("j"))).select(F.when(F.col("i") <= F.col("j"), own).otherwise(turned).alias("c")).select("c.*")
