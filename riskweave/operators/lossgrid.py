"""The exact loss distribution of an obligor book as a plan: a convolution tree over the loss lattice.

Obligors that are alike become one binomial factor, cut into pieces of at most a leaf's points, so that neither a book of
one name nor a billion distinct ones meet in one task. A leaf multiplies its factors; each level of the tree multiplies
pairs of nodes. A node is stored as blocks of coefficients: block l of one node times block r of the other adds to blocks
l + r and l + r + 1 of their product, which a grouped sum collects. Masses below ``LEAST`` vanish, so blocks far from the
mean disappear and a product has about as many blocks as its spread needs. Direct products of positive masses keep their
relative precision; long ones go through Fourier transforms, whose error is absolute. ``tilt`` moves the mean to where
precision is wanted (the saddlepoint of a level) and is undone at the end.

Contributions take one obligor out of the tail probabilities again. T(x) = (1 - p) G(x) + p G(x - e) for the rest's tail
G, so G is a geometric series of tail probabilities at steps of the exposure: downwards for p < 1/2, upwards otherwise.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.errors import SaddlepointError
from riskweave.operators.frames import cut, need
from riskweave.operators.saddlepoint import checked_obligors

LEAF_POINTS = 1 << 16
#: Masses below this are 0; about what a double can hold.
LEAST = 1e-300
#: Factors of fewer products of masses are multiplied directly.
DIRECT = 1 << 28
#: A series of tail probabilities ends where its weight falls below this.
SERIES_END = 1e-18


def binomial(count: int, p: float) -> np.ndarray:
    """Masses of 0 .. count successes, summed up from the mode outwards."""
    if p in (0.0, 1.0):
        out = np.zeros(count + 1)
        out[count if p else 0] = 1.0
        return out
    mode = min(count, int((count + 1) * p))
    k = np.arange(1, count + 1)
    step = np.log((count - k + 1) / k) + math.log(p) - math.log1p(-p)  # from k - 1 to k
    logs = np.zeros(count + 1)
    logs[mode + 1 :] = np.cumsum(step[mode:])
    logs[:mode] = -np.cumsum(step[:mode][::-1])[::-1]
    out = np.exp(logs)
    return out / out.sum()


def convolve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product; a transform's masses that it cannot tell from 0 become 0."""
    if len(a) * len(b) <= DIRECT:
        return np.convolve(a, b)
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    out = np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n]
    return np.where(out > np.finfo(float).eps * out.max(), out, 0.0)


def _leaf(block: int):
    """The product of a leaf's factors, shortest first, as blocks."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for p, size, count in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own = np.zeros(size * count + 1)
                own[::size] = binomial(count, p)
                parts.append(own)
        heap = [(len(x), k, x) for k, x in enumerate(parts)]
        heapq.heapify(heap)
        while len(heap) > 1:
            _, _, a = heapq.heappop(heap)
            _, k, b = heapq.heappop(heap)
            x = convolve(a, b)
            heapq.heappush(heap, (len(x), k, x))
        yield from _blocks(key[0].as_py(), 0, heap[0][2], block)

    return run


def _blocks(node: int, first: int, masses: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    for k, at in enumerate(range(0, len(masses), block)):
        own = masses[at : at + block]
        if own.max() >= LEAST:
            yield _row(node, first + k, own)


def _row(node: int, block: int, masses: np.ndarray) -> pa.RecordBatch:
    whole = pa.ListArray.from_arrays(pa.array([0, len(masses)], pa.int32()), pa.array(masses))
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([block], pa.int64()), whole], names=["node", "block", "masses"])


_NODE = "node bigint, block bigint, masses array<double>"


def _products(block: int):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = (batch.column(c)[row] for c in (2, 4))
                x = np.asarray(a.values) if not b.is_valid else convolve(np.asarray(a.values), np.asarray(b.values))
                first = batch.column(1)[row].as_py() + (batch.column(3)[row].as_py() or 0)
                yield from _blocks(batch.column(0)[row].as_py(), first, x, block)

    return run


def _added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros(0)
    for batch in batches:
        for own in batch.column(2):
            x = np.asarray(own.values)
            if len(x) > len(out):
                out = np.append(out, np.zeros(len(x) - len(out)))
            out[: len(x)] += x
    yield _row(key[0].as_py(), key[1].as_py(), out)


def lattice(obligors: DataFrame, unit: float) -> DataFrame:
    """(p, size, count): distinct obligors with exposures as whole numbers of the unit, which they have to be; probabilities of 0 are left out."""
    steps = F.round(F.col("exposure") / unit)
    whole = F.when(F.abs(F.col("exposure") / unit - steps) < 1e-9, steps.cast("bigint")).otherwise(F.raise_error("an exposure is not a multiple of the unit"))
    return checked_obligors(obligors).where("probability > 0").groupBy(F.col("probability").alias("p"), whole.alias("size")).agg(F.count("*").alias("count"))


def exact_masses(obligors: DataFrame, *, unit: float = 1.0, tilt: float = 0.0, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """(loss, mass): the probability of each loss on the lattice of ``unit``, where it is not below ``LEAST``; a book without risk loses 0.

    ``tilt`` (in 1 / loss) multiplies masses by exp(tilt * loss) while they are multiplied.
    """
    need(unit > 0, SaddlepointError, "the unit must be positive")
    groups = lattice(obligors, unit)
    grown = F.col("p") * F.exp(tilt * unit * F.col("size"))
    total = groups.agg(F.sum(F.col("size") * F.col("count")).alias("points"), F.sum(F.col("count") * F.log(1 - F.col("p") + grown)).alias("cumulant")).first()
    spark = obligors.sparkSession
    if not total["points"]:
        return spark.createDataFrame([(0.0, 1.0)], "loss double, mass double")
    leaves = max(1, -(-total["points"] // leaf_points))
    each = F.greatest(F.lit(1), F.floor(leaf_points / F.col("size"))).cast("bigint")
    pieces = groups.select((grown / (1 - F.col("p") + grown)).alias("p"), "size", "count", each.alias("each"), F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / each).cast("int"))).alias("k"))
    pieces = pieces.select("p", "size", F.least("each", F.col("count") - F.col("k") * F.col("each")).alias("count"), F.pmod(F.xxhash64("p", "size", "k"), F.lit(leaves)).alias("leaf"))
    nodes = pieces.groupBy("leaf").applyInArrow(_leaf(leaf_points), _NODE)
    while leaves > 1:
        nodes, leaves = _level(cut(nodes), leaf_points), -(-leaves // 2)  # a level reads the one below several times
    loss = (F.col("block") * leaf_points + F.col("pos")) * unit
    rows = nodes.select("block", F.posexplode("masses").alias("pos", "m")).where(F.col("m") > 0)
    return rows.select(loss.alias("loss"), (F.col("m") * F.exp(total["cumulant"] - tilt * loss) if tilt else F.col("m")).alias("mass"))


def _level(nodes: DataFrame, block: int) -> DataFrame:
    """Products of the nodes 2 k and 2 k + 1. Rows are keyed by the left block as well, so that a pair's work spreads."""
    left = nodes.where("node % 2 = 0").select((F.col("node") / 2).cast("bigint").alias("node"), F.col("block").alias("l"), F.col("masses").alias("a"))
    right = nodes.where("node % 2 = 1").select(((F.col("node") - 1) / 2).cast("bigint").alias("node"), F.col("block").alias("r"), F.col("masses").alias("b"))
    spread = right.join(left.select("node", "l").distinct(), "node").select("node", "l", "r", "b")
    lone = right.join(left.select("node").distinct(), "node", "left_anti").select("node", F.col("r").alias("l"), F.col("b").alias("a"), F.lit(None).cast("bigint").alias("r"), F.lit(None).cast("array<double>").alias("b"))
    pairs = left.join(spread, ["node", "l"], "left").select("node", "l", "a", "r", "b").unionByName(lone).select("node", "l", "a", "r", "b")
    return pairs.mapInArrow(_products(block), _NODE).groupBy("node", "block").applyInArrow(_added, _NODE)


def tails(masses: DataFrame, unit: float = 1.0) -> DataFrame:
    """(loss, mass, tail): tail is the probability of a greater loss.

    Sums run over ranges of the lattice first, and within a range then, so that no task holds all of it.
    """
    ranged = masses.withColumn("range", F.floor(F.col("loss") / (unit * LEAF_POINTS)))
    beyond = ranged.groupBy("range").agg(F.sum("mass").alias("m")).withColumn("beyond", F.coalesce(F.sum("m").over(Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    within = F.coalesce(F.sum("mass").over(Window.partitionBy("range").orderBy(F.desc("loss")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return ranged.withColumn("within", within).join(F.broadcast(beyond.select("range", "beyond")), "range").select("loss", "mass", (F.col("within") + F.col("beyond")).alias("tail"))


def exact_tail(masses: DataFrame, levels: list[float], unit: float = 1.0) -> DataFrame:
    """(level, probability, tail_loss): the probability of a loss above each level, and the mean loss there (null where nothing lies beyond). One pass."""
    rows = masses.sparkSession.createDataFrame([(float(x),) for x in levels], "level double")
    level = F.explode(F.array(*[F.lit(float(x)) for x in set(levels)])).alias("level")
    beyond = masses.select("loss", "mass", level).where(F.col("loss") > F.col("level") + 1e-9 * unit).groupBy("level").agg(F.sum("mass").alias("probability"), F.sum(F.col("mass") * F.col("loss")).alias("m"))
    return rows.join(beyond, "level", "left").select("level", F.coalesce("probability", F.lit(0.0)).alias("probability"), F.try_divide("m", "probability").alias("tail_loss"))


def tail_contributions(obligors: DataFrame, level: float, *, unit: float = 1.0, masses: DataFrame | None = None) -> DataFrame:
    """(obligor, probability, exposure, contribution): E[loss of the obligor; L > level] for every obligor, divided by P(L > level).

    They add up to the tail loss. Distinct obligors are worked out once. The series is longest for probabilities near 1/2.
    """
    masses = cut(exact_masses(obligors, unit=unit) if masses is None else masses)
    tail = tails(masses, unit).select(F.round(F.col("loss") / unit).cast("bigint").alias("x"), "tail")
    first, last = masses.agg(F.round(F.min("loss") / unit), F.round(F.max("loss") / unit)).first()
    above = exact_tail(masses, [level], unit).first()["probability"]
    need(above > 0, SaddlepointError, "nothing lies beyond the level")
    at = math.floor(level / unit + 1e-9)
    p, size = F.col("p"), F.col("size")
    ratio = F.when(p < 0.5, p / (1 - p)).otherwise((1 - p) / p)
    # the j-th term, j from 0: downwards T(level - e - j e) / (1 - p), upwards T(level + j e) / p, signs alternating
    room = F.when(p < 0.5, (at - size - int(first)) / size).otherwise((int(last) - at) / size)
    terms = F.least(F.ceil(math.log(SERIES_END) / F.log(F.least(F.greatest(ratio, F.lit(1e-30)), F.lit(1 - 1e-12)))), F.greatest(F.floor(room) + 1, F.lit(0))).cast("int")
    weight = F.pow(-ratio, F.col("j")) / F.when(p < 0.5, 1 - p).otherwise(p)
    groups = lattice(obligors, unit).select("p", "size", terms.alias("terms"))
    asked = groups.where("terms > 0").select("p", "size", F.explode(F.sequence(F.lit(0), F.col("terms") - 1)).alias("j"))
    asked = asked.select("p", "size", "j", weight.alias("w"), F.when(p < 0.5, at - size - F.col("j") * size).otherwise(at + F.col("j") * size).alias("x"))
    summed = asked.join(_filled(tail, min(int(first), at), int(last)), "x").groupBy("p", "size").agg(F.sum(F.col("w") * F.col("tail")).alias("inner"))
    # below the lattice every loss exceeds: the rest of the series, whose tails are all 1, has a closed sum
    rest = F.when(p < 0.5, F.pow(-ratio, F.col("terms")) / (1 - p) / (1 + ratio)).otherwise(0.0)
    chance = (F.coalesce("inner", F.lit(0.0)) + F.when(F.floor(room) + 1 <= F.col("terms"), rest).otherwise(0.0)).alias("chance")
    each = groups.join(summed, ["p", "size"], "left").select("p", "size", chance)
    own = obligors.select("obligor", "probability", "exposure", F.col("probability").alias("p"), F.round(F.col("exposure") / unit).cast("bigint").alias("size"))
    return own.join(each, ["p", "size"], "left").select("obligor", "probability", "exposure", (F.col("exposure") * F.col("probability") * F.coalesce("chance", F.lit(0.0)) / above).alias("contribution"))


def _filled(tail: DataFrame, first: int, last: int) -> DataFrame:
    """The tail at every lattice point from ``first`` to ``last``; where no mass stands it is that of the point before, and 1 before the first."""
    so_far = F.last("tail", ignorenulls=True).over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    spark = tail.sparkSession
    grid = spark.range(first, last + 1).withColumnRenamed("id", "x").join(tail, "x", "left").withColumn("part", F.floor(F.col("x") / LEAF_POINTS))
    before = grid.groupBy("part").agg(F.min("tail").alias("low")).withColumn("low", F.min("low").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    return grid.withColumn("tail", so_far).join(F.broadcast(before), "part").select("x", F.coalesce("tail", "low", F.lit(1.0)).alias("tail"))
