"""Hard-negative mining (operator 11): a full score sort per anchor, whose positives' limits are found by binary search.

Anchors are a stated query set: they are broadcast in groups of at most ``GROUP_BYTES`` of vectors, and every row meets
every group inside its own partition. For a block of rows the integer scores of an anchor are lexsorted by score and id.
A first pass reads each anchor's best rows of its own label from those orders, a second one looks each positive's upper
limit up in them and reads the first different-label rows from there to the lower limit. A task keeps the best so far of
each anchor and emits those once; what tasks emit is ranked again per anchor (positives) and per anchor and positive
(negatives), which bounds every group of the shuffles by tasks times k.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import Shared, materialise, read

POSITIVES = 5
K = 10
SCALE = 256.0
#: Negatives lie between these hundredths of the positive's score.
LOWER, UPPER = 30, 90
#: Bytes of the anchors' vectors that one pass broadcasts (or a single anchor).
GROUP_BYTES = 8 << 20
#: Rows of a block, whose scores with an anchor are sorted at once.
BLOCK = 1 << 14
#: Scores that are held at once.
CELLS = 1 << 20
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def quantise(x: np.ndarray, scale: float = SCALE) -> np.ndarray:
    """floor(scale * x) as integers; what leaves 64 bits becomes the nearest 64-bit number."""
    y = np.floor(x * scale)
    high, low = y >= 2.0**63, y < -(2.0**63)
    out = np.where(high | low, 0.0, y).astype(np.int64)
    out[high], out[low] = _MOST, _LEAST
    return out


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices; those that leave 64 bits become the nearest 64-bit number."""
    d = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))
    most = d * _largest(a) * _largest(b)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), _LEAST, _MOST).astype(np.int64)


def limits(score: int, lower: int = LOWER, upper: int = UPPER) -> tuple[int, int]:
    """Smallest and largest negative score n with lower * score <= 100 * n <= upper * score."""
    return -(-lower * score // 100), upper * score // 100


def best_first(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order of each row of ``scores``: highest first, equal ones by ascending id."""
    return np.lexsort((np.broadcast_to(ids, scores.shape), ~scores), axis=1)  # ~x falls as x rises, without overflow


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of the list column as doubles, shorter vectors filled up with zeros, and which rows are free of nulls and non-finite components."""
    flat = column.flatten()
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    good = ~np.asarray(column.is_null())
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) if len(flat) else np.zeros(0)
    row = np.repeat(np.arange(len(column)), size)
    good[row[~np.isfinite(x)]] = False
    out = np.zeros((len(column), int(size.max(initial=0))))
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)] = x
    return out, good


def _blocks(batches, scale: float, block: int = BLOCK):
    """(ids, labels, integer vectors) of the rows that take part, ``block`` rows at a time."""

    def joined(part):
        d = max(v.shape[1] for *_, v in part)
        return np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part]), np.concatenate([np.pad(v, ((0, 0), (0, d - v.shape[1]))) for *_, v in part])

    part, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            piece = batch.slice(at, block)
            x, good = _vectors(piece.column(1))
            good &= ~(np.asarray(piece.column(0).is_null()) | np.asarray(piece.column(2).is_null()))
            x[~good] = 0
            ids, labels = (np.asarray(piece.column(c).fill_null(0)).astype(np.int64)[good] for c in (0, 2))
            part.append((ids, labels, quantise(x[good], scale)))
            n += len(ids)
            if n >= block:
                yield joined(part)
                part, n = [], 0
    if n:
        yield joined(part)


def _merge(kept: tuple, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """The first k of what an anchor kept and of further (score, id), best first."""
    s, i = np.append(kept[0], scores), np.append(kept[1], ids)
    order = np.lexsort((i, ~s))[:k]
    return s[order], i[order]


_NONE = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _finder(shared, k: int, scale: float, lower: int, upper: int):
    """Rows (anchor, slot, score, id): without positives the anchor's best k of its own label (slot 0), else the best k of each positive."""

    def run(batches):
        anchor_ids, anchor_labels, vectors, positives = shared.value
        best: dict[tuple[int, int], tuple] = {}
        for ids, labels, rows in _blocks(batches, scale):
            step = max(1, CELLS // len(ids))
            for a in range(0, len(anchor_ids), step):
                scores = inner(vectors[a : a + step], rows)
                order = best_first(scores, ids)
                for i, own in enumerate(order, a):
                    same = labels[own] == anchor_labels[i]
                    if positives is None:
                        found = own[same & (ids[own] != anchor_ids[i])][:k]
                        best[i, 0] = _merge(best.get((i, 0), _NONE), scores[i - a, found], ids[found], k)
                        continue
                    other = own[~same]
                    down = ~scores[i - a, other]  # ascending
                    for slot, (_, score) in enumerate(positives[i]):
                        low, high = limits(score, lower, upper)
                        if low > high:
                            continue  # a negative score has no room
                        from_ = np.searchsorted(down, ~np.int64(high), "left")
                        to = np.searchsorted(down, ~np.int64(low), "right")
                        found = other[from_ : min(from_ + k, to)]
                        if len(found):
                            best[i, slot] = _merge(best.get((i, slot), _NONE), scores[i - a, found], ids[found], k)
        keys = list(best)
        for at in range(0, len(keys), 1000):
            some = keys[at : at + 1000]
            n = [len(best[x][0]) for x in some]
            cols = [np.repeat(anchor_ids[[x[0] for x in some]], n), np.repeat([x[1] for x in some], n).astype(np.int32), np.concatenate([best[x][0] for x in some]), np.concatenate([best[x][1] for x in some])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "slot", "score", "id"])

    return run


def mine(
    rows: DataFrame, anchors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES,
    k: int = K, scale: float = SCALE, lower: int = LOWER, upper: int = UPPER, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its first ``positives``.

    ``anchors`` has the columns of ``rows``, and usually some of its rows. Ids and labels are integers. Rows with a null id,
    label or vector, or with a null or non-finite component, take no part. Components become floor(scale * x); scores are
    exact integer inner products, components missing from the shorter vector count as 0, and what leaves 64 bits counts as
    the nearest 64-bit number. Highest scores come first, ties by id. Rows that repeat an id are rows of their own and may
    all be listed; an anchor's own id is never its positive. An id that repeats among the anchors is one anchor, the least by
    label, then vector. An anchor without positives, a positive without negatives and empty tables give no rows. Other
    columns are ignored, whatever their names.
    """
    spark = rows.sparkSession

    def three(df):
        return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("bigint").alias("l"))

    usable = "id is not null and l is not null and v is not null and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    base, asked = three(rows), three(anchors).where(usable).groupBy("id").agg(F.min(F.struct("l", "v")).alias("a"))
    size = asked.agg(F.sum(8 * F.size("a.v") + 16)).first()[0] or 0
    groups = max(1, -(-int(size * 1.5) // group_bytes))
    out = None
    for g in range(groups):
        part = asked if groups == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g)
        found = [(r["id"], r["a"]["l"], r["a"]["v"]) for r in part.toLocalIterator()]
        d = max((len(v) for *_, v in found), default=0)
        vectors = quantise(np.array([[*v, *[0.0] * (d - len(v))] for *_, v in found]).reshape(len(found), d), scale)
        own = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64), vectors
        top = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc("id"))
        first = base.mapInArrow(_finder(Shared(spark, (*own, None)), positives, scale, lower, upper), "anchor bigint, slot int, score bigint, id bigint")
        first = first.withColumn("r", F.row_number().over(top)).where(F.col("r") <= positives)
        at = {x: n for n, x in enumerate(own[0].tolist())}
        known: list[list] = [[] for _ in found]  # of this group only
        for r in first.orderBy("anchor", "r").toLocalIterator():
            known[at[r["anchor"]]].append((r["id"], r["score"]))
        second = base.mapInArrow(_finder(Shared(spark, (*own, known)), k, scale, lower, upper), "anchor bigint, slot int, score bigint, id bigint")
        top = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc("id"))
        second = second.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
        pairs = spark.createDataFrame([(int(own[0][n]), s, i, x) for n, v in enumerate(known) for s, (i, x) in enumerate(v)], "anchor bigint, slot int, positive_id bigint, positive_score bigint")
        mined = second.join(F.broadcast(pairs), ["anchor", "slot"]).select(
            F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        if groups > 1:
            mined = materialise(mined, "negatives")
        out = mined if out is None else out.unionByName(mined)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return mine(rows, rows.where("vec_id % 100 = 0"))
