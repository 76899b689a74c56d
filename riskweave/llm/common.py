"""Shared plumbing: shared-folder tables, text batches, hashing and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the polynomial hash (mod 2**64) and its inverse.
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))

#: Words of the bitmap of ``marked``.
MARKS = 1 << 19


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="riskweave-checkpoints-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: one evaluation, and no lineage left to recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # shuffles behind the table can go now; Spark removes them once they are garbage
    back = spark.read.schema(df.schema).parquet(path)
    back.table_path = path
    return back


def discard(df: DataFrame) -> None:
    """Delete the table behind ``df``, which ``materialise`` returned; nothing that is still to be evaluated may read it."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.table_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with a last column ``marked`` (another name where that is taken): true where ``key`` is in ``wanted``, and for few others while those are few.

    ``wanted``'s hashes are bits of a bitmap of ``MARKS`` words of 64, whose size is fixed; its words are broadcast, so that
    rows which cannot be wanted need no shuffle. A null key is not marked.
    """
    word, bits, flag = (unused(rows, c) for c in ("word", "bits", "marked"))
    place = F.pmod(F.xxhash64(key), F.lit(64 * MARKS))
    bit = place.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    known = wanted.where(F.col(key).isNotNull()).select(F.shiftright(place, 6).alias(word), one.alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    found = rows.withColumn(word, F.shiftright(place, 6)).join(F.broadcast(known), word, "left")
    yes = F.col(bits).bitwiseAND(one) != 0
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(key).isNotNull() & F.coalesce(yes, F.lit(False))).alias(flag))


class Shared:
    """A broadcast object, pickled by value so that workers need no copy of this package. Its size must be bounded by its maker."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if not hasattr(self.sent, "loaded"):  # a worker keeps the broadcast between its tasks
            self.sent.loaded = cloudpickle.loads(self.sent.value)
        return self.sent.loaded


def crc_fold(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


# --- text batches -----------------------------------------------------------------------------


def text_slices(batches, column: int, max_bytes: int):
    """Record batches cut so that each holds at most ``max_bytes`` of text (or a single row)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, starts, ends = utf8(batch.column(column))
        reach = np.cumsum(ends - starts)
        at = 0
        while at < n:
            done = reach[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(reach, done + max_bytes, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each row's text starts and ends in them; a null text is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    first = int(at[0])
    raw = np.frombuffer(data, np.uint8)[first : int(at[-1])] if data is not None else np.zeros(0, np.uint8)
    at = at - first
    ends = at[1:].copy()
    if array.null_count:
        null = np.asarray(array.is_null())
        ends[null] = at[:-1][null]
    return raw, at[:-1], ends


class Powers:
    """Powers of BASE and of its inverse, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(12, int(n - 1).bit_length())
            for name, base in (("up", BASE), ("down", BASE_INV)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up, self.down


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads a 64-bit hash over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def prefix_hash(values: np.ndarray, powers: Powers) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[i:j] * BASE**position; see ``span_hash``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Mixed 64-bit hashes of the sequences [start, end): equal for equal sequences, wherever they stand."""
    h = (prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def space_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool, powers: Powers):
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row: 64-bit hashes, byte starts and ends, and each row's first word (n + 1 numbers)."""
    b = raw
    if lower:
        b = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.zeros(len(b) + 1, bool)
    edge[starts] = True
    edge[ends] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:-1]
    w0 = np.flatnonzero(opens)
    w1 = np.flatnonzero(closes) + 1
    first = np.append(np.searchsorted(w0, starts, "left"), len(w0))
    h = span_hash(prefix_hash(b.astype(np.uint64) + np.uint64(1), powers), w0, w1, powers)
    return h, w0, w1, first


# --- connected components ---------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Union-find over Spark joins: (node, component) for every node of ``edges``, component = its smallest reachable node.

    Alternates large-star and small-star steps; each is a minimum per node (combined before the shuffle) and a
    join back, so no neighbour list is ever gathered. Every round is cut by a table in the shared folder, the last one
    when all edges are stars. Null ends and loops are left out; an empty input gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = materialise(e, "edges")
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        discard(before)
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        links = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("low"))
        if not links.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("low") < 1)))).first()[0]:
            break  # every node has one edge up, to a node that has none
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component")).groupBy("node").agg(F.min("component").alias("component"))


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component), as ``components`` gives them, after more edges (a, b): only the components that these join are worked over. It is a table of its own."""
    ca, cb = (labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    moved = links.join(ca, "a", "left").join(cb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    top = components(moved).select(F.col("node").alias("component"), F.col("component").alias("top"))
    new = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
    every = labels.select("node", "component").unionByName(new.select("node", F.col("node").alias("component")))
    return materialise(every.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "labels")
