"""Document fingerprints (operator 2): canonical exact digests.

A text's canonical form is its NFKC form, case-folded, with every run of whitespace made one space and the ends
trimmed. Its fingerprint is the 128-bit xxHash of those bytes. Documents are grouped by it, and the bytes inside
each bucket are compared: the bucket is pure when its smallest and largest canonical bytes are equal, which Spark
combines before the shuffle, so that a bucket of a third of all rows is no hot spot. In an impure bucket (a hash
collision) each distinct form gets a number of its own, which is appended to the fingerprint.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import materialise, read, text_slices

#: Documents of neighbouring ids that are read together: at least this many to a range.
RANGE_ROWS = 1000


def canonical(text: str | None) -> bytes:
    """NFKC, case folding and whitespace folding; a null text is empty. Folding can undo a normal form, so it is renewed."""
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(text.split()).encode()


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest) of every row, in place."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in text_slices(batches, 1, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(canonical(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["id", "digest"])

    return base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, digest string")


def _bounds(ids: DataFrame, rows: int) -> list[int]:
    """Where the ranges of ids begin: about equally many rows to a range, at most 20,000 ranges."""
    count, low = ids.agg(F.count("id"), F.min("id")).first()
    parts = min(20_000, max(1, count // max(1, rows)))
    if parts < 2:
        return []
    cuts = ids.stat.approxQuantile("id", [k / parts for k in range(1, parts)], 0.1 / parts)
    return sorted({int(c) for c in cuts if c > low})


def with_next(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rows: int = RANGE_ROWS) -> DataFrame:
    """(id, n_chars, digest, edited_digest, edited_sha256, equals_edited, equals_next, form) of every row.

    The edited text has its last floor(n_chars / 4) code points replaced by as many (or all) of the first of the next
    row's text, in order of (id, text); after the last row the first comes again. ``form`` holds the canonical bytes
    where another row has the same digest, else null. Rows that share an id stand next to each other; a null id comes
    first; a single row is its own neighbour. An empty table gives none.

    The rows are dealt by ranges of ids whose bounds are quantiles, and each range is read as a sorted stream that
    also gets the first row of the following range, so no text moves more than once.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    cuts = _bounds(base.select("id"), rows)
    marks = materialise(fingerprints(base, id_col="id").groupBy("id", "digest").agg(F.count("*").alias("n")), "digests")
    many = marks.groupBy("digest").agg(F.sum("n").alias("all")).where("all > 1")
    flags = marks.join(many, "digest").select("id").distinct()

    at = F.lit(0)
    if cuts:  # the number of bounds at or below the id, without a search per row in Python
        at = F.coalesce(F.size(F.array_compact(F.transform(F.lit(cuts), lambda c: F.when(c <= F.col("id"), c)))), F.lit(0)) if len(cuts) < 32 else _searched(cuts)
    parts = len(cuts) + 1
    spark = docs.sparkSession
    placed = base.withColumn("part", at)
    first = placed.select("id", "part").groupBy("part").agg(F.min(F.coalesce("id", F.lit(-(2**63)))).alias("low"), F.count("*").alias("n"))
    heads = {r["part"]: r["low"] for r in first.collect()}  # one row to a range
    if not heads:
        return spark.createDataFrame([], _SCHEMA)
    order = sorted(heads)
    before = {heads[p]: order[k - 1] for k, p in enumerate(order)}  # a head is also read by the range before it; the first, by the last
    head = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if len(before) < 32 else None
    own = F.coalesce("id", F.lit(-(2**63)))
    if head is not None:
        also = F.try_element_at(head, own)
    else:
        table = spark.createDataFrame(list(before.items()), "low bigint, also int")
        placed = placed.join(F.broadcast(table), own == F.col("low"), "left").drop("low")  # at most 20,000 rows
        also = F.col("also")
    copies = placed.select("id", "text", "part", F.lit(1).alias("kind")).unionByName(
        placed.where(also.isNotNull()).select("id", "text", also.cast("int").alias("part"), F.lit(2).alias("kind"))
    ).unionByName(flags.withColumn("part", at).select("id", F.lit(None).cast("string").alias("text"), "part", F.lit(0).alias("kind")))
    # heads of the following range sort behind the range's own rows; in the last range the very first row does
    dealt = copies.repartition(max(parts, 1), "part").sortWithinPartitions("part", (F.col("kind") == 2), "id", "kind", "text")
    return dealt.mapInArrow(_stream(), _SCHEMA)


_SCHEMA = "id bigint, n_chars bigint, digest string, edited_digest string, edited_sha256 string, equals_edited boolean, equals_next boolean, form binary"


def _searched(cuts: list[int]):
    """Binary search over the bounds as one balanced expression."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("id") >= cuts[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def _stream():
    def run(batches):
        names = ["id", "n_chars", "digest", "edited_digest", "edited_sha256", "equals_edited", "equals_next", "form"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.binary()]
        out: list[tuple] = []
        held = None  # the row that waits for its neighbour
        flagged = object()
        part, closed = None, False

        def pair(a, text, form):
            n = len(a[1])
            k = n // 4
            edited = a[1][: n - k] + text[:k]
            edited_form = canonical(edited)
            return (a[0], n, digest(a[2]), digest(edited_form), hashlib.sha256(edited.encode()).hexdigest(), a[2] == edited_form, a[2] == form, a[2] if a[3] else None)

        for batch in text_slices(batches, 1, 4 << 20):
            for i, text, p, kind in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if p != part:
                    part, held, flagged, closed = p, None, object(), False
                if kind == 0:
                    flagged = i
                    continue
                if closed:
                    continue
                text = text or ""
                form = canonical(text)
                if held is not None:
                    out.append(pair(held, text, form))
                held = (i, text, form, i == flagged)
                closed = kind == 2
            if len(out) > 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def verified(found: DataFrame) -> DataFrame:
    """``found`` with ``collision``: null where all forms of the row's bucket are the same bytes, else the number of the row's form in it."""
    forms = found.where("form is not null").select("digest", "form")
    mixed = materialise(forms.groupBy("digest").agg(F.min("form").alias("low"), F.max("form").alias("high")).where("low <> high").select("digest"), "mixed")
    if mixed.isEmpty():  # as ever, but for a collision of 128-bit hashes
        return found.withColumn("collision", F.lit(None).cast("int"))
    number = F.dense_rank().over(Window.partitionBy("digest").orderBy("form"))
    split = forms.join(mixed, "digest").distinct().select("digest", "form", number.alias("collision"))
    return found.join(split, ["digest", "form"], "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verified(materialise(with_next(read(spark, sf_dir, "documents")), "forms"))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
        F.concat("digest", F.when(F.col("collision").isNotNull(), F.concat(F.lit("."), F.col("collision").cast("string"))).otherwise("")).alias("fingerprint"),
        F.col("edited_digest").alias("edited_fingerprint"), F.col("equals_edited").cast("double").alias("near_edited"), F.col("equals_next").cast("double").alias("near_next"),
    )
