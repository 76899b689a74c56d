"""Ranked lexical search (operator 13): WAND over an inverted index per document shard, shard heaps merged.

One pass over the texts counts, for each document, its terms and how often it holds each term of the queries; that table
is all the later steps read. Document frequencies and lengths are sums over it. A shard is a run of its rows of about
``SHARD_POSTINGS`` postings inside one Spark partition: postings by term with exact integer impacts and each term's
largest impact. A query moves one cursor per term through ascending documents: the pivot is the first document at which
the largest impacts of the cursors up to it add up to more than the threshold, all documents before it are skipped, and
only a pivot that every earlier cursor stands on is scored. The threshold is the worst score of the full heap, taken
over from the task's shards before, or the k-th largest impact of a single term where that is higher. Heaps meet in two
steps, so that no task gets more than its share of an item's rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskweave.llm.common import Shared, discard, materialise, read, text_slices, utf8
from riskweave.llm.decontaminate import words_of

K = 10
SHARD_POSTINGS = 4_000_000
#: Queries beyond this many bytes of text are searched in several groups of items, one pass over the documents each.
MAX_QUERY_BYTES = 8 << 20
#: Texts are split into words by pieces of this many bytes, cut between words.
PIECE = 4 << 20
_GAP = bytes(0 if 0x30 <= x <= 0x39 or 0x41 <= x <= 0x5A or 0x61 <= x <= 0x7A or x >= 0x80 else 1 for x in range(256))


def count_terms(text: bytes) -> Counter:
    """How often each term stands in ``text``; only as many words as a piece has are held at once."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        to = min(len(text), at + PIECE)
        while to < len(text) and not _GAP[text[to]]:
            to += 1
        found.update(words_of(text[at:to]))
        at = to
    return found


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_terms(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """Each document's m; exact beyond 64 bits as well."""
    wide = n.astype(object) if len(n) and int(n.max()) * 90 * n_docs >= 1 << 63 else n
    return (10 + 90 * wide * n_docs // max(total, 1)).astype(np.int64)


class Shard:
    """Postings of one run of documents: ascending documents and impacts of each term, its largest and its k-th largest impact."""

    def __init__(self, n: np.ndarray, first: np.ndarray, terms: np.ndarray, tf: np.ndarray, weights: np.ndarray, n_docs: int, total: int, k: int) -> None:
        """Document d has n[d] words and the postings first[d] up to first[d + 1] of terms and tf."""
        doc = np.repeat(np.arange(len(n)), np.diff(first))
        impact = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * length_terms(n, n_docs, total)[doc]))
        order = np.argsort(terms, kind="stable")
        doc, impact, terms = doc[order], impact[order], terms[order]
        starts = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])[: len(terms)])
        ends = np.append(starts, len(terms))[1:]
        self.lists = {}
        for t, a, b in zip(terms[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
            if weights[t] > 0:
                own = impact[a:b]
                kth = int(np.partition(own, b - a - k)[b - a - k]) if b - a >= k else 0
                self.lists[t] = memoryview(doc[a:b]), memoryview(own), int(own.max()), kth


def wand(shard: Shard, terms, k: int, least: int = 0) -> list[tuple[int, int]]:
    """The k best (score, document) of the shard with a score of ``least`` or more and above 0, best first, equal ones by document."""
    lists = [shard.lists[t] for t in terms if t in shard.lists]
    beat = max([least - 1, 0, *(kth - 1 for *_, kth in lists)])  # a score must be above it
    live = [[docs[0], 0, docs, impacts, top] for docs, impacts, top, _ in lists]
    heap: list[tuple[int, int]] = []
    while live:
        live.sort(key=_document)
        reach, pivot = 0, -1
        for c in live:
            reach += c[4]
            if reach > beat:
                pivot = c[0]
                break
        if pivot < 0:
            break  # what is left cannot get above the threshold
        ended = False
        if live[0][0] == pivot:
            score = 0
            for c in live:
                if c[0] != pivot:
                    break
                at = c[1]
                score += c[3][at]
                c[1] = at = at + 1
                if at < len(c[2]):
                    c[0] = c[2][at]
                else:
                    c[0], ended = -1, True
            if score > beat:
                heapq.heappush(heap, (score, -pivot))
                if len(heap) > k:
                    heapq.heappop(heap)
                if len(heap) == k:
                    beat = max(beat, heap[0][0])
        else:
            for c in live:
                if c[0] >= pivot:
                    break
                c[1] = at = bisect_left(c[2], pivot, c[1])
                if at < len(c[2]):
                    c[0] = c[2][at]
                else:
                    c[0], ended = -1, True
        if ended:
            live = [c for c in live if c[0] >= 0]
    return sorted(((s, -d) for s, d in heap), key=lambda x: (-x[0], x[1]))


def _document(cursor: list) -> int:
    return cursor[0]


def _counter(shared):
    def run(batches):
        vocabulary = shared.value
        for batch in text_slices(batches, 1, 4 << 20):
            raw, starts, ends = utf8(batch.column(1))
            raw = raw.tobytes()
            n, first, terms, tf = [], [0], [], []
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                found = count_terms(raw[a:b])
                n.append(found.total())
                for w in found.keys() & vocabulary.keys():
                    terms.append(vocabulary[w])
                    tf.append(found[w])
                first.append(len(terms))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(terms, pa.int32())), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(tf, pa.int64()))],
                names=["id", "n", "terms", "tf"],
            )

    return run


def _frequencies(size: int):
    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(df[held])], names=["term", "df"])

    return run


def _searcher(shared, k: int, shard_postings: int, item_kind: pa.DataType, id_kind: pa.DataType):
    def run(batches):
        queries, names, weights, n_docs, total = shared.value
        best: dict[int, list] = {}  # of each query, over the shards so far: (score, id), best first

        def search(part):
            table = pa.Table.from_batches(part)
            table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending")])).combine_chunks()
            terms, tf = table["terms"].combine_chunks(), table["tf"].combine_chunks()
            first = np.append(0, np.cumsum(np.asarray(pc.list_value_length(terms)))).astype(np.int64)
            shard = Shard(np.asarray(table["n"]), first, np.asarray(terms.flatten()), np.asarray(tf.flatten()), weights, n_docs, total, k)
            ids = table["id"]
            for q, own in enumerate(queries):
                before = best.get(q, [])
                now = wand(shard, own, k, before[-1][0] if len(before) == k else 0)
                if now:
                    merged = before + [(s, ids[d].as_py()) for s, d in now]
                    best[q] = sorted(merged, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:k]

        part, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part.append(batch.slice(at, 1000))
                held += len(part[-1].column(2).flatten())
                if held >= shard_postings:
                    search(part)
                    part, held = [], 0
        if part:
            search(part)
        rows = [(names[q], s, i) for q, found in best.items() for s, i in found]
        for at in range(0, len(rows), 10_000):
            a, b, c = zip(*rows[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, item_kind), pa.array(b, pa.int64()), pa.array(c, id_kind)], names=["item", "score", "id"])

    return run


def search(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    k: int = K, shard_postings: int = SHARD_POSTINGS, max_query_bytes: int = MAX_QUERY_BYTES,
) -> DataFrame:
    """(item, rank, id, score): each item's ``k`` best documents with a score above 0 (all, if fewer), equal scores by ascending id, null ids last.

    Terms are runs of ASCII digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII in the whole text, however
    long; null or a text of other characters has none, and such a document neither counts nor is found. Document rows that
    share an id are documents of their own; items that share an id are one item with the terms of all; items without an
    id or terms find nothing. Other columns are ignored, whatever their names. Empty tables give no rows. The query terms
    are broadcast only in groups of at most about ``max_query_bytes`` of item text (or one item).
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("t")).where("item is not null and t is not null")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type, item_type = base.schema["id"].dataType, asked.schema["item"].dataType
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    groups = max(1, -(-int(size * 1.5) // max_query_bytes))
    schema = f"item {item_type.simpleString()}, score bigint, id {id_type.simpleString()}"
    out = None
    for g in range(groups):
        part = asked if groups == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(groups)) == g)
        wanted: dict[object, set] = {}
        for r in part.toLocalIterator():
            wanted.setdefault(r["item"], set()).update(count_terms(r["t"].encode()))
        vocabulary = {w: i for i, w in enumerate(sorted(set().union(*wanted.values())))}
        counted = materialise(base.mapInArrow(_counter(Shared(spark, vocabulary)), f"id {id_type.simpleString()}, n bigint, terms array<int>, tf array<bigint>"), "terms")
        n_docs, total = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(vocabulary), np.int64)
        for r in counted.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
            weights[r["term"]] = weight(n_docs, r["df"])
        shared = Shared(spark, ([[vocabulary[w] for w in sorted(own)] for own in wanted.values()], list(wanted), weights, n_docs, total))
        shared.item_type = item_type
        found = counted.mapInArrow(_searcher(shared, k, shard_postings, to_arrow_type(item_type), to_arrow_type(id_type)), schema)
        order = [F.desc("score"), F.asc_nulls_last("id")]
        some = Window.partitionBy("item", "heap").orderBy(*order)
        found = found.withColumn("heap", F.pmod(F.spark_partition_id(), F.lit(64))).withColumn("r", F.row_number().over(some)).where(F.col("r") <= k)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k).select("item", "rank", "id", "score")
        kept = materialise(found, "heaps")  # at most k rows an item
        discard(counted)
        out = kept if out is None else out.unionByName(kept)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), F.col("rank"), F.col("id").alias("doc_id"), "score")
