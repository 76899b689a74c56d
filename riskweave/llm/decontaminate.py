"""Benchmark decontamination (operator 3): an FM-index per training shard, searched backwards for benchmark windows.

A shard is a run of whole documents of about ``SHARD_WORDS`` words inside one Spark partition. Words that occur in
no benchmark item cannot be part of an occurrence, so the indexed string holds the maximal runs of benchmark words
(runs shorter than the shortest window cannot hold one either), split by a separator. All windows are searched at
once, backwards, with ranks from a wavelet matrix; occurrences are located by stepping to sampled suffix positions
and merged into removal spans. Documents never leave their partition: there is no shuffle.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import Shared, read, text_slices, utf8

WINDOW = 10
SHARD_WORDS = 1_500_000
#: Benchmarks beyond this many bytes are searched in several groups of items, one pass of the documents each.
MAX_BENCHMARK_BYTES = 32 << 20
SAMPLE_RATE = 8

_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((x + 32 if 0x41 <= x <= 0x5A else x) if (x in _KEPT or 0x41 <= x <= 0x5A) else 0x20 for x in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of digits, letters a-z and bytes of non-ASCII characters."""
    return text.translate(_FOLD).split()


class FMIndex:
    """FM-index of an integer string (symbols >= 1; 0 ends it), with wavelet-matrix ranks and sampled suffix positions."""

    def __init__(self, text: np.ndarray, rate: int = SAMPLE_RATE) -> None:
        s = np.append(text, 0).astype(np.int64)
        sa = suffix_array(s)
        self.n = len(s)
        bwt = s[sa - 1]
        self.sigma = int(s.max()) + 1
        self.first = np.append(0, np.cumsum(np.bincount(s, minlength=self.sigma)))
        self.depth = max(1, int(self.sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        x = bwt
        for level in range(self.depth - 1, -1, -1):
            bit = (x >> level) & 1
            self.ones.append(np.append(0, np.cumsum(bit)).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])
        symbols = np.arange(self.sigma)
        self.base = self._down(symbols, np.zeros(self.sigma, np.int64))
        kept = sa % rate == 0
        self.sampled = kept
        self.sample_rank = np.append(0, np.cumsum(kept))
        self.samples = sa[kept]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, ones in enumerate(self.ones):
            up = ones[at]
            at = np.where((symbol >> (self.depth - 1 - k)) & 1 == 1, self.zeros[k] + up, at - up)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at`` of the transform."""
        return self._down(symbol, at) - self.base[symbol]

    def symbol_at(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k, ones in enumerate(self.ones):
            bit = ones[at + 1] - ones[at]
            out = out * 2 + bit
            at = np.where(bit == 1, self.zeros[k] + ones[at], at - ones[at])
        return out

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns (rows): the suffix interval [low, high) of each."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.flatnonzero((patterns < self.sigma).all(axis=1))
        high[np.setdiff1d(np.arange(len(patterns)), alive)] = 0
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            low[alive] = self.first[c] + self.rank(c, low[alive])
            high[alive] = self.first[c] + self.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, by LF steps to the nearest sampled one."""
        at, steps, out = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            hit = self.sampled[at[todo]]
            done = todo[hit]
            out[done] = self.samples[self.sample_rank[at[done]]] + steps[done]
            todo = todo[~hit]
            if len(todo):
                c = self.symbol_at(at[todo])
                at[todo] = self.first[c] + self.rank(c, at[todo])
                steps[todo] += 1
        return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``s`` ends with a unique smallest symbol."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.zeros(n, np.int64)
        fresh[order] = np.append(0, np.cumsum(sorted_key[1:] != sorted_key[:-1]))
        rank = fresh
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class Windows:
    """The windows of a group of benchmark items: vocabulary, patterns by length, and which items each window stands for."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = words_of((text or "").encode())
            for k in range(len(w) - window + 1) if len(w) >= window else range(1 if w else 0):
                found.setdefault(tuple(w[k : k + window]), set()).add(item)
        self.ids: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        by_length: dict[int, list[list[int]]] = {}
        order: dict[int, list[int]] = {}
        for key, own in found.items():
            order.setdefault(len(key), []).append(len(self.items))
            self.items.append(sorted(own))
            by_length.setdefault(len(key), []).append([self.ids.setdefault(x, len(self.ids) + 2) for x in key])
        self.patterns = {k: (np.array(v, np.int64), np.array(order[k])) for k, v in by_length.items()}
        self.shortest = min(by_length, default=0)


def _shard(windows: Windows, counts: list[int], ids: list[int]) -> tuple[np.ndarray, list[dict[int, int]], list[set[str]]]:
    """n_hit, merged spans and items of each document of a shard; ``ids`` are its words' ids, 0 for words of no item."""
    docs = len(counts)
    start = np.append(0, np.cumsum(counts)).astype(np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
    items: list[set[str]] = [set() for _ in range(docs)]
    hits = np.zeros(docs, np.int64)
    x = np.array(ids, np.int64)
    total = len(x)
    if not total or not windows.patterns:
        return hits, spans, items
    known = x > 0
    known_from = known.copy()
    cut = np.zeros(total + 1, bool)
    cut[start] = True
    known_from[1:] &= ~known[:-1] | cut[1:-1]
    opens = np.flatnonzero(known_from)
    known_to = known.copy()
    known_to[:-1] &= ~known[1:] | cut[1:-1]
    closes = np.flatnonzero(known_to) + 1
    long = closes - opens >= windows.shortest
    opens, closes = opens[long], closes[long]
    if not len(opens):
        return hits, spans, items
    length = closes - opens + 1  # one separator after each run
    at = np.append(0, np.cumsum(length))
    where = np.arange(at[-1]) - np.repeat(at[:-1], length) + np.repeat(opens, length)
    text = x[np.minimum(where, total - 1)]
    text[at[1:] - 1] = 1
    index = FMIndex(text)
    delta = np.zeros(total + 1, np.int64)
    for size, (patterns, numbers) in windows.patterns.items():
        low, high = index.search(patterns)
        many = high - low
        if not many.any():
            continue
        rows = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        place = where[index.locate(rows)]
        number = np.repeat(numbers, many)
        np.add.at(delta, place, 1)
        np.add.at(delta, place + size, -1)
        doc = np.searchsorted(start, place, "right") - 1
        for d, k in np.unique(np.stack([doc, number], 1), axis=0):
            items[d].update(windows.items[k])
    hit = np.cumsum(delta[:-1]) > 0
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    first = np.flatnonzero(edge == 1)
    last = np.flatnonzero(edge == -1)
    doc = np.searchsorted(start, first, "right") - 1
    for d, a, b in zip(doc.tolist(), first.tolist(), last.tolist(), strict=True):
        while b > start[d + 1]:  # spans of neighbouring documents may touch
            if start[d + 1] > a:  # a document without words has no span
                spans[d].append((a - int(start[d]), int(start[d + 1] - start[d])))
                hits[d] += start[d + 1] - a
            d, a = d + 1, int(start[d + 1])
        spans[d].append((a - int(start[d]), b - int(start[d])))
        hits[d] += b - a
    return hits, spans, items


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _searcher(shared, shard_words: int, text: str = "no"):
    """text: "no", "whole" or "clean" (without the spans found)."""
    keep = text != "no"

    def run(batches):
        windows: Windows = shared.value
        get = windows.ids.get
        ids_out: list = []
        texts: list = []
        counts: list[int] = []
        ids: list[int] = []

        def flush():
            hits, spans, items = _shard(windows, counts, ids)
            spans = [[{"start": a, "end": b} for a, b in s] for s in spans]
            out = {"id": pa.concat_arrays(ids_out), "n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(hits, pa.int64())}
            out |= {"spans": pa.array(spans, pa.list_(_SPAN)), "items": pa.array([sorted(s) for s in items], pa.list_(pa.string()))}
            if keep:
                own = pa.concat_arrays(texts)
                out["text"] = own if text == "whole" or not hits.any() else pa.array([cut_words(t, s) for t, s in zip(own.to_pylist(), spans, strict=True)], pa.string())
            return pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

        for batch in text_slices(batches, 1, 4 << 20):
            raw, starts, ends = utf8(batch.column(1))
            raw = raw.tobytes()
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                w = words_of(raw[a:b])
                counts.append(len(w))
                ids.extend([get(x, 0) for x in w])
            ids_out.append(batch.column(0))
            if keep:
                texts.append(batch.column(1).cast(pa.string()))
            if len(ids) >= shard_words:
                yield flush()
                ids_out, texts, counts, ids = [], [], [], []
        if counts:
            yield flush()

    return run


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shard_words: int = SHARD_WORDS, text: str = "no", max_benchmark_bytes: int = MAX_BENCHMARK_BYTES,
) -> DataFrame:
    """(id, n_words, n_hit, spans, items[, text]) for every row of ``docs``; spans are maximal runs [start, end) of hit words.

    text: "no", "whole" or "clean" (the text without its hit words) adds that column.

    A window is ``window`` consecutive item words; an item with fewer, but not none, is one window; an item or document
    with null or no words has none. Repeated document rows are judged each for itself; items that share an id count once.
    An empty benchmark hits nothing. Other columns are ignored, whatever their names. The benchmark is broadcast only
    in groups of at most ``max_benchmark_bytes`` of text (or one item): a larger one is searched in several passes over
    the documents, whose findings are united by document row.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("t")).where("item is not null and t is not null")
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    groups = max(1, -(-int(size * 1.5) // max_benchmark_bytes))
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
    carried = text if groups == 1 else "whole"
    wide = schema + ", text string" * (carried != "no")
    out = None
    for g in range(groups):
        part = bench if groups == 1 else bench.where(F.pmod(F.xxhash64("item", "t"), F.lit(groups)) == g)
        shared = Shared(spark, Windows([(r["item"], r["t"]) for r in part.toLocalIterator()], window))
        if out is None:
            out = base.mapInArrow(_searcher(shared, shard_words, carried), wide)
        else:  # keep the earlier passes' findings beside each row
            out = _unite(out, shared, shard_words, wide, clean=text == "clean" and g == groups - 1)
    return out.drop("text") if text == "no" and groups > 1 else out


def _unite(before: DataFrame, shared, shard_words: int, schema: str, clean: bool) -> DataFrame:
    run = _searcher(shared, shard_words)

    def both(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            now = pa.Table.from_batches(list(run(iter([pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text")], names=["id", "text"])]))))
            spans, hits, items = [], [], []
            for a, b, i, j in zip(table["spans"].to_pylist(), now["spans"].to_pylist(), table["items"].to_pylist(), now["items"].to_pylist(), strict=True):
                merged: list[dict] = []
                for s in sorted(a + b, key=lambda s: s["start"]):
                    if merged and s["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(dict(s))
                spans.append(merged)
                hits.append(sum(s["end"] - s["start"] for s in merged))
                items.append(sorted(set(i) | set(j)))
            own = pa.array([cut_words(t, s) for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)], pa.string()) if clean else batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array(spans, pa.list_(_SPAN)), pa.array(items, pa.list_(pa.string())), own],
                names=["id", "n_words", "n_hit", "spans", "items", "text"],
            )

    return before.mapInArrow(both, schema)


def cut_words(text: str | None, spans) -> str | None:
    """``text`` without the words of ``spans`` and what stands between them."""
    if text is None or spans is None or not len(spans):
        return text
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    out, done = [], 0
    for s in spans:
        out.append(raw[done : at[s["start"]][0]])
        done = at[s["end"] - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every hit word span cut out of the text; all rows and columns stay (``n_chars`` is renewed where there is one)."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)], F.col(f"`{text_col}`").isNull().alias("none"))
    found = find_contamination(docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("t")), benchmark, id_col="row", text_col="t", text="clean", **options)
    clean = F.when(~F.col("id.none"), F.coalesce("text", F.lit("")))
    value = {c: F.col(f"id.c{k}") for k, c in enumerate(others)} | {text_col: clean}
    if "n_chars" in value:
        value["n_chars"] = F.when(F.col("n_hit") > 0, F.length(clean).cast("bigint")).otherwise(value["n_chars"])
    return found.select(*[value[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(documents: list[tuple[int, str | None]], items: list[tuple[object, str | None]], window: int = WINDOW) -> list[tuple]:
    """The definition, for tests: (doc_id, n_words, n_hit, n_items, items_sha256)."""
    wins = []
    for item, text in items:
        w = words_of((text or "").encode())
        wins += [(str(item), w[k : k + window]) for k in (range(len(w) - window + 1) if len(w) >= window else range(1 if w else 0))]
    out = []
    for doc, text in documents:
        w = words_of((text or "").encode())
        hit, own = set(), set()
        for item, x in wins:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    own.add(item)
        out.append((doc, len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()))
    return out
