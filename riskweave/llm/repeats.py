"""Windows that occur more than once, found over all documents without comparing documents with each other.

Shared by the two substring operators. A text is a string of symbols (bytes or words). Every window of ``length``
symbols picks the anchor that its own content fixes: the leftmost smallest hash among its k-grams. Equal windows
pick the same anchor at the same offset, so they meet where the k-gram's hash sends them. The windows that pick one
anchor are consecutive; together they are a tile. Steps, each a stream over a sorted or hashed partition:

1. anchors of all documents (key, row, tile), no text;
2. keys that occur once cannot repeat and go: each anchor is compared with its neighbours in key order;
3. the remaining tiles fetch their text from the documents and meet again by key;
4. matchers (suffix-array indexes or relative Lempel-Ziv parses), each over a run of keys, mark the windows that occur
   elsewhere; a tile whose text came before is answered at once, so a large group of copies is never held;
5. the marked ranges go back to their documents.

No candidate is dropped: a hash decides only where windows meet, the matcher compares symbols.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import Powers, mix, prefix_hash, space_words, span_hash, text_slices, utf8

#: Low bits that hold a k-gram's place while hashes are compared: texts of up to 2**28 symbols.
_PLACE_BITS = 28


@dataclass(frozen=True)
class Symbols:
    """What a symbol is, how long windows are, and the k of the anchors' k-grams (offsets in a tile must fit 8 bits)."""

    kind: str  # "bytes" or "words"
    length: int
    k: int

    def read(self, raw, starts, ends, powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """64-bit values of all symbols, and where each row's symbols start and end."""
        if self.kind == "bytes":
            return raw.astype(np.uint64) + np.uint64(1), starts, ends
        h, _, _, first = space_words(raw, starts, ends, lower=False, powers=powers)
        return h, first[:-1], first[1:]

    def cut(self, text: bytes) -> Callable[[int, int], bytes]:
        """A function that gives symbols [a, b) of ``text`` (words joined by one space)."""
        if self.kind == "bytes":
            return lambda a, b: text[a:b]
        words = text.split()
        return lambda a, b: b" ".join(words[a:b])


def tiles(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, form: Symbols, powers: Powers):
    """Row number, first and last window start, anchor (all relative to the row) and key of each tile."""
    n, length, k = len(values), form.length, form.k
    none = [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    if n < length:
        return none
    prefix = prefix_hash(values, powers)
    at = np.arange(n - k + 1)
    key = span_hash(prefix, at, at + k, powers)
    shift = np.uint64(_PLACE_BITS)
    order = (mix(key) >> shift << shift) | at.astype(np.uint64)
    width, reach = 1, length - k + 1
    low = order
    while width * 2 <= reach:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    if reach > width:
        low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    ok = np.zeros(n + 1, np.int32)
    long = ends - starts >= length
    np.add.at(ok, starts[long], 1)
    np.add.at(ok, ends[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(ok)[: len(low)] > 0)
    if not len(window):
        return none
    anchor = (low[window] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    fresh = np.ones(len(window), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    head = np.flatnonzero(fresh)
    first, last, anchor = window[head], window[np.append(head[1:], len(window)) - 1], anchor[head]
    filled = np.flatnonzero(ends > starts)
    row = filled[np.searchsorted(starts[filled], first, "right") - 1]
    return row, first - starts[row], last - starts[row], anchor - starts[row], key[anchor]


def row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, bool]:
    """A 64-bit key of rows, and whether it never repeats: the id where ids are whole numbers, unique and not null; else a hash of id and text, so rows with both alike are one document."""
    own = F.col(f"`{id_col}`")
    whole = docs.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte")
    if whole and docs.select(own.alias("id")).groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return own.cast("bigint"), True
    return F.xxhash64(F.coalesce(own.cast("string"), F.lit("\x00")), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), False


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(id, text, rid) with the row key as rid and null texts empty, and whether no rid repeats."""
    key, unique = row_key(docs, id_col, text_col)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), key.alias("rid")), unique


def by_row(base: DataFrame) -> DataFrame:
    """(rid, text) of rows with unique keys: one and the same plan wherever rows are joined, so that texts are shuffled once."""
    return base.select("rid", "text").where("rid is not null")


def with_ranges(base: DataFrame, unique: bool, found: DataFrame) -> DataFrame:
    """(id, text, ranges) of every row."""
    if not unique:
        return base.join(found, "rid", "left").select("id", "text", "ranges")
    kind = base.schema["id"].dataType  # unique keys are the ids themselves
    return by_row(base).join(found, "rid", "left").select(F.col("rid").cast(kind).alias("id"), "text", "ranges")


def _anchors(form: Symbols):
    def run(batches):
        powers = Powers()
        for batch in text_slices(batches, 1, 1 << 20):
            rid = batch.column(0).to_numpy()
            raw, starts, ends = utf8(batch.column(1))
            values, starts, ends = form.read(raw, starts, ends, powers)
            row, first, last, anchor, key = tiles(values, starts, ends, form, powers)
            pack = (first << 16) | ((last - first) << 8) | (anchor - first)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rid[row]), pa.array(pack)], names=["key", "rid", "pack"])

    return run


def _shared(batches):
    """Rows of a key-sorted stream whose key another row has; one batch's last row waits for the next batch."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = table.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.append(same, False)
        keep[1:] |= same
        known = held is not None and held_paired
        keep[0] |= known
        n = len(key)
        held_paired = bool(same[-1]) if len(same) else known
        held = table.slice(n - 1, 1)
        yield table.slice(0, n - 1).filter(pa.array(keep[:-1]))
    if held is not None and held_paired:
        yield held


def _fetch(form: Symbols):
    def run(batches):
        for batch in batches:
            out = {"key": [], "rid": [], "first": [], "tile": []}
            size = 0
            for rid, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                cut = form.cut(text.encode())
                own = found.values.flatten() if hasattr(found.values, "flatten") else None
                for key, pack in zip(own[0].to_pylist(), own[1].to_pylist(), strict=True):
                    first, more = pack >> 16, (pack >> 8) & 255
                    tile = cut(first, first + more + form.length)
                    out["key"].append(key)
                    out["rid"].append(rid)
                    out["first"].append(first)
                    out["tile"].append(tile)
                    size += len(tile)
                if size > 4 << 20:
                    yield _tiles_batch(out)
                    out, size = {k: [] for k in out}, 0
            if out["key"]:
                yield _tiles_batch(out)

    return run


def _tiles_batch(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["rid"], pa.int64()), pa.array(out["first"], pa.int64()), pa.array(out["tile"], pa.binary())], names=list(out))


def _match(make: Callable[[], object], batch_symbols: int):
    """Streams a partition's tiles, sorted by key, through matchers and yields marked symbol ranges (rid, low, high).

    Equal windows have one key, so a matcher that holds ``batch_symbols`` ends with its key: tiles of other keys cannot match.
    """

    def run(batches):
        group = _Group(make())
        last = None
        for batch in batches:
            rids, lows, highs = [], [], []
            for key, rid, first, tile in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if key != last:
                    if group.held >= batch_symbols:
                        yield from group.ranges()
                        group = _Group(make())
                    last = key
                if group.repeated(tile, rid, first):
                    rids.append(rid)
                    lows.append(first)
                    highs.append(first + group.matcher.symbols(tile))
                elif group.size >= batch_symbols:
                    group.add()
            if rids:
                yield _ranges(rids, lows, highs)
        yield from group.ranges()

    return run


class _Group:
    """The distinct tiles of some keys, each once, and their matcher."""

    def __init__(self, matcher) -> None:
        self.matcher = matcher
        self.number: dict[bytes, int] = {}
        self.owner: list[tuple[int, int]] = []  # row and first window of each distinct tile
        self.again: list[bool] = []
        self.waiting: list[bytes] = []
        self.size = self.held = 0

    def repeated(self, tile: bytes, rid: int, first: int) -> bool:
        """Whether the tile came before; a new one waits for the matcher."""
        k = self.number.get(tile)
        if k is not None:
            self.again[k] = True
            return True
        self.number[tile] = len(self.owner)
        self.owner.append((rid, first))
        self.again.append(False)
        self.waiting.append(tile)
        self.size += len(tile)
        self.held += len(tile)
        return False

    def add(self) -> None:
        if self.waiting:
            self.matcher.add(self.waiting)
        self.waiting, self.size = [], 0

    def ranges(self):
        """Marked ranges of the first row of each distinct tile."""
        self.add()
        self.number.clear()
        rids, lows, highs = [], [], []
        for k, marked in enumerate(self.matcher.marked()):
            rid, first = self.owner[k]
            for low, high in [(0, marked[0])] if self.again[k] else marked[1]:
                rids.append(rid)
                lows.append(first + low)
                highs.append(first + high)
            if len(rids) > 50_000:
                yield _ranges(rids, lows, highs)
                rids, lows, highs = [], [], []
        yield _ranges(rids, lows, highs)


def _ranges(rids, lows, highs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["rid", "low", "high"])


def repeated_ranges(base: DataFrame, unique: bool, form: Symbols, make: Callable[[], object], batch_symbols: int) -> DataFrame:
    """(rid, ranges): per document the symbol ranges covered by windows that also start elsewhere; documents without any are absent. ``base`` and ``unique`` are what ``keyed`` returns."""
    text = by_row(base) if unique else base.select("rid", "text").distinct()
    anchors = text.mapInArrow(_anchors(form), "key bigint, rid bigint, pack bigint")
    shared = anchors.repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key bigint, rid bigint, pack bigint")
    wanted = shared.groupBy("rid").agg(F.collect_list(F.struct("key", "pack")).alias("found"))  # bounded by the document
    meeting = text.join(wanted, "rid").mapInArrow(_fetch(form), "key bigint, rid bigint, first bigint, tile binary").repartition("key").sortWithinPartitions("key")
    marked = meeting.mapInArrow(_match(make, batch_symbols), "rid bigint, low bigint, high bigint")
    return marked.groupBy("rid").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def union_ranges(ranges, limit: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of (low, high) pairs."""
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], min(high, limit))
        else:
            out.append([low, min(high, limit)])
    return [(a, b) for a, b in out]
