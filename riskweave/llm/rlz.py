"""Substring dedup (operator 6): relative Lempel-Ziv parsing over words.

Tiles (see ``repeats``) arrive in blocks. A block is factored greedily against every indexed reference block: at
each position the longest match in the reference becomes a factor. A factor of 35 words or more is a duplicate span;
windows that straddle a factor boundary are checked by their own longest match there, so none is missed. The block
is also matched against itself and then becomes a reference block. Words are compared as words, not as hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riskweave.llm.common import read
from riskweave.llm.repeats import Symbols, keyed, repeated_ranges, union_ranges, with_ranges

WINDOW = 35
K = 12
#: Bytes of new tiles that make a block.
BLOCK_BYTES = 3 << 20


class Block:
    """Tiles as word numbers; each tile ends with a number of its own, so no match runs over its end."""

    def __init__(self, text: np.ndarray, at: np.ndarray, size: np.ndarray, tile: int) -> None:
        self.text, self.at, self.size, self.tile = text, at, size, tile
        self.dup = np.zeros(len(text), bool)


def _ranks(s: np.ndarray, window: int) -> list[np.ndarray]:
    """Ranks of the substrings of 1, 2, 4, ... symbols (up to the window): equal ranks, equal substrings."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    out, step = [rank], 1
    while step * 2 <= window:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - step)] = rank[step:]
        key = rank * np.int64(n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.append(0, np.cumsum(k[1:] != k[:-1]))
        out.append(rank)
        step *= 2
    return out


def longest_matches(query: np.ndarray, reference: np.ndarray | None, window: int) -> np.ndarray:
    """For each position of ``query``, the longest match in ``reference`` (or elsewhere in the query itself), up to 2 * window.

    Both are sorted as suffixes of one string; the longest match of a suffix is with its nearest reference suffix
    above or below.
    """
    s = query if reference is None else np.concatenate([query, reference])
    n, own = len(s), len(query)
    ranks = _ranks(s, window)
    top = 1 << (len(ranks) - 1)
    second = np.full(n, -1, np.int64)
    second[: max(0, n - top)] = ranks[-1][top:]
    order = np.argsort(ranks[-1] * np.int64(n + 1) + second + 1, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = np.zeros(len(a), np.int64)
        for level in (len(ranks) - 1, *range(len(ranks) - 1, -1, -1)):
            x, y = a + got, b + got
            ok = (x < n) & (y < n)
            same = ok.copy()
            same[ok] = ranks[level][x[ok]] == ranks[level][y[ok]]
            got += same * (1 << level)
        return got

    is_ref = np.ones(n, bool) if reference is None else order >= own
    index = np.arange(n)
    above = np.maximum.accumulate(np.where(is_ref, index, -1))
    below = np.minimum.accumulate(np.where(is_ref, index, n)[::-1])[::-1]
    if reference is None:  # strictly above and below
        above, below = index - 1, index + 1
    best = np.zeros(own, np.int64)
    spot = place[:own]
    for near in (above[spot], below[spot]):
        ok = np.flatnonzero((near >= 0) & (near < n))
        best[ok] = np.maximum(best[ok], common(ok, order[near[ok]]))
    return best


def factor(best: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors (begin, length) of all tiles at once: each step takes the longest match, or one word, in every tile that goes on."""
    begin, length = [], []
    here, end = at.copy(), at + size
    while True:
        on = here < end
        if not on.any():
            break
        here, end = here[on], end[on]
        step = np.minimum(np.maximum(best[here], 1), end - here)
        begin.append(here)
        length.append(step)
        here = here + step
    if not begin:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(begin), np.concatenate(length)


class RelativeParse:
    def __init__(self, window: int = WINDOW) -> None:
        self.window = window
        self.words: dict[bytes, int] = {}
        self.blocks: list[Block] = []
        self.seen = 0

    def symbols(self, tile: bytes) -> int:
        return tile.count(b" ") + 1

    def add(self, tiles: list[bytes]) -> None:
        ids: list[int] = []
        sizes = []
        words = self.words
        for k, t in enumerate(tiles):
            w = t.split(b" ")
            sizes.append(len(w))
            ids += [words.setdefault(x, len(words)) for x in w]
            ids.append(-1 - self.seen - k)
        size = np.array(sizes, np.int64)
        at = np.cumsum(size + 1) - size - 1
        new = Block(np.array(ids, np.int64), at, size, self.seen)
        self.seen += len(tiles)
        self._mark(new, longest_matches(new.text, None, self.window))
        for old in self.blocks:
            self._mark(new, longest_matches(new.text, old.text, self.window))
            self._mark(old, longest_matches(old.text, new.text, self.window))
        self.blocks.append(new)

    def _mark(self, block: Block, best: np.ndarray) -> None:
        begin, length = factor(best, block.at, block.size)
        long = length >= self.window
        for b, n in zip(begin[long].tolist(), length[long].tolist(), strict=True):
            block.dup[b : b + n - self.window + 1] = True
        # windows over a boundary start less than a window before the end of a factor
        end = begin + length
        reach = np.minimum(length, self.window - 1)
        start = np.repeat(end - np.cumsum(reach), reach) + np.arange(reach.sum())
        block.dup[start[best[start] >= self.window]] = True

    def marked(self):
        for block in self.blocks:
            for a, n in zip(block.at.tolist(), block.size.tolist(), strict=True):
                start = np.flatnonzero(block.dup[a : a + n - self.window + 1])
                yield n, union_ranges(((int(k), int(k) + self.window) for k in start), n)


FORM = Symbols("words", WINDOW, K)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) of every row.

    A word goes when a window of 35 words over it also starts anywhere else, in the same row or another, judged on the
    input. Words are runs of other than ASCII whitespace, unchanged; ``kept`` joins those that stay by one space. A
    null text has none; rows of fewer words lose nothing. Rows whose ids repeat are documents of their own unless
    their texts are alike too: those are one document. An empty table gives none.
    """
    base, unique = keyed(docs, id_col, text_col)
    found = repeated_ranges(base, unique, FORM, RelativeParse, BLOCK_BYTES)
    joined = with_ranges(base, unique, found)
    kind = base.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "kept_sha256", "kept")}
            for own, ranges in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                words = own.encode().split()
                left = words
                if ranges.is_valid:
                    low, high = ranges.values.flatten()
                    left, at = [], 0
                    for a, b in union_ranges(zip(low.to_pylist(), high.to_pylist(), strict=True), len(words)):
                        left += words[at:a]
                        at = b
                    left += words[at:]
                kept = b" ".join(left)
                for name, value in zip(out, (len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode() if text else None), strict=True):
                    out[name].append(value)
            arrays = [batch.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(out["kept"], pa.string())] * text, names=["id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * text)

    return joined.mapInArrow(run, f"id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def brute_force(documents: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The definition, for tests."""
    split = [(i, (t or "").encode().split()) for i, t in documents]
    seen: dict[tuple, int] = {}
    for _, w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
