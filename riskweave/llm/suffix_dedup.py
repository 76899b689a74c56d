"""Suffix-array dedup (operator 4): a logarithmic family of suffix arrays over bytes.

Tiles (see ``repeats``) arrive in batches. Each batch gets a suffix array over its window starts, ordered by 200
bytes; it is merge-scanned against every existing level for windows of 200 equal bytes, and levels of equal size
merge geometrically, so a window is moved a logarithmic number of times. Equal windows keep one entry.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riskweave.llm.common import read
from riskweave.llm.repeats import Symbols, keyed, repeated_ranges, union_ranges, with_ranges

LENGTH = 200
K = 64
#: Bytes of new tiles that make a batch.
BATCH_BYTES = 2 << 20


class SuffixFamily:
    """Levels of suffix arrays over one growing byte string; ``dup`` marks window starts whose window occurs elsewhere."""

    def __init__(self, length: int = LENGTH) -> None:
        self.length = length
        self.text = np.zeros(1 << 16, np.uint8)
        self.used = 0
        self.dup = np.zeros(1 << 16, bool)
        self.at: list[int] = []  # where each tile begins
        self.sizes: list[int] = []
        self.levels: dict[int, np.ndarray] = {}

    def symbols(self, tile: bytes) -> int:
        return len(tile)

    def add(self, tiles: list[bytes]) -> None:
        new = np.frombuffer(b"".join(tiles), np.uint8)
        while self.used + len(new) + 8 > len(self.text):
            self.text = np.append(self.text, np.zeros(len(self.text), np.uint8))
            self.dup = np.append(self.dup, np.zeros(len(self.dup), bool))
        self.text[self.used : self.used + len(new)] = new
        size = np.array([len(t) for t in tiles], np.int64)
        begin = self.used + np.cumsum(size) - size
        self.at += begin.tolist()
        self.sizes += size.tolist()
        self.used += len(new)
        windows = size - self.length + 1
        start = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        batch = self._order(start)
        for level in self.levels.values():
            self._order(np.concatenate([level, batch]))  # merge-scan: marks what batch and level share
        grade = 0
        while grade in self.levels:
            batch = self._order(np.concatenate([self.levels.pop(grade), batch]))
            grade += 1
        self.levels[grade] = batch

    def _chunk(self, at: np.ndarray, k: int) -> np.ndarray:
        """Bytes [8k, 8k + 8) of each window as a number that sorts like them; bytes beyond the window are left out."""
        own = self.text[at[:, None] + np.arange(8 * k, 8 * k + 8)]
        if 8 * k + 8 > self.length:
            own[:, self.length - 8 * k :] = 0
        return own.reshape(-1).view(">u8").astype(np.uint64)

    def _order(self, at: np.ndarray) -> np.ndarray:
        """Window starts by their ``length`` bytes (two sorted runs merge in linear time); equal windows are marked and keep their first entry."""
        key = self._chunk(at, 0)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        fresh = np.append(True, key[1:] != key[:-1]) if len(at) else np.zeros(0, bool)
        for k in range(1, -(-self.length // 8)):
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            place = np.flatnonzero(tied)
            if not len(place):
                return at
            group = np.cumsum(fresh[place])
            key = self._chunk(at[place], k)
            order = np.lexsort((key, group))
            at[place] = at[place][order]
            key = key[order]  # groups are consecutive, so sorting leaves each in its place
            split = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))
            fresh[place] |= split
        same = ~fresh
        if same.any():
            self.dup[at[same]] = True
            self.dup[at[np.flatnonzero(np.append(same[1:], False) & fresh)]] = True
        return at[fresh]

    def marked(self):
        """For each tile, in order of arrival: its number of symbols and the runs of bytes that marked windows cover."""
        for begin, size in zip(self.at, self.sizes, strict=True):
            start = np.flatnonzero(self.dup[begin : begin + size - self.length + 1])
            yield size, union_ranges(((int(a), int(a) + self.length) for a in start), size)


FORM = Symbols("bytes", LENGTH, K)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]) of every row.

    A byte goes when a 200-byte string over it also starts anywhere else, in the same row or another; overlaps count
    and all is judged on the input. A null text is empty; texts under 200 bytes lose nothing. Rows whose ids repeat
    are documents of their own unless their texts are alike too: those are one document. ``kept`` is the text that
    stays, with a character cut in two replaced. An empty table gives none.
    """
    base, unique = keyed(docs, id_col, text_col)
    found = repeated_ranges(base, unique, FORM, SuffixFamily, BATCH_BYTES)
    joined = with_ranges(base, unique, found)
    kind = base.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", spans array<struct<low:bigint,high:bigint>>, kept string" * text
    span = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
            for own, ranges in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = own.encode()
                runs = []
                if ranges.is_valid:
                    low, high = ranges.values.flatten()
                    runs = union_ranges(zip(low.to_pylist(), high.to_pylist(), strict=True), len(raw))
                kept, at = [], 0
                for a, b in runs:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join([*kept, raw[at:]])
                for name, value in zip(out, (len(raw), len(raw) - len(left), len(runs), hashlib.sha256(left).hexdigest(), [{"low": a, "high": b} for a, b in runs], left.decode(errors="replace") if text else None), strict=True):
                    out[name].append(value)
            arrays = [batch.column(0), *(pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if text:
                arrays += [pa.array(out["spans"], span), pa.array(out["kept"], pa.string())]
                names += ["spans", "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def brute_force(documents: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The definition, for tests."""
    raw = [(i, (t or "").encode()) for i, t in documents]
    seen: dict[bytes, int] = {}
    for _, b in raw:
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for i, b in raw:
        runs = union_ranges(((k, k + length) for k in range(len(b) - length + 1) if seen[b[k : k + length]] > 1), len(b))
        kept, at = b"", 0
        for low, high in runs:
            kept, at = kept + b[at:low], high
        kept += b[at:]
        out.append((i, len(b), len(b) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
    return out
