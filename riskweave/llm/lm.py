"""LM scoring (operator 10): a weighted backoff automaton over words.

Tokens are words of a text plus one end. Every token's training count is gathered (its base model is additive
smoothing over those counts), and every n-gram of up to ``ORDER`` tokens (three; two can be asked for) that occurs at
least ``LEAST`` times. n-grams are the arcs of an automaton: a state is a history that some arc leaves, an arc carries its absolutely discounted log10
probability, and each state has a failure arc to its longest proper suffix with the backoff weight that makes its
distribution sum to one; at the root the base model answers.

The automaton grows with the corpus and is a distributed table of key ranges (keys, counts, backoff weights); nothing of it is broadcast or collected.
Documents are cut into blocks of tokens, which are numbered and packed once, so that no later step reads a text again. A
block asks for the keys of its distinct tokens and pairs, sorted and packed by key range; each range of the table answers
with counts and backoff weights in the order asked. n-grams are counted the same way: blocks send their distinct keys and
are told their counts, and one block of those that sent a key names it. A triple occurs no oftener than its two pairs, so
triples are counted and asked for in a second step, where both pairs are arcs. The block that names an n-gram knows the
counts of its history and suffix; a history's sums over its arcs, whole numbers, meet at the history's own key.
A token's state is its longest history with an arc, so all tokens of a block are traversed at once: those that find no
arc pay the backoff weight and follow the failure arc.
"""

from __future__ import annotations

import gc
import math
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import Powers, crc_fold, discard, materialise, mix, read, space_words, text_slices, utf8

#: n-grams that occur less often are no arcs.
LEAST = 2
#: Tokens of the longest n-grams, 2 or 3.
ORDER = 3
DISCOUNT = 0.5
ALPHA = 0.1
BLOCK_BYTES = 12 << 20
#: Blocks are scored in so many rounds, so that the requests and answers of one round only are on disk.
ROUNDS = 2
#: Hashes of the end token and of the start state, which no word's hash equals but by chance of 2**-64.
END = np.int64(0x5E0D_E0D5_1A7B_33C1)
START = np.int64(0x1157_A127_0CAB_77E9)
_BITS = 32


def tokens(raw, starts, ends, powers) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by END, and each row's first token (n + 1 numbers)."""
    h, _, _, first = space_words(raw, starts, ends, lower=True, powers=powers)
    at = first[1:]
    out = np.insert(h.view(np.int64), at, END)
    return out, first + np.arange(len(first))


def _joined(hist: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Key of the n-gram whose tokens but the last have the key ``hist`` and whose tokens but the first ``low``."""
    return mix(hist.view(np.uint64) * np.uint64(0xA24BAED4963EE407) + mix(low.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))).view(np.int64)


# --- blocks of tokens -----------------------------------------------------------------------------


_BLOCK = "block bigint, size bigint, lengths binary, words binary, places binary"


def _blocked(block_bytes: int, column: int, ids: bool = False):
    """Packed blocks of about ``block_bytes`` of text: how many tokens each row has, the distinct tokens, and which of them stands where, START before each row; with ``ids``, column 0 too."""

    def block(number: int, size: int, h: list, lengths: list, names: list) -> pa.RecordBatch:
        length = np.concatenate(lengths)
        one = np.insert(np.concatenate(h), np.cumsum(length) - length, START)
        coded = pa.array(one.view(np.uint64)).dictionary_encode()  # several times as fast as a sort where few are distinct
        words = coded.dictionary.to_numpy()
        order = np.argsort(words)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words, places = words[order], rank[coded.indices.to_numpy()]
        out = {"block": pa.array([number]), "size": pa.array([size]), "lengths": _binary(_planes(length)), "words": _binary(_pack(words, 0, 1)), "places": _binary(_planes(places, 4))}
        if ids:
            at = np.array([0, len(length)], np.int32)
            out["ids"] = pa.ListArray.from_arrays(pa.array(at), pa.concat_arrays(names))
        return pa.RecordBatch.from_pydict(out)

    def run(batches):
        powers, number, size, held = Powers(), TaskContext.get().partitionId() << 32, 0, ([], [], [])
        for part in text_slices(batches, column, min(block_bytes, 1 << 18)):
            raw, starts, ends = utf8(part.column(column))
            h, first = tokens(raw, starts, ends, powers)
            for to, x in zip(held, (h, np.diff(first), part.column(0)), strict=True):
                to.append(x)
            size += int((ends - starts).sum())
            if size >= block_bytes:
                yield block(number, size, *held)
                number, size, held = number + 1, 0, ([], [], [])
        if held[0]:
            yield block(number, size, *held)

    return run


def _binary(x: bytes) -> pa.Array:
    return pa.array([x], pa.binary())


class _Block:
    """The tokens of a packed block: ``words`` has the distinct ones, ``at`` says which stands where, START before each row."""

    def __init__(self, row) -> None:
        self.number = row["block"][0].as_py()
        self.words = _unpack(row["words"][0].as_py(), 0, 1)
        self.lengths = _from_planes(row["lengths"][0].as_py())
        self.at = _from_planes(row["places"][0].as_py(), 4).astype(np.int64)
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1
        self.is_two = np.ones(len(self.at), bool)
        self.is_two[self.starts] = False
        self.is_three = self.is_two & np.roll(self.is_two, 1)
        one = self.words[self.at].view(np.int64)
        self.two = np.zeros_like(one)
        self.two[1:] = _joined(one[:-1], one[1:])

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs' sorted keys, and of each place which one ends there (0 where none does)."""
        key, which = _ranked(self.two[self.is_two].view(np.uint64))
        at = np.zeros(len(self.at), np.int64)
        at[self.is_two] = which
        return key, at

    def triples(self, arc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where a triple of two pairs that are arcs ends (``arc``: of each place, whether the pair that ends there is one), and the triples' keys."""
        place = np.flatnonzero(self.is_three & arc & np.roll(arc, 1))
        return place, _joined(self.two[place - 1], self.two[place]).view(np.uint64)


def _each(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield _Block(pa.Table.from_batches([batch.slice(k, 1)]))


def _vocabulary(batches):
    """Partial counts of the tokens of each block."""
    for block in _each(batches):
        n = np.bincount(block.at, minlength=len(block.words))
        real = block.words.view(np.int64) != START
        yield pa.RecordBatch.from_arrays([pa.array(block.words.view(np.int64)[real]), pa.array(n[real])], names=["token", "n"])


# --- counting ---------------------------------------------------------------------------------------


def _sent(block: int, n: int, key: np.ndarray, times: np.ndarray | None, parts: int) -> pa.Table:
    """One request to each key range about sorted distinct keys of ``n`` tokens, and how often each occurs in the block."""
    part, at = np.unique(_part_of(key, parts), return_index=True)
    requests = [_pack(x, p, parts) for x, p in zip(np.split(key, at[1:]), part.tolist(), strict=True)] if len(key) else []
    out = {"block": pa.array(np.full(len(part), block, np.int64)), "n": pa.array(np.full(len(part), n, np.int32)), "part": pa.array(part, pa.int32()), "request": pa.array(requests, pa.binary())}
    if times is not None:
        out["times"] = pa.array([_planes(x) for x in np.split(times, at[1:])] if len(key) else [], pa.binary())
    return pa.table(out)


def _census(parts: int):
    """Requests about a block's tokens and pairs."""

    def run(batches):
        for block in _each(batches):
            yield from _sent(block.number, 1, block.words, np.bincount(block.at, minlength=len(block.words)), parts).to_batches()
            yield from _sent(block.number, 2, *np.unique(block.two[block.is_two].view(np.uint64), return_counts=True), parts).to_batches()

    return run


def _census_long(parts: int, least: int):
    """Requests about a block's triples of two pairs that are arcs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left)
        key, at = block.pairs()
        total, _ = _told(key, 2, parts, right)
        _, triple = block.triples(block.is_two & (total >= least)[at])
        return _sent(block.number, 3, *np.unique(triple, return_counts=True), parts)

    return run


def _summed(parts: int):
    """Answers each block that sent a key with twice the key's whole count; one of the blocks, which shall name the key, with one more."""

    def run(table: pa.Table) -> pa.Table:
        part = table["part"].to_pylist()
        keys = [_unpack(r.as_py(), p, parts) for r, p in zip(table["request"], part, strict=True)]
        times = np.concatenate([_from_planes(x.as_py()) for x in table["times"]])
        key = np.concatenate(keys)
        order = _order(key)
        key = key[order]
        fresh = np.append(True, key[1:] != key[:-1])
        total = np.add.reduceat(times[order], np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        reply = np.zeros(len(key), np.int64)
        reply[order] = 2 * total + fresh
        replies = [_planes(x) for x in np.split(reply, np.cumsum([len(k) for k in keys])[:-1])]
        return pa.table({"block": table["block"], "n": table["n"], "part": table["part"], "reply": pa.array(replies, pa.binary())})

    return run


def _told(key: np.ndarray, n: int, parts: int, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Whole counts of a block's sorted distinct keys of ``n`` tokens, and which of them the block shall name."""
    reply = np.zeros(len(key), np.int64)
    for (a, b), packed in _places(key, parts, replies, n):
        reply[a:b] = _from_planes(packed)
    return reply >> 1, (reply & 1).astype(bool)


def _named(block: _Block, parts: int, least: int, order: int, replies: pa.Table):
    """Of each order: n, the keys that a block shall name and their counts; then, but for tokens, keys of their histories and suffixes, and counts of the suffix and of the history's last token."""
    count, own = _told(block.words, 1, parts, replies)
    yield 1, block.words[own], count[own]
    if order < 2:
        return
    key, at = block.pairs()
    total, own = _told(key, 2, parts, replies)
    own &= total >= least
    place = np.zeros(len(key), np.int64)
    place[at[block.is_two]] = np.flatnonzero(block.is_two)
    place = place[own]
    yield 2, key[own], total[own], block.words[block.at[place - 1]], block.words[block.at[place]], count[block.at[place]], count[block.at[place - 1]]
    if order > 2:
        where, triple = block.triples(block.is_two & (total >= least)[at])
        long, which = _ranked(triple)
        n, own = _told(long, 3, parts, replies)
        own &= n >= least
        place = np.zeros(len(long), np.int64)
        place[which] = where
        place = place[own]
        yield 3, long[own], n[own], key[at[place - 1]], key[at[place]], total[at[place]], count[block.at[place - 1]]


def _kept(parts: int, least: int, order: int):
    """The n-grams that a block shall name."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("n", "key", "hist", "low", "c")}
        for n, key, count, *rest in _named(_Block(left), parts, least, order, right):
            if n > 1:
                for name, x in zip(out, (np.full(len(key), n, np.int32), key.view(np.int64), rest[0].view(np.int64), rest[1].view(np.int64), count), strict=True):
                    out[name].append(x)
        return pa.table({k: pa.array(np.concatenate(v)) for k, v in out.items()})

    return run


class _Census:
    """The packed blocks of a corpus and the whole counts of their n-grams, which two tables hold."""

    def __init__(self, texts: DataFrame, least: int, block_bytes: int, order: int) -> None:
        text = texts.select(F.col(texts.columns[0]).cast("string").alias("text"))
        self.least, self.order = least, order
        self.blocks = materialise(text.mapInArrow(_blocked(block_bytes, 0), _BLOCK), "blocks")
        self.parts = max(1, -(-(self.blocks.agg(F.sum("size")).first()[0] or 0) // block_bytes))
        self.tables = [self.blocks]

    def tokens(self) -> DataFrame:
        """(token, c)."""
        return self.blocks.mapInArrow(_vocabulary, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("c"))

    def told(self) -> DataFrame:
        """(block, n, part, reply) of all orders."""
        parts = self.parts
        sent_as, told_as = "block bigint, n int, part int, request binary, times binary", "block bigint, n int, part int, reply binary"
        replies = materialise(self._by(self.blocks.mapInArrow(_census(parts), sent_as), "part").applyInArrow(_summed(parts), told_as), "replies")
        self.tables.append(replies)
        if self.order < 3:
            return replies
        sent = self.with_replies(replies).applyInArrow(_census_long(parts, self.least), sent_as)
        self.tables.append(materialise(self._by(sent, "part").applyInArrow(_summed(parts), told_as), "replies"))
        return replies.unionByName(self.tables[-1])

    def _by(self, rows: DataFrame, key: str):
        return rows.repartition(self.parts, key).groupBy(key)

    def with_replies(self, replies: DataFrame):
        return self._by(self.blocks, "block").cogroup(self._by(replies, "block"))

    def grams(self, told: DataFrame) -> DataFrame:
        return self.with_replies(told).applyInArrow(_kept(self.parts, self.least, self.order), "n int, key bigint, hist bigint, low bigint, c bigint")

    def discard(self) -> None:
        for table in self.tables:
            discard(table)


def gram_counts(texts: DataFrame, least: int, block_bytes: int = BLOCK_BYTES, order: int = ORDER) -> DataFrame:
    """(n, key, hist, low, c) of the pairs (n = 2) and, of order 3, triples that occur at least ``least`` times; hist and low are the keys of all tokens but the last and but the first."""
    census = _Census(texts, least, block_bytes, order)
    return census.grams(census.told())


# --- the automaton ----------------------------------------------------------------------------------


class Automaton:
    """The whole automaton in memory, for small corpora: arcs, failure arcs and backoff weights (log10).

    State 0 is the root; ``start`` is the state of an empty history. Scoring does not use it; see ``score``.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, documents: int, base, two: dict[int, int], three: dict[int, int], discount: float = DISCOUNT) -> None:
        mask = (1 << _BITS) - 1
        self.words = words
        self.states: dict[int, int] = {}
        context = {c >> _BITS for c in two}
        for c in sorted(context):
            self.states[c] = len(self.states) + 1
        for c in sorted({c >> _BITS for c in three} & two.keys()):
            self.states[-1 - c] = len(self.states) + 1  # histories of two tokens have negative keys
        n = len(self.states) + 1
        self.fail, self.back = [0] * n, [0.0] * n
        self.arcs: dict[int, tuple[float, int]] = {}
        seen = np.append(documents, counts)  # of each id as a history
        low = np.append(0.0, base(counts))  # base probability of each id
        left, under = np.ones(n), np.ones(n)
        prob = {}
        for c, k in two.items():
            u, v = c >> _BITS, c & mask
            p = (k - discount) / seen[u]
            prob[c] = p
            s = self.states[u]
            left[s] -= p
            under[s] -= low[v]
            self.arcs[s << _BITS | v] = (math.log10(p), self._state(u, v))
        for c, k in three.items():
            h, v = c >> _BITS, c & mask
            if -1 - h not in self.states:
                continue
            p = (k - discount) / two[h]
            s = self.states[-1 - h]
            left[s] -= p
            under[s] -= prob[(h & mask) << _BITS | v]
            self.arcs[s << _BITS | v] = (math.log10(p), self._state(h & mask, v))
        for key, s in self.states.items():
            self.back[s] = math.log10(max(left[s], 1e-9) / max(under[s], 1e-9))
            self.fail[s] = 0 if key >= 0 else self.states.get((-1 - key) & mask, 0)
        self.start = self.states.get(0, 0)
        self.after = [self.states.get(k, 0) for k in range(len(words) + 1)]

    def _state(self, u: int, v: int) -> int:
        return self.states.get(-1 - (u << _BITS | v)) or self.states.get(v, 0)

    def score(self, ids: list[int], base: list[float]) -> float:
        """One traversal: ids are frequent tokens' ids or -1, ``base`` each token's log10 probability at the root."""
        arcs, back, fail, after, s, total = self.arcs.get, self.back, self.fail, self.after, self.start, 0.0
        for v, p in zip(ids, base, strict=True):
            while s:
                arc = arcs(s << _BITS | v) if v > 0 else None
                if arc:
                    total += arc[0]
                    s = arc[1]
                    break
                total += back[s]
                s = fail[s]
            else:
                total += p
                s = after[v] if v > 0 else 0
        return total


class Language:
    """What scoring needs: corpus totals and the table of key ranges (n, part, key, data), n = 2 for tokens, START and pairs, 3 for triples; ``parts`` is how many ranges there are."""

    def __init__(self, n: int, v: int, documents: int, counts: DataFrame, pairs: DataFrame | None, triples: DataFrame | None, arcs: DataFrame, parts: int, least: int, order: int) -> None:
        self.n, self.v, self.documents, self.arcs, self.parts, self.order = n, v, documents, arcs, parts, order
        self._parts = counts, pairs, triples, least

    @property
    def scale(self) -> float:
        return self.n + ALPHA * (self.v + 1)

    @cached_property
    def automaton(self) -> Automaton:
        """All of it on the driver: for small corpora only, trained with ``keep_grams``."""
        counts, pairs, triples, least = self._parts
        words = np.array(sorted((r["token"], r["c"]) for r in counts.where(F.col("c") >= least).collect()), np.int64).reshape(-1, 2)
        ids = {int(START): 0} | {w: k + 1 for k, w in enumerate(words[:, 0].tolist())}
        rows = pairs.collect()
        code = {r["key"]: ids[r["hist"]] << _BITS | ids[r["low"]] for r in rows}
        two = {code[r["key"]]: r["c"] for r in rows}
        three = {code[r["hist"]] << _BITS | code[r["low"]] & ((1 << _BITS) - 1): r["c"] for r in triples.collect()}
        return Automaton(words[:, 0].copy(), words[:, 1], self.documents, lambda c: (c + ALPHA) / self.scale, two, three)


def _weights(parts: int, least: int, order: int):
    """Of the n-grams that a block shall name, packed by key range: keys and counts, and of each history the number of its arcs, the sums of their counts and of their suffixes' counts, and its last token's count."""

    def rows(n: int, of: int, key: np.ndarray, *columns: np.ndarray):
        part, at = np.unique(_part_of(key, parts), return_index=True)
        edge = np.append(at, len(key))
        for p, a, b in zip(part.tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            yield n, of, p, _pack(key[a:b], p, parts), _planes(np.concatenate([x[a:b] for x in columns]))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for n, key, count, *rest in _named(_Block(left), parts, least, order, right):
            out += rows(max(n, 2), 0, key, count)
            if n > 1:
                hist, _, suffix, last = rest
                from_, at = _ranked(hist)
                sums = [np.zeros(len(from_), np.int64) for _ in range(4)]
                for to, x in zip(sums, (1, count, suffix), strict=False):
                    np.add.at(to, at, x)
                sums[3][at] = last
                out += rows(2, n - 1, from_, *sums)
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()
        return pa.table({name: pa.array(x, kind) for name, x, kind in zip(("n", "hist", "part", "key", "data"), columns, kinds, strict=True)})

    return run


def _range(parts: int, scale: float):
    """A key range of the automaton: its sorted keys, their counts and the backoff weights of those that are histories."""

    def run(table: pa.Table) -> pa.Table:
        n, part = table["n"][0].as_py(), table["part"][0].as_py()
        kinds = table["hist"].to_numpy()
        keys = [_unpack(x.as_py(), part, parts) for x in table["key"]]
        data = [_from_planes(x.as_py()).reshape(-1, len(k)) for x, k in zip(table["data"], keys, strict=True)]

        def all_of(kind: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
            mine = np.flatnonzero(kinds == kind)
            key = np.concatenate([np.zeros(0, np.uint64), *(keys[k] for k in mine)])
            order = _order(key)
            return key[order], np.concatenate([np.zeros((columns, 0), np.int64), *(data[k] for k in mine)], axis=1)[:, order]

        key, (c,) = all_of(0, 1)
        back = np.full(len(key), np.nan)
        for kind in (1, 2):
            hist, sums = all_of(kind, 4)
            if not len(hist):
                continue
            head = np.flatnonzero(np.append(True, hist[1:] != hist[:-1]))
            arcs, counts, suffixes = (np.add.reduceat(x, head) for x in sums[:3])
            at = np.searchsorted(key, hist[head])
            under = (suffixes + ALPHA * arcs) / scale if kind == 1 else (suffixes - DISCOUNT * arcs) / sums[3][head]
            rest = [np.maximum(1 - x, 1e-9) for x in ((counts - DISCOUNT * arcs) / c[at], under)]
            back[at] = np.log10(rest[0] / rest[1])
        return pa.table({"n": pa.array([n], pa.int32()), "part": pa.array([part], pa.int32()), "key": _binary(_pack(key, part, parts)), "data": _binary(_reply(c, back))})

    return run


def train(texts: DataFrame, *, least: int = LEAST, order: int = ORDER, keep_grams: bool = False) -> tuple[Language, DataFrame]:
    """Model and (token, c) table of the one-column frame of training texts; a null text is empty (one end token).

    An n-gram's own n-grams occur as often as it does, so with one threshold every arc has its history and its suffix.
    With ``keep_grams`` the table of n-gram counts is kept too (``Language.automaton`` reads it).
    """
    spark = texts.sparkSession
    census = _Census(texts, least, BLOCK_BYTES, order)
    counts = materialise(census.tokens(), "tokens")
    n, v, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("token") == int(END), F.col("c"))), F.lit(0))).first()
    told = census.told()
    pairs = triples = None
    if keep_grams:
        grams = materialise(census.grams(told), "grams")
        pairs, triples = grams.where("n = 2").drop("n"), grams.where("n = 3").drop("n")
    parts = census.parts
    named = materialise(census.with_replies(told).applyInArrow(_weights(parts, least, order), "n int, hist int, part int, key binary, data binary"), "named")
    census.discard()
    ranges = named.repartition(parts, "part").groupBy("n", "part")
    arcs = materialise(ranges.applyInArrow(_range(parts, n + ALPHA * (v + 1)), "n int, part int, key binary, data binary"), "arcs")
    discard(named)
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # the shuffles behind these tables go before scoring makes its own
    return Language(n, v, max(ends, 1), counts, pairs, triples, arcs, parts, least, order), counts


# --- scoring ----------------------------------------------------------------------------------------


_RESULT = "id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, language: Language, counts: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) of every row; a null text is empty. Repeated rows are scored each for itself.

    Rows are cut into blocks of about ``block_bytes``; each block asks for its distinct keys, one request to
    each of as many key ranges as there are blocks: first for tokens and pairs, then for the triples of two known pairs.
    The result is a table of its own.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    blocks = materialise(base.mapInArrow(_blocked(block_bytes, 1, True), f"{_BLOCK}, ids array<{kind}>"), "blocks")
    parts = max(1, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    told_as = "block bigint, n int, part int, reply binary"
    asked_as = "block bigint, n int, part int, request binary"

    def by(rows: DataFrame, key: str):
        return rows.repartition(parts, key).groupBy(key)

    def answers(asked: DataFrame, n: int) -> DataFrame:
        ranged = language.arcs.where(F.col("n") == n).mapInArrow(_ranged(language.parts, parts), "part int, key binary, data binary")
        return materialise(by(asked, "part").cogroup(by(ranged, "part")).applyInArrow(_answer(parts), told_as), "answers")

    done = []
    rounds = min(ROUNDS, parts)
    for k in range(rounds):
        mine = blocks.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == k)
        packed = mine.select("block", "lengths", "words", "places")
        tables = [answers(packed.mapInArrow(_ask(parts), asked_as), 2)]
        if language.order > 2:
            asked = by(packed, "block").cogroup(by(tables[0], "block")).applyInArrow(_ask_long(parts), asked_as)
            tables.append(answers(asked, 3))
        told = reduce(DataFrame.unionByName, tables)
        scored = by(mine.drop("size"), "block").cogroup(by(told, "block")).applyInArrow(_score(parts, language.scale, language.order), _RESULT.format(kind=kind))
        done.append(materialise(scored, "scores"))
        for table in tables:
            discard(table)
    discard(blocks)
    return reduce(DataFrame.unionByName, done)


def _part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return (key.view(np.uint64) // np.uint64(_step(parts))).astype(np.int32)


def _step(parts: int) -> int:
    return (1 << 64) // parts + 1 if parts > 1 else (1 << 64) - 1


def _pack(key: np.ndarray, part: int, parts: int) -> bytes:
    """Sorted distinct unsigned keys of a range: differences in as many bytes as the largest takes."""
    step = np.diff(key, prepend=np.uint64(min(part * _step(parts), (1 << 64) - 1)))
    width = max(1, -(-int(step.max()).bit_length() // 8))
    return bytes([width]) + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(packed: bytes, part: int, parts: int) -> np.ndarray:
    width = packed[0]
    wide = np.zeros(((len(packed) - 1) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64) + np.uint64(min(part * _step(parts), (1 << 64) - 1))


def _planes(x: np.ndarray, width: int = 8) -> bytes:
    """Whole numbers below 2 ** (8 * width), by byte planes."""
    wide = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(8, "little") + pa.compress(wide.tobytes(), "zstd", asbytes=True)


def _from_planes(packed: bytes, width: int = 8) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    raw = pa.decompress(packed[8:], n * width, "zstd", asbytes=True) if n else b""
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return wide.reshape(-1).view("<i8")


def _order(key: np.ndarray) -> np.ndarray:
    """A stable np.argsort of unsigned hashes, by a sort of their upper bits with each place below, which is several times as fast."""
    bits = np.uint64(len(key).bit_length())
    order = (np.sort(key >> bits << bits | np.arange(len(key), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    found = key[order]
    return order if (found[1:] >= found[:-1]).all() else np.argsort(key, kind="stable")  # upper bits seldom agree where hashes differ


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and of each key which one it is."""
    order = _order(key)
    found = key[order]
    fresh = np.append(True, found[1:] != found[:-1]) if len(found) else np.zeros(0, bool)
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(fresh) - 1
    return found[fresh], at


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values. np.unique hashes where it is asked for values alone, which takes several times as long here."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _places(key: np.ndarray, parts: int, replies: pa.Table, n: int):
    """Of each reply about keys of ``n`` tokens, the stretch of a block's sorted keys of so many that it is about, and the reply."""
    part, at = np.unique(_part_of(key, parts), return_index=True)
    begin = dict(zip(part.tolist(), zip(at.tolist(), np.append(at, len(key))[1:].tolist(), strict=True), strict=True))
    replies = replies.filter(pa.compute.equal(replies["n"], n))
    for p, reply in zip(replies["part"].to_pylist(), replies["reply"], strict=True):
        yield begin[p], reply.as_py()


def _reply(c: np.ndarray, back: np.ndarray) -> bytes:
    """Counts (0 where a key is unknown) by byte planes, then the backoff weights of those that have one (nan: none)."""
    planes = _planes(c)
    has = ~np.isnan(back)
    return len(planes).to_bytes(8, "little") + planes + np.packbits(has).tobytes() + back[has].astype("<f8").tobytes()


def _read_reply(reply: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = 8 + int.from_bytes(reply[:8], "little")
    c = _from_planes(reply[8:at])
    bits = -(-len(c) // 8)
    has = np.unpackbits(np.frombuffer(reply, np.uint8, bits, at), count=len(c)).astype(bool)
    back = np.full(len(c), np.nan)
    back[has] = np.frombuffer(reply[at + bits :], "<f8")
    return c, back


def _known(key: np.ndarray, n: int, parts: int, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Counts and backoff weights of a block's sorted distinct keys of ``n`` tokens."""
    count, back = np.zeros(len(key), np.int64), np.zeros(len(key))
    for (a, b), reply in _places(key, parts, replies, n):
        count[a:b], weight = _read_reply(reply)
        back[a:b] = np.nan_to_num(weight)  # a history that no arc leaves is no state: its backoff costs nothing
    return count, back


def _ask(parts: int):
    def run(batches):
        for block in _each(batches):
            for n, key in ((1, block.words), (2, _distinct(block.two[block.is_two].view(np.uint64)))):
                yield from _sent(block.number, n, key, None, parts).to_batches()

    return run


def _ask_long(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left)
        key, at = block.pairs()
        count, _ = _known(key, 2, parts, right)
        _, triple = block.triples(block.is_two & (count > 0)[at])
        return _sent(block.number, 3, _distinct(triple), None, parts)

    return run


def _ranged(of: int, parts: int):
    """The automaton's key ranges, ``of`` in all, cut anew into ``parts``."""

    def run(batches):
        for batch in batches:
            for p, key, data in zip(batch["part"].to_pylist(), batch["key"], batch["data"], strict=True):
                key, (c, back) = _unpack(key.as_py(), p, of), _read_reply(data.as_py())
                part, at = np.unique(_part_of(key, parts), return_index=True)
                edge = np.append(at, len(key)).tolist()
                for q, a, b in zip(part.tolist(), edge[:-1], edge[1:], strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), _binary(_pack(key[a:b], q, parts)), _binary(_reply(c[a:b], back[a:b]))], names=["part", "key", "data"])

    return run


def _answer(parts: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key = np.concatenate([np.zeros(0, np.uint64), *(_unpack(k.as_py(), p, parts) for p, k in zip(right["part"].to_pylist(), right["key"], strict=True))])
        data = [_read_reply(x.as_py()) for x in right["data"]]
        c, back = (np.concatenate([np.zeros(0, kind), *(x[k] for x in data)]) for k, kind in enumerate((np.int64, float)))
        order = _order(key)
        key, c, back = key[order], c[order], back[order]
        replies = []
        for part, request in zip(left["part"].to_pylist(), left["request"], strict=True):
            asked = _unpack(request.as_py(), part, parts)
            at = np.minimum(np.searchsorted(key, asked), max(len(key) - 1, 0))
            known = key[at] == asked if len(key) else np.zeros(len(asked), bool)
            replies.append(_reply(np.where(known, c[at], 0), np.where(known, back[at], np.nan)) if len(key) else _reply(np.zeros(len(asked), np.int64), np.full(len(asked), np.nan)))
        return pa.table({"block": left["block"], "n": left["n"], "part": left["part"], "reply": pa.array(replies, pa.binary())})

    return run


def _score(parts: int, scale: float, order: int):
    log_scale = math.log10(scale)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = _Block(left)
        is_two, is_three = block.is_two, block.is_three & (order > 2)
        count, back = _known(block.words, 1, parts, right)
        n_one, back_one = count[block.at], back[block.at]
        key, at = block.pairs()
        count, back = _known(key, 2, parts, right)
        n_two, back_two = np.where(is_two, count[at], 0), np.where(is_two, back[at], 0.0)
        n_three = np.zeros(len(n_one), np.int64)
        if order > 2:
            place, triple = block.triples(n_two > 0)
            key, which = _ranked(triple)
            n_three[place] = _known(key, 3, parts, right)[0][which]
        logs = np.log10(n_one + ALPHA) - log_scale
        with np.errstate(divide="ignore", invalid="ignore"):  # counts of the histories of one and of two tokens stand one place before
            arc_two = np.log10((n_two - DISCOUNT) / np.roll(n_one, 1))
            arc_three = np.log10((n_three - DISCOUNT) / np.roll(n_two, 1))
        # at the state of one token, then at that of two: the arc, or the backoff weight and the failure arc
        total = np.where(n_two > 0, arc_two, np.roll(back_one, 1) + logs)
        total = np.where(n_three > 0, arc_three, np.where(is_three, np.roll(back_two, 1), 0.0) + total)
        first = np.cumsum(block.lengths) - block.lengths
        sums = {"n_known": (n_one > 0).astype(np.int64), "base_score": logs, "score": total}
        return pa.table({"id": left["ids"].combine_chunks().flatten(), "n_tokens": pa.array(block.lengths)} | {k: pa.array(np.add.reduceat(x[is_two], first)) for k, x in sums.items()})

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 10) == 0
    language, counts = train(docs.where(~held_out).select("text"))
    done = score(docs, language, counts)
    return done.select(F.col("id").alias("doc_id"), (crc_fold(F.col("id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(language.n).cast("bigint").alias("train_tokens"), "base_score", "score")
