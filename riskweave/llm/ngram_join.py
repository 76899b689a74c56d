"""N-gram Jaccard join (operator 7): universe-partition pigeonhole.

A document's set is its distinct 5-word shingles (hashed to 64 bits). Sets are banded by size; a linked pair lies in
one band or in two neighbouring ones. Within band b a linked pair differs in at most H shingles. Shingles are hashed
into m segments; each segment is allocated 1 (it must be equal on both sides) or 2 (it may differ by one shingle:
besides its own hash the segment's one-deletion neighbourhood is indexed). If the allocations of a document's
non-empty segments sum to more than H, some segment must meet its allocation in every linked pair. How many segments
there are and which get 2 is chosen per band by a cost model of index rows (``allocate``).

Equal sets are one class from the start. A class is first paired with a few of the smallest classes that share
signatures with it, later with the first class of another component that does; the pairs are verified exactly and
joined into components. What is left are signatures that several components share. Where those are few, the classes
of different components are compared. A signature that many components share (a common passage) is hot: it is
allocated nothing, in all its classes alike. A class whose other segments still carry the guarantee needs nothing
more; classes that fall short, and those whose segments are too empty from the start, meet by their rarest shingles,
which is exact among them. Before a text moves, sizes and parity bitmaps rule out pairs that cannot be linked (a lower
bound of the difference, so no link is lost). So a group of n near copies costs about n verifications, and no link
between different sets is lost for components.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.apart import BITS, PARITY, mixed, paired, rarest, sifted, spokes
from riskweave.llm.common import Powers, Shared, components, discard, extended, marked, materialise, mix, prefix_hash, read, space_words, span_hash, text_slices, unused, utf8
from riskweave.llm.repeats import keyed

SHINGLE = 5
#: Linked when LEAST[1] * intersection >= LEAST[0] * union.
LEAST = (80, 100)
THRESHOLD = LEAST[0] / LEAST[1]
#: Segments beyond the H + 1 of the guarantee: so many may be hot before a class has to be indexed otherwise.
RESERVE = 2
#: A signature shared by more components than this is hot: it is allocated nothing.
REFINE_OVER = 8
#: At first each class is compared with this many classes, each the smallest of signatures that both have.
STARS = 2
#: Bits of the bitmap that sifts rows before texts are shuffled.
SIEVEBITS = 1 << 23
#: A star centre's pairs are dealt into groups of about this many.
SALT_ROWS = 1000


# --- sizes, bands and allocation ----------------------------------------------------------------


def bands(largest: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last size of each band: the last is the largest partner of the first."""
    low, high, n = [], [], 1
    while n <= largest:
        low.append(n)
        high.append(n * LEAST[1] // LEAST[0])
        n = high[-1] + 1
    return np.array(low), np.array(high)


def allocate(low: int, high: int, known: dict = {}) -> tuple[int, int, int]:  # noqa: B006  (a memo)
    """(H, segments allocated 1, segments allocated 2) of a band.

    H = floor((s + r) (1 - t) / (1 + t)) at the band's largest pair. The cost of a choice is its expected index rows,
    plus the rows of documents whose empty segments leave too little, as if shingles fell independently.
    """
    if (low, high) in known:
        return known[low, high]
    t = LEAST[0] / LEAST[1]
    h = int((high + high * LEAST[1] // LEAST[0]) * (1 - t) / (1 + t) + 1e-9)
    n = (low + high) / 2
    best = None
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        for slack in range(0, h // 2 + 8, max(1, h // 40)):
            total = h + 1 + RESERVE + slack
            twos = int(share * total / 2)
            ones = total - 2 * twos
            if not ones + twos:
                continue
            mean = n / (ones + twos)
            none, single = math.exp(-mean), mean * math.exp(-mean)
            rows = ones * (1 - none) + twos * (1 - none + mean)
            lost = ones * none + twos * (2 * none + single)
            spread = math.sqrt(max(1e-9, ones * none * (1 - none) + twos * (4 * none + single)))
            fails = 0.5 * math.erfc((slack + 0.5 - lost) / spread / math.sqrt(2))
            cost = rows + fails * (n * (1 - t) + 1) * 20
            if best is None or cost < best[0]:
                best = (cost, ones, twos)
    known[low, high] = h, best[1], best[2]
    return known[low, high]


# --- sets and signatures --------------------------------------------------------------------------


def shingle_sets(raw, starts, ends, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and where each row's set begins (n + 1 numbers)."""
    h, _, _, first = space_words(raw, starts, ends, lower=True, powers=powers)
    prefix = prefix_hash(h, powers)
    count = np.diff(first)
    grams = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(len(count)), grams)
    at = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams) + first[row]
    hashes = span_hash(prefix, at, at + np.minimum(count, SHINGLE)[row], powers)
    edge = np.append(0, np.cumsum(grams)).tolist()
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        hashes[a:b].sort()  # several times as fast as np.lexsort over all rows
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    row, hashes = row[keep], hashes[keep]
    return hashes, np.append(0, np.cumsum(np.bincount(row, minlength=len(count))))


def _sum_by(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of values[begin[i]:begin[i + 1]]."""
    total = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
    return total[begin[1:]] - total[begin[:-1]]


def classes(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; an empty set has 0. The first is its class, unless the second tells two sets of one class apart."""
    size = np.diff(begin).astype(np.uint64)
    out = []
    for seed in (0x51_7C_C1_B7_27_22_0A_95, 0x6A_09_E6_67_F3_BC_C9_09):
        own = mix(_sum_by(mix(hashes ^ np.uint64(seed)), begin) + size * np.uint64(0x9E3779B97F4A7C15))
        out.append(np.where(size == 0, np.uint64(0), own).view(np.int64))
    return out[0], out[1]


def _slots(hashes: np.ndarray, begin: np.ndarray, shift: int):
    """The segments of all rows in their own band (``shift`` 0) or the band below (1): None where no row has such a band.

    Gives each shingle's token and segment slot, and of each slot its row, band, segment, number of shingles and
    whether it is allocated 2; of each row, H.
    """
    size = np.diff(begin)
    low, high = bands(1 << int(size.max() * 2).bit_length())
    band = np.searchsorted(low, size, "right") - 1 - shift
    use = (size > 0) & (band >= 0)
    if not use.any():
        return None
    table = np.zeros((band.max() + 1, 3), np.int64)
    for b in np.unique(band[use]):
        table[b] = allocate(int(low[b]), int(high[b]))
    plan = np.where(use[:, None], table[np.maximum(band, 0)], 0)
    many = plan[:, 1] + plan[:, 2]
    off = np.cumsum(many) - many
    inside = np.repeat(use, size)
    rows = np.repeat(np.arange(len(size)), size)[inside]
    token = mix(hashes[inside] + np.uint64(0xD1B54A32D192ED03))
    slot = off[rows] + (mix(token ^ band[rows].astype(np.uint64)) % many[rows].astype(np.uint64)).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), many)
    segment = np.arange(len(owner)) - off[owner]
    return token, slot, owner, band[owner], segment, np.bincount(slot, minlength=len(owner)), segment < plan[owner, 2], plan[:, 0]


def signatures(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of all rows: one for each segment that is not empty, and the one-deletion neighbourhood of those allocated 2."""
    out_row, out_sig = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for shift in (0, 1) if len(hashes) else ():
        found = _slots(hashes, begin, shift)
        if found is None:
            continue
        token, slot, owner, band, segment, length, two, _ = found
        total = (band << 32 | segment).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
        np.add.at(total, slot, token)
        filled = length > 0
        out_row.append(owner[filled])
        out_sig.append(mix(total[filled]))
        wide = (two & (length > 1))[slot]
        out_row.append(owner[slot[wide]])
        out_sig.append(mix(total[slot[wide]] - token[wide]))
    return np.concatenate(out_row), np.concatenate(out_sig).view(np.int64)


def spare(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many signatures of each row may be left out before a linked partner could be missed: 0 or less where its segments do not carry the guarantee at all."""
    out = np.full(len(begin) - 1, 1 << 40, np.int64)
    for shift in (0, 1) if len(hashes) else ():
        found = _slots(hashes, begin, shift)
        if found is None:
            continue
        _, _, owner, _, _, length, two, h = found
        worth = np.bincount(owner, np.where(two & (length > 1), 2, length > 0), len(out)).astype(np.int64)
        twos = np.bincount(owner, two, len(out)) > 0
        rest = worth - h
        there = np.bincount(owner, minlength=len(out)) > 0
        out = np.where(there, np.minimum(out, np.where(twos & (rest > 0), (rest + 1) // 2, rest)), out)
    return out


def parity(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """``PARITY`` words a row: bit i is the parity of the row's shingles that hash to i. Two sets differ in at least as many shingles as bits."""
    rows = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    bit = (mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(64 * PARITY)).astype(np.int64)
    odd = np.bincount(rows * (64 * PARITY) + bit, minlength=(len(begin) - 1) * 64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(-1, PARITY)


def _sizes(batches):
    powers = Powers()
    for batch in text_slices(batches, 2, 1 << 20):
        hashes, begin = shingle_sets(*utf8(batch.column(2)), powers)
        own, check = classes(hashes, begin)
        bits = parity(hashes, begin)
        arrays = [batch.column(0), batch.column(1), *(pa.array(x) for x in (np.diff(begin), own, check, spare(hashes, begin))), *(pa.array(bits[:, k].copy()) for k in range(PARITY))]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "rid", "n_shingles", "cls", "chk", "spare", *BITS])


def _parted(own: np.ndarray, check: np.ndarray, clash: np.ndarray) -> np.ndarray:
    """Class numbers, those in ``clash`` told apart by their second hash."""
    if not len(clash):
        return own
    return np.where(np.isin(own, clash), mix(own.view(np.uint64) * np.uint64(0xA24BAED4963EE407) + check.view(np.uint64)).view(np.int64), own)


def _once(batch, powers: Powers, clash: np.ndarray):
    """Classes, shingles and beginnings of a batch's sets, each class once (others empty)."""
    hashes, begin = shingle_sets(*utf8(batch.column(0)), powers)
    own = _parted(*classes(hashes, begin), clash)
    once = np.zeros(len(own), bool)
    once[np.unique(own, return_index=True)[1]] = True
    return own, hashes[np.repeat(once, np.diff(begin))], np.append(0, np.cumsum(np.where(once, np.diff(begin), 0)))


def _signed(clash: np.ndarray):
    def run(batches):
        powers = Powers()
        for batch in text_slices(batches, 0, 1 << 20):
            own, hashes, begin = _once(batch, powers, clash)
            row, sig = signatures(hashes, begin)
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(own[row])], names=["sig", "cls"])

    return run


def _shingled(batches):
    """(cls, shingle) from (cls, items): the sets of packed texts."""
    powers = Powers()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = _unpacked(part.column(1).to_pylist(), powers)
            cls = np.repeat(part.column(0).to_numpy(), [len(x) for x in sets])
            if len(cls):
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(np.concatenate(sets).view(np.int64))], names=["cls", "shingle"])


def _groups(batches):
    """From rows sorted by (sig, cls): (sig, cls, hub) of signatures that several classes have, once each; hub is the smallest class."""
    last = None  # (sig, cls, hub, whether written)
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is not None:
            sig, cls = np.append(last[0], sig), np.append(last[1], cls)
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
        sig, cls = sig[new], cls[new]
        head = np.append(True, sig[1:] != sig[:-1])
        hub = cls[np.maximum.accumulate(np.where(head, np.arange(len(sig)), 0))]
        if last is not None:
            hub[: int(np.argmax(head[1:])) + 1 if head[1:].any() else len(hub)] = last[2]
        shared = ~head
        shared[:-1] |= ~head[1:]
        if last is not None:
            shared[0] = not last[3] and len(sig) > 1 and not head[1]
        n = len(sig) - 1
        written = bool(n and not head[n]) or (n == 0 and last is not None and last[3])
        if n and shared[n]:
            out = shared.copy()  # the last row has a partner before it, so it can go out now
        else:
            out = shared.copy()
            out[n] = False
        yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(cls[out]), pa.array(hub[out])], names=["sig", "cls", "hub"])
        last = (sig[n], cls[n], hub[n], written)


def _packed(sieve):
    """Packed texts of the rows whose key may be wanted."""

    def run(batches):
        bits = sieve.value
        for batch in text_slices(batches, 1, 4 << 20):
            at = mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(SIEVEBITS - 1)
            batch = batch.filter(pa.array((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.compress(t.encode(), 1) for t in batch.column(1).to_pylist()], pa.binary())], names=["rid", "items"])

    return run


def _marks(batches):
    """(word, bits) of a bitmap that marks row keys."""
    for batch in batches:
        at = mix(batch.column(0).to_numpy().view(np.uint64)) & np.uint64(SIEVEBITS - 1)
        word, where = np.unique((at >> np.uint64(6)).astype(np.int64), return_inverse=True)
        bits = np.zeros(len(word), np.uint64)
        np.bitwise_or.at(bits, where, np.uint64(1) << (at & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])


def _sieve(rids: DataFrame) -> Shared:
    """A bitmap of ``SIEVEBITS`` bits (its size is fixed) that passes every row key in ``rids``, and few others while those are few."""
    bits = np.zeros(SIEVEBITS // 64, np.uint64)
    rows = rids.select("rid").mapInArrow(_marks, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Shared(rids.sparkSession, bits)


def _unpacked(items: list[bytes], powers: Powers) -> list[np.ndarray]:
    """The shingle sets of packed texts, read a megabyte at a time."""
    out: list[np.ndarray] = []
    texts: list[bytes] = []
    size = 0
    for k, item in enumerate(items):
        texts.append(zlib.decompress(item))
        size += len(texts[-1])
        if size > 1 << 20 or k == len(items) - 1:
            ends = np.cumsum([len(t) for t in texts])
            hashes, begin = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.append(0, ends[:-1]), ends, powers)
            out += [hashes[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
            texts, size = [], 0
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact check of two sorted sets."""
    if min(len(a), len(b)) * LEAST[1] < max(len(a), len(b)) * LEAST[0]:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return LEAST[1] * shared >= LEAST[0] * (len(a) + len(b) - shared)


def _verify(batches):
    """Rows sorted by (hub, salt, whether a member): the hub's text, then its members' texts. Yields linked pairs."""
    centre, own, powers = None, None, Powers()
    for batch in batches:
        a, b = [], []
        sets = _unpacked(batch.column(4).to_pylist(), powers)
        for hub, salt, cls, member, values in zip(*(batch.column(k).to_pylist() for k in range(4)), sets, strict=True):
            if not member:
                centre, own = (hub, salt), values
            elif centre == (hub, salt) and linked(own, values):
                a.append(hub)
                b.append(cls)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


# --- the join ---------------------------------------------------------------------------------------


def texts_of(wanted: DataFrame, real: DataFrame, base: DataFrame, unique: bool) -> DataFrame:
    """(cls, items) of the classes in ``wanted``: the packed text of one document of each."""
    first = materialise(real.join(wanted.select("cls").distinct(), "cls").groupBy("cls").agg(F.min("rid").alias("rid")), "first")
    packed = base.select("rid", "text").mapInArrow(_packed(_sieve(first)), "rid bigint, items binary").join(first, "rid").select("cls", "items")
    return materialise(packed if unique else packed.dropDuplicates(["cls"]), "texts")


def verify(pairs: DataFrame, real: DataFrame, base: DataFrame, unique: bool) -> DataFrame:
    """The linked ones among ``pairs`` (hub, cls), as (a, b)."""
    sets = texts_of(pairs.select("cls").unionByName(pairs.select(F.col("hub").alias("cls"))), real, base, unique)
    count = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    members = pairs.join(count, "hub").withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("salts")).cast("int")).join(sets, "cls")
    centres = count.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets.withColumnRenamed("cls", "hub"), "hub")
    rows = members.select("hub", "salt", "cls", F.lit(1).alias("member"), "items").unionByName(centres.select("hub", "salt", F.col("hub").alias("cls"), F.lit(0).alias("member"), "items"))
    links = materialise(rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member").mapInArrow(_verify, "a bigint, b bigint"), "links")
    discard(sets)
    return links


def class_links(base: DataFrame, unique: bool, real: DataFrame, clash: np.ndarray) -> DataFrame:
    """(node, component) of the classes that are linked with others; ``real`` has the rows with shingles."""
    signed = base.select("text").mapInArrow(_signed(clash), "sig bigint, cls bigint")
    multi = materialise(signed.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(_groups, "sig bigint, cls bigint, hub bigint"), "signatures")
    facts = materialise(real.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n_shingles", "spare", *BITS))).join(multi.select("cls").distinct(), "cls", "left_semi"), "facts")

    shares = multi.where("cls <> hub").groupBy("cls", "hub").agg(F.count("*").alias("n"))
    top = shares.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "hub"))), 1, STARS).alias("hubs"))  # no more than its signatures
    stars = materialise(sifted(top.select("cls", F.explode("hubs.hub").alias("hub")), facts, THRESHOLD), "stars")
    links = verify(stars, real, base, unique)
    labels = components(links)
    left = mixed(multi, labels)

    # classes that are still apart meet the first class of the signature's smallest component
    second = materialise(sifted(spokes(left), facts, THRESHOLD).join(stars, ["hub", "cls"], "left_anti"), "stars")
    done = stars
    if not second.isEmpty():
        labels = extended(labels, verify(second, real, base, unique))
        left, done = mixed(left, labels), stars.unionByName(second)

    # what is left is exhausted: signatures of few components directly; the others are allocated nothing, and classes that
    # then miss the guarantee meet by their rarest shingles
    hot = F.col("components") > REFINE_OVER
    few = paired(left.where(~hot), "sig", facts, done, THRESHOLD)
    lost = left.where(hot).groupBy("cls").agg(F.count("*").alias("lost"))
    bare = real.where("spare <= 0").select("cls", "spare").distinct()
    needy = facts.join(lost, "cls").where("lost >= spare").select("cls").unionByName(bare.select("cls")).distinct()
    short = materialise(needy.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("component")), "short")
    rare = few.limit(0)
    if not short.isEmpty():
        every = real.groupBy("cls").agg(*(F.first(c).alias(c) for c in ("n_shingles", *BITS)))
        shingled = materialise(texts_of(short, real, base, unique).mapInArrow(_shingled, "cls bigint, shingle bigint"), "shingles")
        rare = paired(rarest(shingled, short, THRESHOLD), "shingle", every, done, THRESHOLD)
    more = materialise(few.unionByName(rare).distinct(), "pairs")
    if not more.isEmpty():
        labels = extended(labels, verify(more, real, base, unique))
    return labels


def similar_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, rid, n_shingles, cls, component_id) of every row, and its base rows (id, text, rid).

    Rows without words (null or empty text) have no shingles and are linked with nothing. Texts under five words have
    one shingle. Rows that repeat an id are documents of their own. Component ids are the smallest id; null ids are
    passed over, so a component of null ids has a null id. An empty table gives none.
    """
    base, unique = keyed(docs, id_col, text_col)
    kind = base.schema["id"].dataType.simpleString()
    made = base.select("id", "rid", "text").mapInArrow(_sizes, f"id {kind}, rid bigint, n_shingles bigint, cls bigint, chk bigint, spare bigint, {', '.join(f'{b} bigint' for b in BITS)}")
    sizes = materialise(made, "sizes")
    double = sizes.groupBy("cls").agg(F.min("chk").alias("low"), F.max("chk").alias("high")).where("low <> high").select("cls")
    clash = np.sort(np.array([r["cls"] for r in double.collect()], np.int64))  # n**2 / 2**65 of n different sets are expected
    if len(clash):
        part = F.pandas_udf(lambda c, k: c.__class__(_parted(c.to_numpy(), k.to_numpy(), clash)), "bigint")
        sizes = materialise(sizes.withColumn("cls", part("cls", "chk")), "sizes")
    real = sizes.where("n_shingles > 0")
    labels = class_links(base, unique, real, clash)
    grouped = real.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    found = grouped.join(least, "component").select("id", "rid", "n_shingles", "cls", "component_id")
    return found.unionByName(sizes.where("n_shingles = 0").select("id", "rid", "n_shingles", "cls", F.col("id").alias("component_id"))), base


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of each component; rows linked with nothing stay. Of rows that repeat that id, one stays if they are in one component."""
    found, _ = similar_groups(docs, id_col=id_col, text_col=text_col)
    found = materialise(found.select("id", "rid", "cls", F.expr("id <=> component_id or n_shingles = 0").alias("stays")), "found")
    if found.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        parted = marked(docs, id_col, found.where("not stays").select(F.col("id").alias(id_col)))  # texts that stay are not shuffled
        flag = parted.columns[-1]
        maybe = parted.where(F.col(flag)).drop(flag).join(found.where("not stays").select(F.col("id").alias(id_col)), id_col, "left_anti")
        return parted.where(~F.col(flag)).drop(flag).unionByName(maybe)
    keep = found.where("stays").groupBy("id", "cls").agg(F.min("rid").alias("rid")).select("rid")  # ids repeat: rows are told apart by id and text
    own, name = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("\x00")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))), unused(docs, "rid")
    return docs.withColumn(name, own).join(keep.withColumnRenamed("rid", name), name, "left_semi").dropDuplicates([name]).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = similar_groups(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def brute_force(documents: list[tuple[int, str | None]]) -> list[tuple]:
    """The definition, for tests."""
    fold = bytes(x + 32 if 0x41 <= x <= 0x5A else x for x in range(256))
    sets = []
    for i, t in documents:
        w = (t or "").encode().translate(fold).split()
        sets.append((i, {tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where: dict = {}
    for x, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(x)
    for x, (_, s) in enumerate(sets):
        near: dict[int, int] = {}
        for g in s:
            for y in where[g]:
                if y > x:
                    near[y] = near.get(y, 0) + 1
        for y, n in near.items():
            if LEAST[1] * n >= LEAST[0] * (len(s) + len(sets[y][1]) - n):
                parent[find(x)] = find(y)
    least: dict[int, int] = {}
    for x, (i, _) in enumerate(sets):
        r = find(x)
        least[r] = min(least.get(r, i), i)
    return [(i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets)]
