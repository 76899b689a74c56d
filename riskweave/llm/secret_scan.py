"""Secret scans (operator 12), native: fixed patterns, and runs that look random to a pair of character Markov models.

Matches of the patterns are found by splitting a text at them: pieces and matches alternate, so one walk along their
lengths gives the positions. What they cover is blanked, and the runs of token characters that are left are candidates.
One first-order model counts the characters of random strings, another those of ordinary identifiers; a run whose
log-likelihood ratio reaches ``BITS`` bits is reported as well. Both models are trained from labelled samples: what the
patterns found and digests are random, all other long runs of the corpus that look like words or numbers are ordinary. Their counts are one aggregation
to at most two rows for each pair of characters, the only thing that reaches the driver or a shuffle.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import materialise, read

#: Kind and pattern, in the order in which kinds of one start are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "random")
#: Runs of token characters: from ``SAMPLE_CHARS`` on they train the model of identifiers, from ``RUN_CHARS`` on they are scored.
SAMPLE_CHARS, RUN_CHARS = 12, 20
RUN = r"[A-Za-z0-9+/_.=-]{%d,}" % SAMPLE_CHARS
#: Runs with such a change of case or between letters and digits have no label, as they may be secrets that no pattern knows.
MIXED = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[A-Z][A-Z][a-z]|[A-Z][a-z][A-Z]"
#: How many bits likelier a run must be as a random string; random strings are rare, so this is about one in a million.
BITS = 20
#: Added to each character's count, and how many observations the characters' own shares count as after each character.
SMOOTHING, PRIOR = 0.5, 8
#: Characters are numbered from '+' (1) to 'z' (80), of which the alphabet has 68; 0 stands before the first.
ALPHABET = "".join(chr(x) for x in range(43, 123) if re.fullmatch(r"[A-Za-z0-9+/_.=-]", chr(x)))
BELOW, CODES = 42, 81
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row; a column that a lambda captures may be evaluated once an element."""
    return F.get(F.transform(F.array(value), body), 0)


def _placed(gaps: Column, hits: Column, keep: Callable[[Column], Column]) -> Column:
    """(at, hit) of the hits to keep, in one walk along the text; finished blocks are put aside, so that appending stays cheap."""
    none = F.array().cast("array<struct<at:bigint,hit:string>>")
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("at"), F.array().cast("array<array<struct<at:bigint,hit:string>>>").alias("done"), none.alias("part"))

    def step(s, x):
        full = F.size(s["part"]) >= _BLOCK
        at, part = s["at"] + x["gap"], F.when(full, none).otherwise(s["part"])
        more = F.when(keep(x["hit"]), F.concat(part, F.array(F.struct(at.alias("at"), x["hit"].alias("hit"))))).otherwise(part)
        return F.struct((at + F.coalesce(F.length(x["hit"]), zero)).alias("at"), F.when(full, F.concat(s["done"], F.array(s["part"]))).otherwise(s["done"]).alias("done"), more.alias("part"))

    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).cast("bigint").alias("gap"), h.alias("hit")))  # the last gap has no hit
    return F.aggregate(pairs, start, step, lambda s: F.flatten(F.concat(s["done"], F.array(s["part"]))))


def find(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Struct of ``hits``, an array of (at, hit) for the matches that ``keep`` wants, and ``rest``, the text with those blanked."""
    keep = keep or (lambda hit: hit.isNotNull())

    def found(t, hits):
        def apart(gaps):
            rest = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.when(h.isNull(), "").when(keep(h), F.repeat(F.lit(" "), F.length(h))).otherwise(h)))
            return F.struct(_placed(gaps, hits, keep).alias("hits"), F.array_join(rest, "").alias("rest"))

        return let(F.split(t, pattern, -1), apart)

    none = F.array().cast("array<struct<at:bigint,hit:string>>").alias("hits")
    return let(text, lambda t: let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda h: F.when(F.size(h) > 0, found(t, h)).otherwise(F.struct(none, t.alias("rest")))))


def _value(match: Column) -> Column:
    """Group 2 of a match of ``ASSIGN``."""
    return F.regexp_extract(match, ASSIGN, 2)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, secrets, runs, long): spans (start, kind, end) of the patterns by start and kind, their secret parts, the runs outside them, and (at, hit) of the long ones.

    Positions are code points, ends exclusive. Texts are searched whole, however long; null counts as empty, and an empty
    text has none. Each row stands for itself, also where ids repeat or are null; other columns are ignored.
    """


    def spans(found: str, kind: int) -> Column:
        return F.transform(f"{found}.hits", lambda x: F.struct(x["at"].alias("start"), F.lit(kind).alias("kind"), (x["at"] + F.length(x["hit"])).alias("end")))

    df = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    none = F.struct(F.array().cast("array<struct<at:bigint,hit:string>>").alias("hits"), F.col("t").alias("rest"))
    small = F.lower("t")  # plain searches spare most texts the slow patterns
    df = df.withColumn("maybe", reduce(Column.__or__, [small.contains(x) for x in ("passw", "secret", "token", "api")]))
    df = df.withColumn("a", F.when(F.col("maybe"), find(F.col("t"), ASSIGN, lambda m: F.length(_value(m)) >= ASSIGN_CHARS)).otherwise(none))
    df = df.withColumn("k", F.when(F.col("t").contains("AKIA"), find(F.col("t"), ACCESS)).otherwise(none)).withColumn("h", find(F.col("t"), HEX))
    secrets = F.concat(F.transform("a.hits", lambda x: _value(x["hit"])), "k.hits.hit", "h.hits.hit")
    df = df.select("id", "t", F.col("a.rest").alias("rest"), F.array_sort(F.concat(spans("a", 0), spans("k", 1), spans("h", 2))).alias("base"), secrets.alias("secrets"))
    for pattern in (ACCESS, HEX):
        df = df.withColumn("rest", F.when(F.size("base") > 0, find(F.col("rest"), pattern)["rest"]).otherwise(F.col("rest")))
    long = lambda h: F.length(h) >= RUN_CHARS
    df = df.select("id", "rest", "base", "secrets", F.regexp_extract_all(F.col("rest"), F.lit(RUN), F.lit(0)).alias("runs"))
    placed = F.when(F.exists("runs", long), let(F.split(F.col("rest"), RUN, -1), lambda gaps: _placed(gaps, F.col("runs"), long)))
    return df.select("id", "base", "secrets", "runs", F.coalesce(placed, F.array().cast("array<struct<at:bigint,hit:string>>")).alias("long"))


def train(samples: DataFrame, text_col: str = "text", random_col: str = "random") -> list[int]:
    """Thousandths of a bit by which the pair (previous, next) of characters speaks for a random string, at previous * CODES + next.

    ``samples`` has strings and whether they are random. Both models are first-order; after a character that was seldom
    seen they lean on the shares of single characters. Characters outside the alphabet and those after them are not counted; null strings and labels take no part.
    Without samples all weights are 0.
    """
    pairs = let(F.split(F.col("t"), ""), lambda letters: F.zip_with(F.concat(F.array(F.lit("")), F.slice(letters, 1, F.size(letters) - 1)), letters, lambda p, c: F.concat(p, c)))
    rows = samples.select(F.col(text_col).cast("string").alias("t"), F.col(random_col).cast("boolean").alias("random")).where("t <> '' and random is not null")
    rows = rows.select("random", F.explode(pairs).alias("pair")).where(F.col("pair").rlike("^[A-Za-z0-9+/_.=-]{1,2}$")).groupBy("random", "pair").count()
    return _weights(Counter({(r["random"], r["pair"]): r["count"] for r in rows.collect()}))  # two rows for each pair of the alphabet at most


def _weights(pairs: Counter) -> list[int]:
    """From the counts of (random, previous + next); the previous character is empty at the start."""
    after, single, total = Counter(), Counter(), Counter()
    for (random, pair), n in pairs.items():
        after[random, pair[:-1]] += n
        single[random, pair[-1]] += n
        total[random] += n

    def chance(random: bool, p: str, c: str) -> float:
        alone = (single[random, c] + SMOOTHING) / (total[random] + SMOOTHING * len(ALPHABET))
        return (pairs[random, p + c] + PRIOR * alone) / (after[random, p] + PRIOR)

    weights = [0] * (CODES * CODES)
    for p in ("", *ALPHABET):
        for c in ALPHABET:
            weights[(ord(p) - BELOW if p else 0) * CODES + ord(c) - BELOW] = math.floor(1000 * math.log2(chance(True, p, c) / chance(False, p, c)) + 0.5)
    return weights


def score(run: Column, weights: list[int]) -> Column:
    """Log-likelihood ratio of a string of the alphabet in thousandths of a bit, positive where it looks random."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded to one constant
    start = F.struct(F.lit(0).alias("before"), F.lit(0).cast("bigint").alias("sum"))

    def step(s, c):
        return F.struct((F.ascii(c) - BELOW).alias("before"), (s["sum"] + F.get(table, s["before"] * CODES + F.ascii(c) - BELOW)).alias("sum"))

    return F.aggregate(F.split(run, ""), start, step, lambda s: s["sum"])


def samples_of(scanned: DataFrame) -> DataFrame:
    """(text, random): secrets of the patterns and a base64 digest of each id are random, runs outside them ordinary unless they are ``MIXED``."""
    digest = F.base64(F.unhex(F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"), 256)))
    rows = scanned.select(F.explode_outer(F.concat(
        F.transform(F.concat("secrets", F.array(digest)), lambda v: F.struct(v.alias("text"), F.lit(True).alias("random"))),
        F.transform(F.filter("runs", lambda r: ~r.rlike(MIXED)), lambda r: F.struct(r.alias("text"), F.lit(False).alias("random"))),
    )).alias("s"))
    return rows.select("s.text", "s.random")  # never null; an inner explode would have its filter copied down through the scan


def find_secrets(docs: DataFrame, weights: list[int] | None = None, *, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id, base, found): spans (start, kind, end) of the patterns, and those together with the runs that look random; see ``scan``.

    Kinds are numbers into ``KINDS``; spans are ordered by start, then kind. Without ``weights`` the models are trained on
    the samples of all documents. An empty table gives no rows.
    """
    scanned = scan(docs, id_col, text_col)
    if weights is None:
        scanned = materialise(scanned, "runs")
        weights = train(samples_of(scanned))
    more = F.filter(F.transform("long", lambda r: F.when(score(r["hit"], weights) >= 1000 * bits, F.struct(r["at"].alias("start"), F.lit(3).alias("kind"), (r["at"] + F.length(r["hit"])).alias("end")))), lambda s: s.isNotNull())
    return scanned.select("id", "base", F.array_sort(F.concat("base", more)).alias("found"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, weights: list[int] | None = None, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "*") -> DataFrame:
    """``docs`` with ``mark`` for every character of a secret; all rows, columns and lengths stay, a null text stays null."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)])
    at = docs.columns.index(text_col)
    found = find_secrets(docs.select(row.alias("row"), F.col(f"`{text_col}`").alias("t")), weights, id_col="row", text_col="t")
    text = F.col(f"id.c{at}")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("done"))

    def cleaned(t):
        def step(s, x):
            begin, end = F.greatest(x["start"], s["done"]), F.greatest(x["end"], s["done"])
            piece = F.array(F.substr(t, s["done"].cast("int") + 1, (begin - s["done"]).cast("int")), F.repeat(F.lit(mark), (end - begin).cast("int")))
            return F.struct(F.concat(s["out"], piece).alias("out"), end.alias("done"))

        return F.aggregate("found", start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(t, s["done"].cast("int") + 1)))

    clean = let(text, cleaned)
    return found.select(*[(F.when(F.size("found") > 0, clean).otherwise(text) if k == at else F.col(f"id.c{k}")).alias(c) for k, c in enumerate(docs.columns)])


def count_of(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    count = [count_of(kind).alias(f"n_{kind}") for kind in KINDS[:3]]
    return found.select(F.col("id").alias("doc_id"), *count, F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def brute_force(documents: list[tuple[object, str | None]], bits: int = BITS) -> list[tuple]:
    """The definition, for tests: (doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    assign, count, scanned = re.compile(ASSIGN), Counter(), []

    def learn(text: str, random: bool) -> None:
        for p, c in zip(["", *text], text, strict=False):
            count[random, p, c] += 1

    for doc, text in documents:
        text = text or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        covered = list(text)
        for a, _, b in base:
            covered[a:b] = " " * (b - a)
        for a, k, b in base:
            learn(assign.match(text, a)[2] if k == 0 else text[a:b], True)
        learn(base64.b64encode(hashlib.sha256(("" if doc is None else str(doc)).encode()).digest()).decode(), True)
        runs = [(m.start(), m[0]) for m in re.finditer(RUN, "".join(covered))]
        for _, r in runs:
            if not re.search(MIXED, r):
                learn(r, False)
        scanned.append((doc, sorted(base), runs))

    @functools.cache
    def share(random: bool, p: str, c: str) -> float:
        seen = {k: n for k, n in count.items() if k[0] == random}
        alone = (sum(n for k, n in seen.items() if k[2] == c) + 0.5) / (sum(seen.values()) + 0.5 * 68)
        return (seen.get((random, p, c), 0) + 8 * alone) / (sum(n for k, n in seen.items() if k[1] == p) + 8)

    def bits_of(text: str) -> int:
        return sum(math.floor(1000 * math.log2(share(True, p, c) / share(False, p, c)) + 0.5) for p, c in zip(["", *text], text, strict=False))

    out = []
    for doc, base, runs in scanned:
        more = [(a, 3, a + len(r)) for a, r in runs if len(r) >= RUN_CHARS and bits_of(r) >= 1000 * bits]
        said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        out.append((doc, *(sum(k == kind for _, k, _ in base) for kind in range(3)), hashlib.sha256(said(base).encode()).hexdigest(), said(base + more)))
    return out
