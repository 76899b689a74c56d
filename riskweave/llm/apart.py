"""Candidate pairs of set classes that share a signature but lie in different components (operators 5 and 7).

Rows are (sig, cls): a class of equal sets and a signature it has. ``facts`` has of each class its number of distinct
shingles and a parity bitmap: bit i is the parity of the shingles that hash to i. Two sets differ in at least as many
shingles as their bitmaps differ in bits, so sizes and bitmaps rule out pairs without a look at the sets, and never a
linked one. Joins apply that test to the pairs before they come out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.common import materialise

#: Words of a class's parity bitmap.
PARITY = 8
BITS = [f"p{k}" for k in range(PARITY)]
#: Of a class's rarest shingles, each row knows so many that come before its own.
BEFORE = 8


def may_link(x: str, y: str, threshold: float) -> Column:
    """Whether the structs ``x`` and ``y`` (n_shingles and bitmap) allow a Jaccard similarity of ``threshold``: such sets differ in at most (1 - t) / (1 + t) of the sum of their sizes."""
    n, m = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    return (F.least(n, m) >= F.greatest(n, m) * threshold - 1e-6) & (differ(x, y) * (1 + threshold) <= (n + m) * (1 - threshold) + 1e-6)


def differ(x: str, y: str) -> Column:
    """In how many bits the bitmaps of the structs ``x`` and ``y`` differ."""
    return sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in BITS), F.lit(0))


def sifted(pairs: DataFrame, facts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (hub, cls) that may link."""
    x, y = (facts.select(F.col("cls").alias(name), F.struct("n_shingles", *BITS).alias(to)) for name, to in (("hub", "x"), ("cls", "y")))
    return pairs.join(x, "hub").join(y, "cls").where(may_link("x", "y", threshold)).select("hub", "cls")


def mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, cls, component, low, components, hub, main, others, classes) of the signatures whose classes lie in different components: how many those are, the smallest, its first class, the component of most classes, how many classes are of others, and how many there are."""
    known = members.select("sig", "cls").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    known = known.repartition("sig")  # one shuffle for both sides of the join
    apart = known.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig", "low")
    found = materialise(known.join(apart, "sig").select("sig", "cls", "component", "low"), "mixed")
    each = found.groupBy("sig", "component").agg(F.min("cls").alias("least"), F.count("*").alias("n"))
    state = each.groupBy("sig").agg(F.count("*").alias("components"), F.min(F.struct("component", "least")).alias("first"), F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("all"))
    named = state.select("sig", "components", F.col("first.least").alias("hub"), F.col("most.component").alias("main"), (F.col("all") - F.col("most.n")).alias("others"), F.col("all").alias("classes"))
    return materialise(found.join(named, "sig"), "mixed")


def spokes(found: DataFrame) -> DataFrame:
    """Pairs (hub, cls) of ``mixed`` rows: each class with the first class of the smallest other component."""
    return found.where("component <> low").select(F.least("hub", "cls").alias("hub"), F.greatest("hub", "cls").alias("cls")).distinct()


def chained(found: DataFrame) -> DataFrame:
    """Pairs (hub, cls) of ``mixed`` rows: each class with the one that follows it in its signature, where that is of another component.

    The order is a hash of class and signature, so each signature of a class gives it other partners: in a group of near
    copies, of which some two in three are linked, nearly all come together by pairs as many as its rows, not their square.
    """
    following = F.lead(F.struct("cls", "component")).over(Window.partitionBy("sig").orderBy(F.xxhash64("sig", "cls")))
    near = found.select("cls", "component", following.alias("next")).where("next.component <> component")
    return near.select(F.least("cls", "next.cls").alias("hub"), F.greatest("cls", "next.cls").alias("cls")).distinct()


def paired(rows: DataFrame, key: str, facts: DataFrame, done: DataFrame, threshold: float) -> DataFrame:
    """The pairs (hub, cls) of ``meeting``."""
    return meeting(rows, key, facts, done, threshold).select("hub", "cls")


def meeting(rows: DataFrame, key: str, facts: DataFrame, done: DataFrame, threshold: float) -> DataFrame:
    """Pairs (hub, cls, apart, c1, c2) of ``rows`` (key, cls, component, main) that share a key, lie in different components and may link, without those in ``done``.

    c1 and c2 are their components, the smaller first. ``apart`` is how far their bitmaps differ, as a part of both sizes: the less, the likelier is a link.
    ``main`` is the component of most of a key's classes. Its classes are only looked up, never compared with one another:
    a key of n classes, m of them not of its main component, costs n m looks at two bitmaps.
    Rows may have what of their class comes ``before`` the key: a pair with one of that in common meets there too and comes
    out there (of rows of ``rarest``, which do not list all, at few keys more).
    """
    first = ["before"] if "before" in rows.columns else []
    rich = rows.join(facts, "cls").select(key, "cls", "component", "main", F.struct("n_shingles", *BITS, *first).alias("s"))
    x = rich.where("component <> main").select(F.col(key).alias("k1"), F.col("cls").alias("a"), F.col("component").alias("c1"), F.col("s").alias("x"))
    y = rich.select(F.col(key).alias("k2"), F.col("cls").alias("b"), F.col("component").alias("c2"), "main", F.col("s").alias("y"))
    once = (F.col("c2") == F.col("main")) | (F.col("a") < F.col("b"))
    meets = (F.col("k1") == F.col("k2")) & once & (F.col("c1") != F.col("c2")) & may_link("x", "y", threshold)
    if first:
        meets &= ~F.arrays_overlap("x.before", "y.before")
    apart = (differ("x", "y") / (F.col("x.n_shingles") + F.col("y.n_shingles"))).cast("float").alias("apart")
    joined = x.join(y, meets)
    return joined.select(F.least("a", "b").alias("hub"), F.greatest("a", "b").alias("cls"), apart, F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2")).distinct().join(done, ["hub", "cls"], "left_anti")


def likeliest(pairs: DataFrame) -> DataFrame:
    """Of ``meeting`` rows, the pair (hub, cls) least apart of each two components."""
    return pairs.groupBy("c1", "c2").agg(F.min(F.struct("apart", "hub", "cls")).alias("pair")).select("pair.hub", "pair.cls")


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (hub, cls) whose ends lie in different components."""
    c1 = labels.select(F.col("node").alias("hub"), F.col("component").alias("c1"))
    c2 = labels.select(F.col("node").alias("cls"), F.col("component").alias("c2"))
    found = pairs.select("hub", "cls").join(c1, "hub", "left").join(c2, "cls", "left")
    return found.where(F.coalesce("c1", "hub") != F.coalesce("c2", "cls")).select("hub", "cls")


def listed(rows: DataFrame) -> DataFrame:
    """``rows`` (sig, cls, ...) with the smaller signatures of a row's class among them, as ``before``; classes have few signatures."""
    return rows.withColumn("before", F.collect_list("sig").over(Window.partitionBy("cls").orderBy("sig").rowsBetween(Window.unboundedPreceding, -1)))


def rarest(shingled: DataFrame, short: DataFrame, threshold: float) -> DataFrame:
    """(shingle, cls, component, before, main) of the classes in ``short`` (cls, component): of each its rarest shingles among ``shingled`` (cls, shingle), which has the sets of just these.

    With shingles in one order of frequency, two sets of similarity t share one among each's first n - ceil(t n) + 1,
    so no pair of these classes is lost, and a passage that very many share seldom stands so far in front. Shingles of one
    class alone come first and are only counted. ``before`` has up to ``BEFORE`` shingles that come next before a row's own.
    """
    counted = shingled.join(shingled.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "shingle")
    ranked = counted.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))  # bounded by the document
    sizes = shingled.groupBy("cls").agg(F.count("*").alias("size"))
    alone = F.col("size") - F.size("all")
    front = F.greatest(F.col("size") - F.ceil(F.col("size") * threshold - 1e-6) + 1 - alone, F.lit(0)).cast("int")
    fronts = ranked.join(sizes, "cls").select("cls", F.slice("all.shingle", F.lit(1), front).alias("front"))
    each = fronts.select("cls", "front", F.posexplode("front").alias("at", "shingle"))
    before = F.slice("front", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least("at", F.lit(BEFORE)))
    found = each.select("cls", "shingle", before.alias("before")).join(short, "cls").select("shingle", "cls", "component", "before")
    main = found.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "component")).alias("most"))
    return found.join(main.select("shingle", F.col("most.component").alias("main")), "shingle")
