"""Line dedup (operator 5), native: fuzzy lines by MinHash.

Lines (between newlines) are compared in a normal form: lower case, runs of other than letters and digits as one
space. Equal forms, told by 124 bits of two hashes, are one line from the start. Unless it has few words, a form's character shingles for the signature start at its words
(the first ``ANCHOR`` characters from there on), are hashed, and the smallest ``SKETCH`` hashes are its sketch; every
run of ``ROWS`` neighbouring hashes of the sketch is a band key, so a pair of similarity 0.8 shares each of about
nine bands with probability one half. Lines of a bucket are first paired with its first line, then each with the
next of another component in an order that differs from bucket to bucket; sizes and parity bitmaps of the shingles rule out pairs that cannot reach the
threshold, the others are verified by the exact Jaccard similarity of all ``SHINGLE``-character shingles. Verified links are
united by distributed union-find. Buckets that still hold several components are exhausted, likeliest pairs first: directly if
few lines are outside the largest component, else by the rarest shingles of all their lines. The first line of a component, by document id and position, stays.
Forms of any length count; lines without letters and digits have an empty form and are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.apart import BITS, PARITY, between, chained, likeliest, listed, meeting, mixed, rarest, sifted
from riskweave.llm.common import components, discard, extended, marked, materialise, read, unused
from riskweave.llm.repeats import row_key

LEAST_CHARS = 1
SHINGLE = 5
THRESHOLD = 0.8
ANCHOR = 9
SKETCH = 11
ROWS = 3
#: Lines of fewer word starts than the first are sketched over all their shingles, of more than the second at word starts, others both ways.
FEW = (10, 13)
#: Buckets with more lines than this outside their largest component meet by their rarest shingles instead. Both ways find all pairs; a
#: line costs here as many looks at two bitmaps as lines are outside, there its shingles, which are hundreds of rows.
REFINE_OVER = 4096


def normal_form(text: Column) -> Column:
    """Lower case, runs of other than letters and digits as one space; lines stay lines. The pattern asks for a character's class only where it is none of the listed ones."""
    return F.regexp_replace(F.lower(text), r"[[^abcdefghijklmnopqrstuvwxyz0123456789\n]&&[^\p{L}\p{N}]]+", " ")


def _smallest(shingles: Column) -> Column:
    return F.slice(F.sort_array(F.array_distinct(F.transform(shingles, lambda w: F.xxhash64(w)))), 1, SKETCH)


def _keys(forms: DataFrame) -> DataFrame:
    """(cls, sig) from (cls, form): band keys, from the shingles at word starts where there are ``FEW[0]`` or more, from all shingles where there are ``FEW[1]`` or fewer; between, from both."""
    starts = F.regexp_extract_all(F.concat(F.lit(" "), F.col("form")), F.lit(f"(?s) (?=(.{{1,{ANCHOR}}}))"), F.lit(1))
    none = F.array().cast("array<bigint>")
    found = forms.select("cls", "form", starts.alias("starts"))
    some = F.when(F.size("starts") >= FEW[0], _smallest(F.col("starts"))).otherwise(none)
    every = F.when(F.size("starts") <= FEW[1], _smallest(_grams(F.col("form")))).otherwise(none)
    sketched = found.select("cls", some.alias("some"), every.alias("every"))
    return sketched.select("cls", F.explode(F.concat(_bands(F.col("some")), _bands(F.col("every")))).alias("sig"))


def _bands(sketch: Column) -> Column:
    """Hashes of neighbouring runs of the sketch; of a short sketch, one hash of all of it and of each with one left out."""
    n = F.size(sketch)
    none = F.array().cast("array<bigint>")
    run = lambda i: F.xxhash64(*[F.get(sketch, F.lit(i + k)) for k in range(ROWS)])
    runs = F.slice(F.array(*[run(i) for i in range(SKETCH - ROWS + 1)]), F.lit(1), F.greatest(n - ROWS + 1, F.lit(0)))
    whole = F.array(F.xxhash64(F.lit("short"), sketch))
    less = F.transform(sketch, lambda x: F.xxhash64(F.lit("short"), F.array_remove(sketch, x)))
    return F.concat(F.when(n > 2 * ROWS, runs).otherwise(none), F.when((n > 0) & (n <= 2 * ROWS + 1), F.concat(whole, less)).otherwise(none))


def _grams(form: Column) -> Column:
    """All character shingles; the lookahead finds overlapping ones in one pass over the text."""
    return F.regexp_extract_all(form, F.lit(f"(?s)(?=(.{{{SHINGLE}}}))"), F.lit(1))


def _shingles(form: Column) -> Column:
    return F.array_distinct(_grams(form))


def _shared(a: Column, b: Column) -> Column:
    """How many distinct character shingles two forms have in common."""
    return F.size(F.array_intersect(_grams(a), _grams(b)))


def _lines(docs: DataFrame, key: Column, text_col: str, least_chars: int) -> DataFrame:
    """(rid, at, form): the normal forms of every row's lines, but for forms under ``least_chars`` characters. A text is folded in one pass."""
    folded = normal_form(F.col(f"`{text_col}`").cast("string"))
    lines = docs.select(key.alias("rid"), F.posexplode(F.split(folded, "\n")).alias("at", "raw")).select("rid", "at", F.trim("raw").alias("form"))
    return lines.where(F.length("form") >= max(1, least_chars))


def _verify(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The pairs (hub, cls) of lines whose shingles' Jaccard similarity reaches the threshold, as (a, b)."""
    ends = pairs.select(F.explode(F.array("hub", "cls")).alias("line"))
    known = marked(known, "line", ends).where("marked")
    left = known.select(F.col("line").alias("hub"), F.col("form").alias("fa"), F.col("n_shingles").alias("na"))
    right = known.select(F.col("line").alias("cls"), F.col("form").alias("fb"), F.col("n_shingles").alias("nb"))
    counted = pairs.join(left, "hub").join(right, "cls").select(F.col("hub").alias("a"), F.col("cls").alias("b"), _shared(F.col("fa"), F.col("fb")).alias("both"), (F.col("na") + F.col("nb")).alias("sum"))
    return materialise(counted.where(F.col("both") * (1 + threshold) >= F.col("sum") * threshold - 1e-9).select("a", "b"), "links")


def _facts(lines: DataFrame, forms: DataFrame) -> DataFrame:
    """(cls, form, n_shingles, parity bitmap) of the lines in ``lines`` (cls). Both sides of the last join read one shuffle of the forms."""
    own = marked(forms, "cls", lines).where("marked").select("cls", "form").join(lines.distinct(), "cls")
    each = own.select("cls", F.explode(_shingles(F.col("form"))).alias("shingle")).select("cls", F.xxhash64("shingle").alias("h"))
    one = lambda k: F.when(F.pmod(F.col("h"), F.lit(PARITY)) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.shiftright("h", 16).bitwiseAND(F.lit(63))).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    found = each.groupBy("cls").agg(F.count("*").alias("n_shingles"), *(F.bit_xor(one(k)).alias(b) for k, b in enumerate(BITS)))
    return materialise(own.join(found, "cls"), "facts")


def _links(shared: DataFrame, forms: DataFrame, threshold: float) -> DataFrame:
    """(node, component) of the lines that are linked with others; ``shared`` has (sig, cls, hub): a bucket, one of its lines and its first line. It comes from ``materialise``; its table goes. ``forms`` has (cls, form)."""
    every = _facts(shared.select("cls"), forms)
    facts, known = every.drop("form"), every.select(F.col("cls").alias("line"), "form", "n_shingles")
    stars = materialise(sifted(shared.where("cls <> hub").select("hub", "cls").distinct(), facts, threshold), "stars")
    links = _verify(stars, known, threshold)
    labels = components(links)
    left = mixed(shared, labels)
    scrap = [shared, every, stars, links, left]
    left = left.where("classes > 2")  # the one pair of two lines was a star
    second = materialise(sifted(chained(left), facts, threshold).join(stars, ["hub", "cls"], "left_anti"), "chains")
    done = stars
    scrap.append(second)
    if not second.isEmpty():
        scrap.append(_verify(second, known, threshold))
        labels = extended(labels, scrap[-1])
        left, done = mixed(left, labels), stars.unionByName(second)
        scrap.append(left)
    hot = F.col("others") > REFINE_OVER
    few = meeting(listed(left.where(~hot)), "sig", facts, done, threshold)
    short = materialise(left.where(hot).select("cls", "component").distinct(), "short")
    rare = few.limit(0)
    if not short.isEmpty():
        forms = known.withColumnRenamed("line", "cls").join(short, "cls")
        shingled = materialise(forms.select("cls", F.explode(_shingles(F.col("form"))).alias("s")).select("cls", F.xxhash64("s").alias("shingle")), "shingles")
        rare = meeting(rarest(shingled, short, threshold), "shingle", facts, done, threshold)
        scrap.append(shingled)
    more = materialise(few.unionByName(rare).distinct(), "pairs")
    scrap += [short, more]
    if not more.isEmpty():  # one pair of each two components first; what that does not unite, all at once
        single = materialise(likeliest(more), "pairs")
        scrap += [single, _verify(single, known, threshold)]
        labels = extended(labels, scrap[-1])
        rest = materialise(between(more, labels).join(single, ["hub", "cls"], "left_anti"), "pairs")
        scrap.append(rest)
        if not rest.isEmpty():
            scrap.append(_verify(rest, known, threshold))
            labels = extended(labels, scrap[-1])
    for table in scrap:  # the labels read none of these: components and extended end with tables of their own
        discard(table)
    return labels


def _check(form: Column) -> Column:
    """60 bits of a form's SHA-256."""
    return F.conv(F.substring(F.sha2(form.cast("binary"), 256), 1, 15), 16, 10).cast("bigint")


def _counted(raw: DataFrame) -> DataFrame:
    """(line, first_id, copies, low, high) from (rid, at, line, form): low and high differ where several forms share a number."""
    rows = raw.select("rid", "line", _check(F.col("form")).alias("check"))
    return rows.groupBy("line").agg(F.min("rid").alias("first_id"), F.count("*").alias("copies"), F.min("check").alias("low"), F.max("check").alias("high"))


def line_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(line, component, first_id, copies) of every distinct normal form, and (rid, at, line) of every line.

    Forms are one line where a 64-bit hash and 60 bits of SHA-256 agree; ``line`` is the former, mixed with the latter where
    forms share it. So texts of lines that stand once are not shuffled. first_id is the smallest row key that has the form
    (the id where ids are unique whole numbers, else a hash of id and text), copies how often it stands. Null texts have no lines.
    """
    key, _ = row_key(docs, id_col, text_col)
    raw = materialise(_lines(docs, key, text_col, least_chars).withColumn("line", F.xxhash64("form")), "lines")
    distinct = materialise(_counted(raw), "counts")
    clash = [r["line"] for r in distinct.where("low <> high").select("line").collect()]  # n**2 / 2**65 of n forms are expected
    if clash:
        scrap = [raw, distinct]
        raw = materialise(raw.withColumn("line", F.when(F.col("line").isin(clash), F.xxhash64("line", _check(F.col("form")))).otherwise(F.col("line"))), "lines")
        distinct = materialise(_counted(raw), "counts")
        for table in scrap:
            discard(table)
    parted = marked(raw.select(F.col("line").alias("cls"), "form"), "cls", distinct.where("copies > 1").select(F.col("line").alias("cls")))
    several = materialise(parted.where("marked").select("cls", "form").distinct(), "several")
    forms = parted.where("not marked").select("cls", "form").unionByName(several)

    bucket = Window.partitionBy("sig")
    shared = _keys(forms).select("sig", "cls", F.min("cls").over(bucket).alias("hub"), F.max("cls").over(bucket).alias("last")).where("hub <> last").drop("last")
    labels = _links(materialise(shared, "buckets"), forms, threshold)
    lines = materialise(raw.select("rid", "at", "line"), "lines")
    discard(raw)
    discard(several)
    found = distinct.drop("low", "high").join(labels.withColumnRenamed("node", "line"), "line", "left").withColumn("component", F.coalesce("component", "line"))
    found = materialise(found, "groups")
    discard(distinct)
    return found, lines


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, threshold: float = THRESHOLD, count: str | None = None) -> DataFrame:
    """``docs`` with one line of each component left: in the document of the smallest row key that has one, the first such line.

    ``count`` names a column to add with the number of lines that went. Lines without a form stay, order and columns too
    (``n_chars`` is renewed where there is one). Null texts stay null; a text may become empty, its row stays. Where
    ids repeat or are null, rows are told apart by a hash of id and text; rows alike in both keep the same lines.
    """
    key, _ = row_key(docs, id_col, text_col)
    groups, lines = line_groups(docs, id_col=id_col, text_col=text_col, least_chars=least_chars, threshold=threshold)
    owner = groups.groupBy("component").agg(F.min("first_id").alias("owner"), F.sum("copies").alias("all")).where("all > 1").select("component", "owner")
    repeated = groups.join(owner, "component").select("line", "component", "owner")
    text = F.col(f"`{text_col}`").cast("string")
    # everything of a row's lines of one component but the first in the owner goes
    mine = lines.join(repeated, "line").groupBy("rid", "component", "owner").agg(F.array_sort(F.collect_set("at")).alias("places"))  # bounded by the document
    extra = mine.select("rid", F.when(F.col("rid") == F.col("owner"), F.slice("places", 2, 1 << 30)).otherwise(F.col("places")).alias("places")).where(F.size("places") > 0)
    rid, gone = unused(docs, "rid"), unused(docs, "gone")
    removed = materialise(extra.groupBy("rid").agg(F.flatten(F.collect_list("places")).alias(gone)).withColumnRenamed("rid", rid), "removed")
    parted = marked(docs.withColumn(rid, key), rid, removed)  # texts that lose nothing stay where they are
    flag = parted.columns[-1]
    touched = parted.where(F.col(flag)).drop(flag).join(removed, rid, "left")
    none = F.lit(None).cast(removed.schema[gone].dataType)
    joined = parted.where(~F.col(flag)).drop(flag).withColumn(gone, none).unionByName(touched)
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(gone, i)), "\n")
    clean = F.when(F.col(gone).isNull(), text).otherwise(kept)
    value = {c: F.col(f"`{c}`") for c in docs.columns} | {text_col: clean}
    if "n_chars" in value:
        value["n_chars"] = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length(clean).cast("bigint"))
    added = [F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(count)] if count else []
    return joined.select(*[value[c].alias(c) for c in docs.columns], *added)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256): what line dedup leaves of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint")
    done = dedup_lines(docs.select("doc_id", "text", lines.alias("n_lines")), count="n_removed")
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
