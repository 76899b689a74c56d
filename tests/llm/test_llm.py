"""Training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows and clashing columns."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import apart, common, decontaminate, fingerprint, line_dedup, lm, mixing, ngram_join, rlz, suffix_dedup, toxicity, urls
from riskweave.llm.common import components
from riskweave.llm.repeats import _match as match

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice("abcdefghijk") for _ in range(2 + rng.randrange(5))) + (" é" if rng.random() < 0.05 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    texts = [prose(rng, rng.choice([0, 1, 4, 5, 30, 120, 300])) for _ in range(40)]
    passage = prose(rng, 60)
    texts += [texts[-1], texts[-1], texts[5] + " " + passage, passage, prose(rng, 20) + "\n" + passage + "\n" + passage]
    words = texts[6].split() or ["x"]
    texts.append(" ".join(w if rng.random() > 0.01 else "edit" for w in words))
    texts += ["", " \n\t", "one", "A b C", "y" * 5000]
    docs = [(i, t, "en", "s" if i % 3 else "hot", len(t)) for i, t in enumerate(texts)]
    return docs + [(len(docs), None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("rid", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("key", F.lit(2)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(rows):
    return [(r[0], r[1]) for r in rows]


def test_toxicity_learns_and_scores_everything(spark, docs, empty):
    rng = random.Random(1)
    made = []
    for i in range(300):
        bad = i % 4 == 0
        made.append((i, ". ".join(prose(rng, 8) + (" vilely" if bad and k == 3 else "") for k in range(6)), int(bad)))
    frame = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    got = {r["id"]: r for r in toxicity.score(frame, model).collect()}
    assert all((got[i]["score"] >= 0.7) == bool(y) for i, _, y in made)
    assert all(got[i]["worst_sentence"] == 3 for i, _, y in made if y)
    assert toxicity.offending(made[0][1], model)[0][0].endswith("vilely")
    assert toxicity.reject_toxic(frame, model).count() == sum(1 - y for *_, y in made)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int")).weights == {}


def test_fingerprints(spark, rows, docs, empty):
    got = {r["id"]: r for r in fingerprint.verified(fingerprint.with_next(docs, rows=7)).collect()}
    texts = [t or "" for _, t in plain(rows)]
    assert len(got) == len(rows)
    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        import hashlib

        assert got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k]["digest"] == fingerprint.digest(fingerprint.canonical(t))
        assert got[k]["equals_next"] == (fingerprint.canonical(t) == fingerprint.canonical(after))
        assert got[k]["collision"] is None
    assert fingerprint.canonical("A  ﬁ") == fingerprint.canonical(" a fi ")
    assert fingerprint.with_next(empty).count() == 0
    one = fingerprint.with_next(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["equals_next"]


def test_mixed_buckets_are_numbered(spark):
    found = spark.createDataFrame([(1, "d", b"x"), (2, "d", b"y"), (3, "d", b"x"), (4, "e", None)], "id long, digest string, form binary")
    assert {r["id"]: r["collision"] for r in fingerprint.verified(found).collect()} == {1: 1, 2: 2, 3: 1, 4: None}


@pytest.mark.parametrize("limit", [1 << 30, 300])
def test_decontamination(spark, rows, docs, empty, limit):
    items = [(1, rows[5][1]), (2, " ".join((rows[6][1] or "q").split()[3:20])), (3, "one"), (4, None), (5, "..."), (10, rows[42][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs, bench, shard_words=500, max_benchmark_bytes=limit)
    got = {r["id"]: (r["n_words"], r["n_hit"], sorted(r["items"])) for r in got.collect()}
    for doc, words, hit, count, _ in decontaminate.brute_force(plain(rows), items):
        assert got[doc][:2] == (words, hit) and len(got[doc][2]) == count
    clean = decontaminate.remove_contamination(docs, bench, max_benchmark_bytes=limit)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 400)
    index = decontaminate.FMIndex(text)
    for size in (1, 2, 4):
        for pattern in rng.integers(1, 6, (20, size)):
            low, high = index.search(pattern[None, :])
            places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
            assert places == [k for k in range(len(text) - size + 1) if (text[k : k + size] == pattern).all()]


@pytest.mark.parametrize("module", [suffix_dedup, rlz])
def test_repeats(spark, rows, docs, empty, module):
    got = {r[0]: tuple(r) for r in module.repeats(docs).collect()}
    assert [got[i] for i, _ in plain(rows)] == module.brute_force(plain(rows))
    assert module.repeats(empty).count() == 0
    again = docs.where("doc_id = 44").unionByName(docs.where("doc_id = 44"))
    assert len(set(map(tuple, module.repeats(again).collect()))) == 1  # the same row twice is one document


def test_matchers_end_with_their_keys():
    made = []

    class Spy(rlz.RelativeParse):
        def __init__(self):
            super().__init__(window=3)
            made.append(self)

    tiles = [(key, 10 * key + row, row, f"{key}a {key}b {key}c {own}".encode()) for key in range(30) for row, own in enumerate(("x", "x", f"{key}y"))]
    key, rid, first, tile = zip(*tiles, strict=True)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + 7]) for c in (key, rid, first, tile)], names=["key", "rid", "first", "tile"]) for a in range(0, len(tiles), 7)]
    found = {tuple(r.values()) for b in match(Spy, 60)(batches) for r in b.to_pylist()}
    wanted = {(10 * k + row, row, row + n) for k in range(30) for row, n in ((0, 4), (1, 4), (2, 3))}
    assert found == wanted
    assert len(made) > 5 and max(sum(len(b.text) for b in m.blocks) for m in made) < 40  # one matcher held all keys before


def test_suffix_levels_merge():
    rng = random.Random(5)
    tiles = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(64)]
    family = suffix_dedup.SuffixFamily(length=12)
    for t in tiles:
        family.add([t])
    assert set(family.levels) == {6}
    seen = {}
    for t in tiles:
        for k in range(19):
            seen[t[k : k + 12]] = seen.get(t[k : k + 12], 0) + 1
    for t, (_, runs) in zip(tiles, family.marked(), strict=True):
        covered = {x for a, b in runs for x in range(a, b)}
        assert covered == {x for k in range(19) if seen[t[k : k + 12]] > 1 for x in range(k, k + 12)}


def test_similar_groups(spark, rows, docs, empty):
    found, _ = ngram_join.similar_groups(docs)
    got = {r["id"]: (r["id"], r["n_shingles"], r["component_id"]) for r in found.collect()}
    assert [got[i] for i, _ in plain(rows)] == ngram_join.brute_force(plain(rows))
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, n, c in got.values() if i == c}
    assert ngram_join.similar_groups(empty)[0].count() == 0


def test_texts_that_stay_are_not_shuffled_by_the_join(spark):
    rng = random.Random(23)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:5])), "doc_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = ngram_join.keep_one(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in kept.collect()) == list(range(40))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftSemi" not in plan and "LeftAnti" in plan and "Union" in plan  # before, all texts were joined with the ids that stay
    again = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (2, texts[0]), (3, texts[1]), (None, texts[2])], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in ngram_join.keep_one(again).collect()) == [0, 1, 3]


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(11)
    for n in [1, 2, 4, 5, 6, 8, 9, 12, 20, 45, 90, 240]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            drop = int(rng.integers(0, max(1, n // 5) + 1))
            b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 8) + 1)), dtype=np.uint64)]))
            if len(b) and ngram_join.linked(a, b):
                row, sig = ngram_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
                assert set(sig[row == 0]) & set(sig[row == 1]), (n, len(b))


def test_lines(spark, docs, empty):
    rng = random.Random(9)
    line = prose(rng, 25)
    near = line.replace(line.split()[12], "zz", 1)
    frame = spark.createDataFrame([(1, f"{line}\nshort\n{line}", 0), (2, f"keep\n{near}", 0), (3, None, None), (4, prose(rng, 30), 0), (5, "", 0)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame).collect()}
    assert got[1] == f"{line}\nshort" and got[2] == "keep" and got[3] is None and got[5] == ""
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_pairs_come_out_at_their_first_common_shingle(spark):
    rng = random.Random(17)
    sets = {}
    for g in range(12):
        core = [rng.randrange(4000) for _ in range(60)]
        for k in range(6):
            sets[10 * g + k] = set(core) ^ {rng.randrange(4000) for _ in range(rng.randrange(14))}
    shingled = spark.createDataFrame([(c, s) for c, x in sets.items() for s in x], "cls long, shingle long")
    short = spark.createDataFrame([(c, c) for c in sets], "cls long, component long")
    rows = apart.rarest(shingled, short, 0.8).cache()
    x, y = (rows.select("shingle", F.col("cls").alias(c), F.col("before").alias(f"b{c}")) for c in "xy")
    meet = x.join(y, "shingle").where("x < y")
    met = {(r["x"], r["y"]) for r in meet.collect()}
    out = [(r["x"], r["y"]) for r in meet.where("not arrays_overlap(bx, by)").collect()]
    assert set(out) == met and len(out) < 1.2 * len(met) < 0.5 * meet.count()  # each pair came out at every common shingle before
    one = {b: F.lit(0).cast("long").alias(b) for b in apart.BITS}
    facts = shingled.groupBy("cls").agg(F.count("*").alias("n_shingles")).select("cls", "n_shingles", *one.values())
    got = {tuple(r) for r in apart.paired(rows, "shingle", facts, short.limit(0).selectExpr("cls as hub", "cls"), 0.8).collect()}
    linked = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(linked) > 50 and linked <= got


def test_a_group_of_near_copies_needs_few_pairs(spark, monkeypatch):
    rng = random.Random(29)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    base = [word() for _ in range(60)]
    lines = []
    for _ in range(240):
        copy = list(base)
        for k in rng.sample(range(60), rng.choice([2, 3, 4, 6])):
            copy[k] = word()
        lines.append(" ".join(copy))
    seen = []
    verify = line_dedup._verify
    monkeypatch.setattr(line_dedup, "_verify", lambda pairs, *rest: seen.append(pairs.count()) or verify(pairs, *rest))
    groups, found = line_dedup.line_groups(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    of = {r["rid"]: r["component"] for r in found.join(groups, "line").collect()}
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in lines]
    links = [(a, b) for a in range(240) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert 2000 < len(links) < 27000 and all(of[a] == of[b] for a, b in links)
    assert sum(seen) < 1600, seen  # 2,068 where lines only met the first line of a bucket and of its smallest other component


def test_components_grow_and_end_with_stars(spark, monkeypatch):
    rng = random.Random(23)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    first, more = (spark.createDataFrame(e, "a long, b long") for e in (edges[:150], edges[150:]))
    whole = {tuple(r) for r in components(first.unionByName(more)).collect()}
    assert {tuple(r) for r in common.extended(components(first), more).collect()} == whole
    tables = []
    table = common.materialise
    monkeypatch.setattr(common, "materialise", lambda df, name: tables.append(name) or table(df, name))
    stars = {tuple(r) for r in components(spark.createDataFrame([(9, 1), (8, 1), (7, 2)], "a long, b long")).collect()}
    assert stars == {(9, 1), (8, 1), (1, 1), (7, 2), (2, 2)} and len(tables) == 2  # three before: a round to see that nothing changed


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (7, 7), (None, 3)] + [(200, k) for k in range(201, 230)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(1, 41)) and got[101] == 100 and got[229] == 200


def test_urls(spark):
    pages = [
        (1, "http://a.com/x", ""), (2, "https://www.example.com/en/1", None), (3, "https://EXAMPLE.com/en/?q", ""), (4, None, ""), (5, "nothing", "<a href='http://s.net/fr/1'>"),
        (6, "http://s.net/fr/1", ""), (7, "http://s.net/fr/2", ""), (8, "http://t.org/", '<a href="http://s.net/fr/1"><a href=http://s.net/es/>'), (9, "http://s.net/en/1", ""), (9, "http://a.com", ""),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(map(str, (tuple(r)[:5] for r in urls.filter_urls(frame).collect())))
    assert got == sorted(map(str, urls.brute_force(pages)))
    assert urls.filter_urls(frame.where("false")).count() == 0


def test_mixing(spark, docs, empty):
    rng = random.Random(2)
    made = [(i, " ".join(["w"] * rng.randrange(1, 40)), "big" if i % 10 else f"s{i % 50}") for i in range(600)]
    frame = spark.createDataFrame(made, "doc_id long, text string, source string")
    tokens = {s: sum(len(t.split()) for _, t, x in made if x == s) for s in {x for *_, x in made}}
    total = sum(tokens.values())
    drawn = mixing.mix(frame, block_tokens=50, entropy_share=0.9, repetition_limit=2.0).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("epoch").alias("e")).collect()
    share = {r["source"]: r["n"] / total for r in drawn}
    entropy = -sum(p * math.log(p) for p in share.values())
    assert abs(entropy - 0.9 * math.log(len(tokens))) < 0.05 or any(share[s] * total > 1.8 * tokens[s] for s in tokens)
    assert all(share[s] * total <= 2.001 * tokens[s] for s in tokens)
    whole = mixing.mix(frame, entropy_share=None, repetition_limit=None)
    assert whole.count() == 600 and whole.where("epoch > 0").count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs).count() > 0


def test_language_model(spark, rows, docs, empty):
    rng = random.Random(4)
    made = [(i, " ".join(rng.choice([["the", "cat", "sat"], ["a", "dog", "ran"]])[k] for _ in range(20) for k in range(3))) for i in range(60)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    language, counts = lm.train(frame.select("text"), keep_grams=True)
    got = lm.score(frame, language, counts).collect()
    assert sum(r["score"] for r in got) > 0.6 * sum(r["base_score"] for r in got)  # logs: nearer to 0
    auto = language.automaton
    words = list(range(1, len(auto.words) + 1))
    c = {r["token"]: r["c"] for r in counts.collect()}
    base = [math.log10((c[w] + lm.ALPHA) / language.scale) for w in auto.words.tolist()]
    for first in words:  # each history's probabilities sum to one, with what is left for unknown tokens
        state = auto.after[first]
        total = 0.0
        for w in words:
            auto.start = state
            total += 10 ** auto.score([w], [base[w - 1]])
        auto.start = state
        total += 10 ** auto.score([-1], [math.log10(lm.ALPHA / language.scale)])
        assert abs(total - 1) < 1e-9
    language, counts = lm.train(docs.select("text"))
    assert lm.score(docs, language, counts).count() == docs.count()
    language, counts = lm.train(empty.select("text"))
    assert lm.score(empty, language, counts).count() == 0
    assert lm.score(docs, language, counts).count() == docs.count()


def test_the_query_scores_with_triples(spark, tmp_path):
    rng = random.Random(31)
    made = [(i, " ".join(rng.choice(["a b c", "x b d"]) for _ in range(40))) for i in range(60)]  # what follows b hangs on what came before it
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = {k: {} for k in (1, 2, 3)}
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in made}
    for i, t in made:
        w = ["<s>", *t.split(), "</s>"]
        for k in seen if fold[i] else ():
            for j in range(k == 1, len(w) - k + 1):
                seen[k][tuple(w[j : j + k])] = seen[k].get(tuple(w[j : j + k]), 0) + 1
    n, v = sum(seen[1].values()), len(seen[1])
    arcs = {k: {g: c for g, c in seen[k].items() if c > 1} for k in (2, 3)}
    seen[1]["<s>",] = sum(f != 0 for f in fold.values())

    def p(gram):
        if len(gram) == 1:
            return (seen[1].get(gram, 0) + 0.1) / (n + 0.1 * (v + 1))
        hist = gram[:-1]
        if gram in arcs[len(gram)]:
            return (arcs[len(gram)][gram] - 0.5) / seen[len(hist)][hist]
        out = [g for g in arcs[len(gram)] if g[:-1] == hist]
        return p(gram[1:]) * ((1 - sum(p(g) for g in out)) / (1 - sum(p(g[1:]) for g in out)) if out else 1)

    for r in lm.query(spark, str(tmp_path)).collect():
        w = ["<s>", *made[r["doc_id"]][1].split(), "</s>"]
        grams = [tuple(w[max(0, j - 2) : j + 1]) for j in range(1, len(w))]
        assert abs(r["base_score"] - sum(math.log10(p(g[-1:])) for g in grams)) < 1e-9
        assert abs(r["score"] - sum(math.log10(p(g)) for g in grams)) < 1e-6


@pytest.mark.parametrize("longest", [2, 3])
def test_language_model_keeps_every_ngram_that_occurs_twice(spark, longest):
    rng = random.Random(12)
    made = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(0, 60)))) for i in range(400)]
    made += [(1000 + i, "common words " * 2000) for i in range(110)]  # over 400,000 tokens, so a share of 1 / 200,000 would ask for three
    made += [(2000 + i, f"seldom seen phrase {i}") for i in range(2)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    language, counts = lm.train(frame.select("text"), order=longest, keep_grams=True)
    auto = language.automaton
    for order in range(2, longest + 1):
        seen = {}
        for _, t in made:
            w = ["<s>", *t.split(), "</s>"]
            for k in range(len(w) - order + 1):
                seen[tuple(w[k : k + order])] = seen.get(tuple(w[k : k + order]), 0) + 1
        table = language._parts[order - 1]
        assert sorted(r["c"] for r in table.collect()) == sorted(n for n in seen.values() if n > 1)
    whole, dealt = ({tuple(r) for r in lm.gram_counts(frame.select("text"), 2, size, longest).collect()} for size in (1 << 30, 100_000))
    assert whole == dealt  # counted in one block and in many
    probe = spark.createDataFrame(made[:50] + made[-2:] + [(9000, "seldom seen unheard of phrase"), (9001, None)], "doc_id long, text string")
    c = {r["token"]: r["c"] for r in counts.collect()}
    ids = {w: k + 1 for k, w in enumerate(auto.words.tolist())}
    for block_bytes in (1 << 20, 500):  # in one block and in many, scores are those of the whole automaton
        for r in lm.score(probe, language, counts, block_bytes=block_bytes).join(probe.withColumnRenamed("doc_id", "id"), "id").collect():
            raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
            h = lm.tokens(raw, np.array([0]), np.array([len(raw)]), lm.Powers())[0].tolist()
            base = [math.log10((c.get(x, 0) + lm.ALPHA) / language.scale) for x in h]
            assert abs(r["base_score"] - sum(base)) < 1e-9 and r["n_tokens"] == len(h) and r["n_known"] == sum(x in c for x in h)
            assert abs(r["score"] - auto.score([ids.get(x, -1) for x in h], base)) < 1e-9


def test_texts_are_read_once_and_never_shuffled_for_the_language_model(spark, monkeypatch):
    rng = random.Random(17)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(50))) for i in range(300)], "doc_id long, text string")
    plan = lm.gram_counts(docs.select("text"), 2, 3000)._jdf.queryExecution().toString()
    assert "text#" not in plan  # before, texts were dealt anew for each step
    language, counts = lm.train(docs.select("text"))
    scored = lm.score(docs, language, counts, block_bytes=3000)
    assert "text#" not in scored._jdf.queryExecution().toString()
    monkeypatch.setattr(lm, "ROUNDS", 1)
    for a, b in zip(scored.orderBy("id").collect(), lm.score(docs, language, counts).orderBy("id").collect(), strict=True):
        assert a[:3] == b[:3] and abs(a["base_score"] - b["base_score"]) < 1e-9 and abs(a["score"] - b["score"]) < 1e-9


def test_only_wanted_rows_are_marked(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("if(id = 9, null, id) as k", "id as marked")
    wanted = spark.range(0, 4000, 10).selectExpr("if(id = 0, null, id) as k")
    got = common.marked(rows, "k", wanted)
    assert got.columns == ["k", "marked", "marked_"] and got.count() == 4000
    assert {r["k"] for r in got.where("marked_").collect()} == set(range(10, 4000, 10))  # of 33 million bits, these need no other's
    monkeypatch.setattr(common, "MARKS", 2)
    assert {r["k"] for r in common.marked(rows, "k", wanted).where("marked_").collect()} >= set(range(10, 4000, 10))


@pytest.mark.parametrize("marks", [1, 1 << 19])
def test_lines_that_stand_once_are_not_shuffled(spark, monkeypatch, marks):
    rng = random.Random(41)
    monkeypatch.setattr(common, "MARKS", marks)  # one word marks nearly all rows; the result is the same
    lines = [prose(rng, 25) for _ in range(60)]
    texts = ["\n".join(rng.choice(lines[:20]) for _ in range(3)) + "\n" + x for x in lines[20:]]
    seen = []
    table = line_dedup.materialise
    monkeypatch.setattr(line_dedup, "materialise", lambda df, name: seen.append((name, table(df, name))) or seen[-1][1])
    monkeypatch.setattr(line_dedup, "discard", lambda df: None)
    groups, found = line_dedup.line_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    copies = {}
    for t in texts:
        for x in t.split("\n"):
            copies[x] = copies.get(x, 0) + 1
    assert sorted(r["copies"] for r in groups.collect()) == sorted(copies.values()) and found.count() == sum(copies.values())
    if marks > 1:  # before, all forms were grouped as texts
        assert {name: df.count() for name, df in seen}["several"] == sum(n > 1 for n in copies.values()) < len(copies) - 30


def test_forms_that_share_a_number_are_found(spark):
    raw = spark.createDataFrame([(1, 0, 7, "a b"), (2, 0, 7, "a c"), (3, 0, 8, "a d"), (1, 1, 8, "a d")], "rid long, at int, line long, form string")
    got = {r["line"]: r for r in line_dedup._counted(raw).collect()}
    assert got[7]["low"] < got[7]["high"] and got[8]["low"] == got[8]["high"] and (got[8]["first_id"], got[8]["copies"]) == (1, 2)


def test_lines_with_a_passage_in_common(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3 + rng.randrange(6)))
    passage = [word() for _ in range(30)]
    made = []
    for k in range(700):
        own = [word() for _ in range(10)]
        made.append((2 * k, " ".join(passage + own)))
        own[rng.randrange(10)] = word()
        made.append((2 * k + 1, " ".join(passage + own)))
    frame = spark.createDataFrame(made, "doc_id long, text string")
    groups, lines = line_dedup.line_groups(frame)
    found = {r["rid"]: r["component"] for r in lines.join(groups, "line").collect()}
    joined = sum(found[2 * k] == found[2 * k + 1] for k in range(700))
    assert joined >= 0.985 * 700 and len(set(found.values())) > 650


def test_short_lines(spark):
    frame = spark.createDataFrame([(1, "Read more\n---\nyes\nRead more"), (2, "read more!\n---\nno\nyes")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame).collect()}
    assert got == {1: "Read more\n---\nyes", 2: "---\nno"}


def test_lines_of_few_words(spark):
    rng = random.Random(5)
    made = []
    for k in range(100):  # unspaced, one of the first characters changed; of four long words, one typo
        line = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(80))
        words = "".join(rng.choice("abcdefghijklmnop") if (x + 1) % 16 else " " for x in range(63))
        made += [(4 * k, line), (4 * k + 1, line[:4] + "\u3400" + line[5:]), (4 * k + 2, words), (4 * k + 3, words[:33] + "z" + words[34:])]
    groups, lines = line_dedup.line_groups(spark.createDataFrame(made, "doc_id long, text string"))
    found = {r["rid"]: r["component"] for r in lines.join(groups, "line").collect()}
    assert sum(found[2 * k] == found[2 * k + 1] for k in range(200)) >= 196


def test_propagation_on_a_cycle_reaches_its_fixed_point(spark):
    seeds = spark.createDataFrame([("a", 1.0)], "host string, seed double")
    links = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    got = {r["host"]: r["r"] for r in urls.propagate(seeds, links, damping=0.5).collect()}
    assert abs(got["a"] - 4 / 3) < 1e-5 and abs(got["b"] - 2 / 3) < 1e-5
    with pytest.raises(RuntimeError):
        urls.propagate(seeds, links, damping=0.5, rounds=3)
    pages = spark.createDataFrame([("h.org", "<a href=\"//x.net/1\"><a href='https://y.net'><a href=/own>")], "host string, html string")
    assert {r["dst"] for r in urls.host_links(pages).collect()} == {"x.net", "y.net"}


def test_sets_that_share_a_class_hash_are_told_apart():
    own, check = np.array([5, 5, 7]), np.array([1, 2, 3])
    got = ngram_join._parted(own, check, np.array([5]))
    assert len(set(got.tolist())) == 3 and got[2] == 7


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 7, 200, 900):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 5 :], rng.integers(0, 2**63, n // 6, dtype=np.uint64)]))
        bits = ngram_join.parity(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint64)
        assert sum(int(x).bit_count() for x in bits[0] ^ bits[1]) <= len(np.setxor1d(a, b))
