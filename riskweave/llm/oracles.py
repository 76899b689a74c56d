"""DuckDB SQL of the operators that SQL can express, over whole tables. Repeats are found by grouping every window, links by counting every shared shingle."""

from __future__ import annotations

from riskweave.llm import secret_scan

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: From m (doc_id, p) of repeated windows of {0} symbols: r, the maximal runs [a, b) of a document, each with the end of the one before.
_RUNS = """
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= {0} THEN 0 ELSE 1 END AS fresh FROM m),
i AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
q AS (SELECT doc_id, run, min(p) AS a, max(p) + {0} AS b FROM i GROUP BY doc_id, run),
r AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM q)"""

SUFFIX = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, h, (length(h) // 2)::BIGINT AS n FROM d),
o AS (SELECT doc_id, o, substr(h, 2 * o + 1, 1198) AS part FROM (SELECT doc_id, h, unnest(range(0, n - 199, 400)) AS o FROM s WHERE n >= 200)),
w AS MATERIALIZED (SELECT doc_id, o + p AS p, md5(substr(part, 2 * p + 1, 400)) AS k FROM (SELECT doc_id, o, part, unnest(range(0, least(400, length(part) // 2 - 199))) AS p FROM o)),
m AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),{_RUNS.format(200)}
SELECT s.doc_id, n AS n_bytes, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a)::BIGINT AS n_spans,
  sha256(unhex(coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), '') || substr(h, 2 * coalesce(max(b), 0) + 1))) AS kept_sha256
FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, n, h"""

RLZ = f"""
WITH s AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
e AS (SELECT doc_id, p, md5(array_to_string(w[p + 1:p + 35], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 34)) AS p FROM s WHERE len(w) >= 35)),
m AS (SELECT doc_id, p FROM e WHERE k IN (SELECT k FROM e GROUP BY k HAVING count(*) > 1)),{_RUNS.format(35)},
t AS (SELECT s.doc_id, w, coalesce(sum(b - a), 0)::BIGINT AS n_removed, coalesce(flatten(list(w[before + 1:a] ORDER BY a)), []) AS front, coalesce(max(b), 0) AS upto FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, w)
SELECT doc_id, len(w)::BIGINT AS n_words, n_removed, sha256(coalesce(array_to_string(list_concat(front, w[upto + 1:]), ' '), '')) AS kept_sha256 FROM t"""

JOIN = f"""
WITH RECURSIVE s AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(w[p + 1:p + 5], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS p FROM s WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS other FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other)
SELECT s.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, coalesce(min(reach.other), s.doc_id) AS component_id
FROM s LEFT JOIN n ON n.doc_id = s.doc_id LEFT JOIN reach ON reach.node = s.doc_id GROUP BY s.doc_id"""

_ALNUM = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATE = f"""
WITH s AS (SELECT doc_id, {_ALNUM.format(_FOLDED)} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM.format(_FOLDED)} AS w FROM benchmark),
iw AS (SELECT item_id, least(len(w), 10) AS size, array_to_string(w[p + 1:p + 10], ' ') AS k FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 9))) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM iw),
dw AS (SELECT doc_id, size, p, array_to_string(w[p + 1:p + size], ' ') AS k FROM (SELECT doc_id, size, w, unnest(range(0, len(w) - size + 1)) AS p FROM s, sizes WHERE len(w) >= size)),
hit AS (SELECT DISTINCT doc_id, item_id, dw.size, p FROM dw JOIN iw ON iw.k = dw.k AND iw.size = dw.size),
covered AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS x FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT s.doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.list, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM s LEFT JOIN covered ON covered.doc_id = s.doc_id LEFT JOIN items ON items.doc_id = s.doc_id"""

_TERMS = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"

LEXICAL = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS.format(_FOLDED)} AS w FROM documents),
g AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS docs, sum(len(w))::BIGINT AS total FROM t),
q AS (SELECT DISTINCT item_id, unnest({_TERMS.format(_FOLDED)}) AS term FROM benchmark),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
v AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, g GROUP BY term, docs),
i AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS impact FROM p JOIN v USING (term), g),
s AS (SELECT item_id, r, doc_id, sum(impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""

NEGATIVES = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.l = r.l AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""

_ASSIGN = secret_scan.ASSIGN.replace("'", "''")
_KINDS = {0: ("am", "ag", _ASSIGN, "av[i]", "length(av[i]) >= 6"), 1: ("km", "kg", secret_scan.ACCESS, "km[i]", "true"), 2: ("hm", "hg", secret_scan.HEX, "hm[i]", "true")}
#: From matches and the gaps around them: where match i starts, and the text with its kept matches blanked.
_START = "(list_sum(list_transform({1}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform({0}[1:i - 1], lambda x: length(x))), 0))::BIGINT"
_BLANK = "array_to_string(list_transform({1}, lambda g, i: g || coalesce(CASE WHEN {2} THEN repeat(' ', length({0}[i])) ELSE {0}[i] END, '')), '')"


def _split(text: str, pattern: str, hits: str, gaps: str) -> str:
    return f"regexp_extract_all({text}, '{pattern}') AS {hits}, regexp_split_to_array({text}, '{pattern}') AS {gaps}"


SECRETS = f"""
WITH a AS (SELECT doc_id, {", ".join(_split("coalesce(text, '')", pattern, hits, gaps) for hits, gaps, pattern, *_ in _KINDS.values())}, regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 2) AS av FROM documents),
s AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS kind, {hits}[i] AS m, {value} AS v, {_START.format(hits, gaps)} AS start FROM (SELECT *, unnest(range(1, len({hits}) + 1)) AS i FROM a) WHERE {keep}" for k, (hits, gaps, _, value, keep) in _KINDS.items())}),
c1 AS (SELECT doc_id, {_BLANK.format("am", "ag", "length(av[i]) >= 6")} AS t FROM a),
c2 AS (SELECT doc_id, {_BLANK.format("km", "kg", "true")} AS t FROM (SELECT doc_id, {_split("t", secret_scan.ACCESS, "km", "kg")} FROM c1)),
c3 AS (SELECT doc_id, {_BLANK.format("hm", "hg", "true")} AS t FROM (SELECT doc_id, {_split("t", secret_scan.HEX, "hm", "hg")} FROM c2)),
r AS (SELECT doc_id, rm[i] AS run, {_START.format("rm", "rg")} AS start FROM (SELECT *, unnest(range(1, len(rm) + 1)) AS i FROM (SELECT doc_id, {_split("t", secret_scan.RUN, "rm", "rg")} FROM c3))),
samples AS (SELECT v AS x, true AS random FROM s UNION ALL SELECT to_base64(unhex(sha256(doc_id::VARCHAR))), true FROM documents UNION ALL SELECT run, false FROM r WHERE NOT regexp_matches(run, '{secret_scan.MIXED}')),
n AS (SELECT random, CASE WHEN i = 1 THEN '' ELSE substr(x, i - 1, 1) END AS p, substr(x, i, 1) AS c, count(*) AS n FROM (SELECT random, x, unnest(range(1, length(x) + 1)) AS i FROM samples) GROUP BY ALL),
z AS (SELECT random, p, sum(n) AS n FROM n GROUP BY ALL),
l AS (SELECT unnest(string_split('{secret_scan.ALPHABET}', '')) AS c),
y AS (SELECT random, c, (coalesce(sum(n), 0) + 0.5::DOUBLE) / (sum(coalesce(sum(n), 0)) OVER (PARTITION BY random) + 34::DOUBLE) AS alone FROM l CROSS JOIN (VALUES (true), (false)) v(random) LEFT JOIN n USING (random, c) GROUP BY random, c),
e AS (SELECT random, p, c, (coalesce(n.n, 0) + 8 * alone) / (coalesce(z.n, 0) + 8) AS share FROM y CROSS JOIN (SELECT c AS p FROM l UNION ALL SELECT '') LEFT JOIN n USING (random, p, c) LEFT JOIN z USING (random, p)),
w AS (SELECT x.p, x.c, floor(1000 * log2(x.share / y.share) + 0.5)::BIGINT AS bits FROM e x JOIN e y ON x.p = y.p AND x.c = y.c AND x.random AND NOT y.random),
f AS (SELECT doc_id, start, start + length(run) AS stop FROM (SELECT *, unnest(range(1, length(run) + 1)) AS i FROM r WHERE length(run) >= 20)
  JOIN w ON w.p = CASE WHEN i = 1 THEN '' ELSE substr(run, i - 1, 1) END AND w.c = substr(run, i, 1) GROUP BY doc_id, start, run HAVING sum(bits) >= 20000),
u AS (SELECT doc_id, kind, start, start + length(m) AS stop FROM s UNION ALL SELECT doc_id, 3, start, stop FROM f),
o AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h, string_agg(said, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY start, kind) AS spans
  FROM (SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop AS said FROM u) GROUP BY doc_id)
SELECT a.doc_id, coalesce(o.a, 0)::BIGINT AS n_assign, coalesce(o.k, 0)::BIGINT AS n_access, coalesce(o.h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM a LEFT JOIN o USING (doc_id)"""

ORACLES = {"op3_decontaminate": DECONTAMINATE, "op4_suffix_dedup": SUFFIX, "op6_rlz_dedup": RLZ, "op7_ngram_join": JOIN, "op11_hard_negatives": NEGATIVES, "op12_secret_scan": SECRETS, "op13_lexical_search": LEXICAL}
