"""URL filters (operator 8), native: host and path rules first, link-graph propagation for the rest.

Rules decide the pages they fit; the longest wins. From them each host gets a share of allowed and of blocked pages.
Trust spreads from allowed shares along links between hosts (personalised PageRank), distrust from blocked shares
against them: who links to blocked hosts is distrusted. A page without a rule is blocked when its host's distrust
exceeds its trust by more than ``THRESHOLD``. Links are aggregated to weighted host edges before anything joins
them, so a host with a third of all pages is one row of the graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.common import discard, materialise, read

#: Fixed values: (host, path prefix, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DAMPING = 0.85
#: Only a guard: a round shrinks what changes by the damping, so a fixed point comes long before.
ROUNDS = 1000
TOLERANCE = 1e-6
THRESHOLD = 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds ``rule`` (host + path of the longest fitting rule, else null) and ``ruled`` (its verdict, else null). A rule given twice blocks if either does."""
    order = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, say in reversed(order):
        fit = fits(F.col("host"), F.col("path"), host, path)
        rule, verdict = F.when(fit, F.lit(host + path)).otherwise(rule), F.when(fit, F.lit(say)).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


def host_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, weight) between different hosts: each host's absolute links, shared out over their targets."""
    found = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?i)href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1))
    found = F.transform(found, lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))  # no scheme: the page's own
    links = pages.where(F.col(html_col).contains("//")).select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(found, host_of))).alias("dst"))
    links = links.where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = links.groupBy("src").agg(F.sum("n").alias("all"))
    return links.join(total, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("weight"))


def propagate(seeds: DataFrame, links: DataFrame, *, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """r = seed + damping * (links' r), until no host changes by ``tolerance``: (host, r). ``seeds`` is (host, seed); ``links`` (src, dst, weight). Raises where ``rounds`` do not suffice."""
    r, last = seeds.select("host", F.col("seed").alias("r")), None
    for _ in range(rounds):
        flow = links.join(r, links["src"] == r["host"]).groupBy("dst").agg(F.sum(F.col("weight") * F.col("r")).alias("flow"))
        moved = seeds.join(flow, seeds["host"] == flow["dst"], "full").select(
            F.coalesce("host", "dst").alias("host"), (F.coalesce("seed", F.lit(0.0)) + damping * F.coalesce("flow", F.lit(0.0))).alias("now")
        )
        step = materialise(moved.join(r, "host", "left").select("host", F.col("now").alias("r"), F.abs(F.col("now") - F.coalesce("r", F.lit(0.0))).alias("change")), "rank")
        r = step.select("host", "r")
        if last is not None:
            discard(last)
        last = step
        if (step.agg(F.max("change")).first()[0] or 0.0) < tolerance:
            return r
    raise RuntimeError(f"ranks did not settle in {rounds} rounds")


def filter_urls(
    pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row.

    A null url, or one without ``://``, has empty host and path, fits no rule and is allowed by the method (an empty
    host is no node of the graph). Null html has no links. Hosts that no link and no rule reaches have trust and
    distrust 0 and are allowed. Repeated rows are judged each for itself; an empty table gives none.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    base = base.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = judge(base, rules)
    share = lambda say: F.avg(F.coalesce((F.col("ruled") == say).cast("double"), F.lit(0.0)))
    hosts = materialise(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    links = materialise(host_links(base), "links")
    trust = hosts.select("host", F.col("allowed").alias("seed"))
    distrust = hosts.select("host", F.col("blocked").alias("seed"))
    if links.isEmpty():
        trust, distrust = trust.withColumnRenamed("seed", "r"), distrust.withColumnRenamed("seed", "r")
    else:
        trust = propagate(trust, links, damping=damping, rounds=rounds)
        distrust = propagate(distrust, links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), damping=damping, rounds=rounds)
    scores = trust.select("host", F.col("r").alias("trust")).join(distrust.select("host", F.col("r").alias("distrust")), "host", "full")
    method = F.when(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)) > threshold, "block").otherwise("allow")
    return ruled.drop("html").join(scores, "host", "left").select(
        "id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def brute_force(pages: list[tuple], rules: list[tuple[str, str, str]] = RULES, *, damping: float = DAMPING, threshold: float = THRESHOLD) -> list[tuple]:
    """The definition, for tests: (page_id, host, path, rule, verdict)."""
    import re

    def split(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    judged, links = [], {}
    for page, url, html in pages:
        host, path = split(url)
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
        judged.append((page, host, path, best))
        own = {split(m)[0] for m in re.findall(r"(?i)href\s*=\s*[\"']?\s*([a-z][a-z0-9+.-]*://[^\"'\s>]+)", html or "")}
        for dst in own - {host, ""}:
            if host:
                links[host, dst] = links.get((host, dst), 0) + 1
    hosts = {h for _, h, _, _ in judged if h} | {d for _, d in links}
    out = {h: sum(n for (s, _), n in links.items() if s == h) for h in hosts}

    def rank(say, edges):
        own = {h: [b is not None and b[2] == say for _, x, _, b in judged if x == h] for h in hosts}
        seed = {h: sum(v) / len(v) if v else 0.0 for h, v in own.items()}
        r = dict(seed)
        for _ in range(200):
            r = {h: seed[h] + damping * sum(w * r[s] for s, d, w in edges if d == h) for h in hosts}
        return r

    forward = [(s, d, n / out[s]) for (s, d), n in links.items()]
    trust, distrust = rank("allow", forward), rank("block", [(d, s, w) for s, d, w in forward])
    return [
        (p, h, x, b and b[0] + b[1], b[2] if b else "block" if distrust.get(h, 0) - trust.get(h, 0) > threshold else "allow") for p, h, x, b in judged
    ]
