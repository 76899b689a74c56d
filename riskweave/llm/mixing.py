"""Mixing sources to target weights (operator 9), native: temperature mixing realised as budgeted block permutations.

Source i with token share p_i gets weight p_i**x / sum(p**x). The exponent x is bracketed until the weights' entropy
meets a target; if a source would then be repeated more often than a limit, x is raised until it is not. A source's
token budget is a number of whole passes (epochs) and a rest. Documents are dealt by hash into blocks of about
``BLOCK_TOKENS``; every epoch permutes the blocks of a source by hash, and the rest of the budget takes blocks in
that order, the last one document by document. Only blocks, not documents, are ranked per source, so a source with a
third of all rows costs no hot task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskweave.llm.common import materialise, read

BLOCK_TOKENS = 500_000
ENTROPY_SHARE = 0.98
REPETITION_LIMIT = 4.0
#: Tables of sources up to this many rows are broadcast.
BROADCAST_SOURCES = 10_000
_NONE = "\x00none"


def _grid(sources: DataFrame, low: float, high: float, total: float, points: int = 33) -> list[tuple[float, float, float]]:
    """(exponent, entropy of the weights, largest weight over share) on an even grid of exponents, in one aggregation of the sources."""
    xs = [low + (high - low) * k / (points - 1) for k in range(points)]
    own = sources.select(F.explode(F.array(*[F.lit(x) for x in xs])).alias("x"), (F.col("tokens") / total).alias("p"))
    own = own.withColumn("q", F.pow("p", "x"))
    z = own.groupBy("x").agg(F.sum("q").alias("z"), F.sum(F.col("q") * F.log("q")).alias("qlog"), F.max(F.col("q") / F.col("p")).alias("over"))
    found = z.select("x", (F.log("z") - F.col("qlog") / F.col("z")).alias("entropy"), (F.col("over") / F.col("z")).alias("over")).collect()
    return sorted((r["x"], r["entropy"], r["over"]) for r in found)


def solve_exponent(sources: DataFrame, *, total: float, budget: float, target_entropy: float | None, repetition_limit: float | None, rounds: int = 7) -> float:
    """The exponent in [0, 1] at which entropy falls to the target (0 if it never does from there, 1 if not below it), raised to where no source repeats beyond the limit."""

    def first(ok) -> float:
        low, high = 0.0, 1.0
        for _ in range(rounds):
            grid = _grid(sources, low, high, total)
            k = next((k for k, g in enumerate(grid) if ok(g)), None)
            if k is None:
                return 1.0
            if k == 0:
                return grid[0][0]
            low, high = grid[k - 1][0], grid[k][0]
        return high

    x = 1.0 if target_entropy is None else first(lambda g: g[1] <= target_entropy + 1e-12)
    if repetition_limit is not None:
        x = max(x, first(lambda g: g[2] * budget / total <= repetition_limit * (1 + 1e-12)))
    return x


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float | None = None, entropy_share: float | None = ENTROPY_SHARE,
    repetition_limit: float | None = REPETITION_LIMIT, block_tokens: int = BLOCK_TOKENS, seed: int = 0,
) -> DataFrame:
    """(id, source, n_tokens, epoch, block, position, order_key): one row for each time a document is drawn.

    ``budget`` tokens are drawn (default: as many as there are); the entropy target is ``entropy_share`` times that of
    equal weights. Order by (position, source, order_key) to read the mixture: position is the share of the source's
    budget drawn before the block, so sources interleave by weight. Tokens are runs of other than ASCII whitespace; a
    document without any (null or empty text) is drawn in every whole epoch and costs nothing. A null source is a
    source of its own; repeated rows are documents of their own; an empty table, or one without tokens, draws whole
    rows once.
    """
    base = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit(_NONE)).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint").alias("n_tokens"),
    )
    base = materialise(base, "lengths")
    sources = materialise(base.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    live = sources.where("tokens > 0")
    total, k = live.agg(F.sum("tokens"), F.count("*")).first()
    total = float(total or 0)
    budget = total if budget is None else float(budget)
    z = x = 1.0
    if k and total:
        target = None if entropy_share is None else entropy_share * math.log(k)
        x = solve_exponent(live, total=total, budget=budget, target_entropy=target, repetition_limit=repetition_limit)
        z = live.agg(F.sum(F.pow(F.col("tokens") / total, F.lit(x)))).first()[0]
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / (total or 1.0), F.lit(x)) / z).otherwise(F.lit(0.0))
    plan = sources.withColumn("weight", weight).withColumn("due", F.floor(F.col("weight") * budget + F.lit(1e-6)).cast("bigint"))
    plan = plan.withColumn("epochs", F.when(F.col("tokens") > 0, F.floor(F.col("due") / F.greatest("tokens", F.lit(1)))).otherwise(F.lit(1)).cast("bigint"))
    plan = plan.withColumn("rest", F.when(F.col("tokens") > 0, F.col("due") - F.col("epochs") * F.col("tokens")).otherwise(F.lit(0)).cast("bigint"))
    plan = plan.withColumn("blocks", F.ceil(F.greatest("tokens", F.lit(1)) / F.lit(block_tokens)).cast("bigint"))
    small = sources.count() <= BROADCAST_SOURCES
    held = F.broadcast(plan) if small else plan
    placed = base.join(held.select("source", "blocks"), "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id", "n_tokens"), F.col("blocks")).cast("bigint"))
    placed = placed.drop("blocks")

    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"))
    turns = blocks.join(held.select("source", "tokens", "due", "epochs", "rest"), "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs"))))
    turns = turns.withColumn("key", F.xxhash64(F.lit(seed), "source", "epoch", "block"))
    w = Window.partitionBy("source", "epoch").orderBy("key", "block").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    turns = turns.withColumn("take", F.when(F.col("epoch") < F.col("epochs"), F.col("size")).otherwise(F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("before")))))
    whole = F.col("epoch") < F.col("epochs")
    turns = turns.where(whole | (F.col("take") > 0))
    turns = turns.withColumn("position", (F.col("epoch") * F.col("tokens") + F.col("before")) / F.greatest("due", F.lit(1)))
    turns = materialise(turns.select("source", "block", "epoch", "take", "position", (whole | (F.col("take") == F.col("size"))).alias("all")), "turns")

    drawn = placed.join(turns, ["source", "block"]).withColumn("order_key", F.xxhash64(F.lit(seed), "epoch", "id", "n_tokens"))
    inner = Window.partitionBy("source", "block", "epoch").orderBy("order_key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = placed.join(turns.where("not `all`"), ["source", "block"]).withColumn("order_key", F.xxhash64(F.lit(seed), "epoch", "id", "n_tokens"))
    part = part.withColumn("reach", F.sum("n_tokens").over(inner)).where("reach <= take and n_tokens > 0").drop("reach")  # at most one block of each source
    out = drawn.where("`all`").unionByName(part)
    return out.select("id", F.when(F.col("source") != _NONE, F.col("source")).alias("source"), "n_tokens", "epoch", "block", "position", "order_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
