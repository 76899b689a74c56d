"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from riskweave.llm.common import materialise, read


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model, trained on the labels, does not reject."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines; documents stay."""
    return line_dedup.dedup_lines(docs)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return ngram_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out of the texts; documents stay."""
    return decontaminate.remove_contamination(docs, read(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents with epoch, block, position and order key; order by (position, source, order_key) to read the mixture."""
    return mixing.mix(docs).select(F.col("id").alias("doc_id"), "source", "n_tokens", "epoch", "block", "position", "order_key")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_join", join_stage),
    ("decontaminate", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL cannot express the trained model or the hashed permutations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
