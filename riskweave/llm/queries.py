"""Driver queries of the training-data operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm import decontaminate, fingerprint, hard_negatives, lexical, line_dedup, lm, mixing, ngram_join, rlz, secret_scan, suffix_dedup, toxicity, urls
from riskweave.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": toxicity.query,
    "op2_fingerprint": fingerprint.query,
    "op3_decontaminate": decontaminate.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_line_dedup": line_dedup.query,
    "op6_rlz_dedup": rlz.query,
    "op7_ngram_join": ngram_join.query,
    "op8_url_filter": urls.query,
    "op9_mixing": mixing.query,
    "op10_lm_score": lm.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_secret_scan": secret_scan.query,
    "op13_lexical_search": lexical.query,
}
