"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_tokens, op2_fingerprints, op3_search, op4_packing, op5_toxicity, op6_secrets, op7_binary, op8_mixing, op9_dedup, op10_language, op11_ranking, op12_runs, op13_quality


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_tokens.query,
        "op2_fingerprints": op2_fingerprints.query,
        "op3_exact_top_k": op3_search.query,
        "op4_packing": op4_packing.query,
        "op5_toxicity": op5_toxicity.query,
        "op6_secrets": op6_secrets.query,
        "op7_token_binary": op7_binary.query,
        "op8_mixing": op8_mixing.query,
        "op9_near_dedup": op9_dedup.query,
        "op10_language": op10_language.query,
        "op11_ranked_search": op11_ranking.query,
        "op12_periodic_runs": op12_runs.query,
        "op13_quality": op13_quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_top_k": op3_search.ORACLE, "op9_near_dedup": op9_dedup.ORACLE, "op11_ranked_search": op11_ranking.ORACLE}
