"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termflow.llm import bpe, decontam, language_id, near_dedup, quality_rules, rule_ensemble, secrets, suffix_dedup, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_secrets": secrets.query, "op2_language_id": language_id.query, "op3_near_dedup": near_dedup.query, "op4_quality": rule_ensemble.query, "op5_url_filter": url_filter.query, "op6_bpe": bpe.query, "op7_quality_rules": quality_rules.query, "op8_toxicity": toxicity.query, "op9_suffix_dedup": suffix_dedup.query, "op10_decontamination": decontam.query}


def oracle_sql() -> dict[str, str]:
    return {"op3_near_dedup": near_dedup.SQL, "op5_url_filter": url_filter.SQL, "op7_quality_rules": quality_rules.SQL, "op9_suffix_dedup": suffix_dedup.SQL}
