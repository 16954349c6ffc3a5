"""The queries of this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, context_mixing, decontamination, kneser_ney, licences, near_dedup, quality_rules, substring_dedup, token_shards, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_token_shards": token_shards.op3_token_shards,
        "op4_quality_classifier": kneser_ney.op4_quality_classifier,
        "op5_licences": licences.op5_licences,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_context_mixing": context_mixing.op8_context_mixing,
        "op9_byte_bpe": byte_bpe.op9_byte_bpe,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_licences": licences.ORACLE_SQL,
        "op6_near_dedup": near_dedup.ORACLE_SQL,
        "op7_substring_dedup": substring_dedup.ORACLE_SQL,
        "op10_quality_rules": quality_rules.ORACLE_SQL,
    }
