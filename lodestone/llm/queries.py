"""The queries of this subpackage: op1 to op10 and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import bpe, mixing, nearcopies, oracles, planes, quality, rules, runindex, secrets, substrings, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_substring_dedup": substrings.op2_substring_dedup,
    "op3_source_mix": mixing.op3_source_mix,
    "op4_near_copies": nearcopies.op4_near_copies,
    "op5_quality_scores": quality.op5_quality_scores,
    "op6_run_index_dedup": runindex.op6_run_index_dedup,
    "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
    "op8_quality_rules": rules.op8_quality_rules,
    "op9_token_planes": planes.op9_token_planes,
    "op10_near_vectors": vectors.op10_near_vectors,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRINGS,
    "op3_source_mix": mixing.ORACLE_SQL,
    "op4_near_copies": oracles.NEAR_COPIES,
    "op8_quality_rules": oracles.RULES,
    "op10_near_vectors": vectors.ORACLE_SQL,
}
