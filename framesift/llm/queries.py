"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    kdtree,
    language_id,
    mixing,
    ngram_join,
    pieces,
    preference,
    quality_classifier,
    quality_rules,
    token_rollup,
    toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.query,
    "op2_toxicity": toxicity.query,
    "op3_language_id": language_id.query,
    "op4_exact_topk": kdtree.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_ngram_jaccard_join": ngram_join.query,
    "op7_sentencepiece": pieces.query,
    "op8_token_counts": token_rollup.query,
    "op9_mixing": mixing.query,
    "op10_chat_formatting": preference.query,
    "quality_base_rules": quality_rules.base_query,
    "mixing_targets": mixing.targets_query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_topk": kdtree.ORACLE,
    "op6_ngram_jaccard_join": ngram_join.ORACLE,
    "op10_chat_formatting": preference.ORACLE,
    "quality_base_rules": quality_rules.BASE_ORACLE,
    "mixing_targets": mixing.TARGETS_ORACLE,
}
