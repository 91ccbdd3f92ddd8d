"""Queries of this package, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm import embeddings, langid, lines, mixture, oracles, passages, pieces, quality, simhash, substrings, tokencounts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_embedding_near_dedup": embeddings.op2_embedding_near_dedup,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_token_counts": tokencounts.op4_token_counts,
    "op5_source_mixing": mixture.op5_source_mixing,
    "op6_language_id": langid.op6_language_id,
    "op7_passage_dedup": passages.op7_passage_dedup,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "sentencepiece_decode": pieces.sentencepiece_decode,
}

#: DuckDB SQL where a query can be expressed in it at the cost of its tables.
ORACLES: dict[str, str] = oracles.ORACLES
