"""Queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from geolink.llm import (
    centroid_clustering, conversation_repair, document_fingerprints, embedding_dedup, html_extraction, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, sentencepiece_codec, sharding,
    substring_dedup,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_sharding": sharding.op2_sharding,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op5_run_dedup": line_dedup.op5_run_dedup,
    "op6_sentencepiece": sentencepiece_codec.op6_sentencepiece,
    "op7_html_extraction": html_extraction.op7_html_extraction,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op10_near_copies": embedding_dedup.op10_near_copies,
    "op11_centroid_clustering": centroid_clustering.op11_centroid_clustering,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_document_fingerprints": document_fingerprints.op13_document_fingerprints,
}

ORACLE_SQL = {
    "op1_mixing": mixing.SQL,
    "op2_sharding": sharding.SQL,
    "op3_substring_dedup": substring_dedup.SQL,
    "op4_ngram_join": ngram_join.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op5_run_dedup": line_dedup.RUN_SQL,
    "op8_quality_rules": quality_rules.SQL,
    "op10_embedding_dedup": embedding_dedup.SQL,
    "op10_near_copies": embedding_dedup.COPIES_SQL,
    "op11_centroid_clustering": centroid_clustering.SQL,
    "op12_conversation_repair": conversation_repair.SQL,
}
