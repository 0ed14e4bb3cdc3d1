"""Queries and SQL of this subpackage, by the names that the entry module registers."""

from __future__ import annotations

from . import (
    chat_format,
    conversation_repair,
    embedding_dedup,
    filter_audit,
    license_scan,
    line_dedup,
    ngram_join,
    packing,
    quality_ranking,
    sentencepiece_viterbi,
    toxicity,
    url_filter,
    vector_search,
)


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.query,
        "op2_url_filter": url_filter.query,
        "op3_ngram_join": ngram_join.query,
        "op4_embedding_dedup": embedding_dedup.query,
        "op5_toxicity": toxicity.query,
        "op6_vector_search": vector_search.query,
        "op7_chat_format": chat_format.query,
        "op8_best_fit_packing": packing.query,
        "op9_sentencepiece": sentencepiece_viterbi.query,
        "op10_line_dedup": line_dedup.query,
        "op11_filter_audit": filter_audit.query,
        "op12_quality_ranking": quality_ranking.query,
        "op13_conversation_repair": conversation_repair.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.SQL,
        "op3_ngram_join": ngram_join.SQL,
        "op4_embedding_dedup": embedding_dedup.SQL,
        "op7_chat_format": chat_format.SQL,
        "op10_line_dedup": line_dedup.SQL,
        "op11_filter_audit": filter_audit.SQL,
        "op13_conversation_repair": conversation_repair.SQL,
    }
