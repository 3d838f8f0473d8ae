"""The queries of this package, one for each operator, with their oracle SQL."""

from __future__ import annotations

import corpus_pipeline

from . import chat_format, contamination, hard_negatives, language_id, lexical_search, license_scan, media, mixing, simhash, suffix_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_mixing_sources": mixing.query,
    "op2_chat_formatting": chat_format.query,
    "op3_suffix_array_dedup": suffix_dedup.query,
    "op4_media_columns": media.query,
    "op5_language_id": language_id.query,
    "op6_simhash_near_dedup": simhash.query,
    "op7_toxicity": toxicity.query,
    "op8_token_counts": token_counts.query,
    "op9_url_filters": url_filter.query,
    "op10_benchmark_decontamination": contamination.query,
    "op11_license_scans": license_scan.query,
    "op12_ranked_lexical_search": lexical_search.query,
    "op13_hard_negatives": hard_negatives.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE = {
    "op3_suffix_array_dedup": suffix_dedup.ORACLE,
    "op9_url_filters": url_filter.ORACLE,
    "op11_license_scans": license_scan.ORACLE,
    "op12_ranked_lexical_search": lexical_search.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
