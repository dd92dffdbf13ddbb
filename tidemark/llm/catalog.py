"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from tidemark.llm import (
    byte_bpe, centroids, decontamination, embedding_dedup, language, licenses, lm_scoring, near_duplicates, packing, quality,
    substring_dedup, suffix_dedup, whitening,
)

_QUERIES = {
    "op1_license_scan": (licenses.query, licenses.SQL),
    "op2_suffix_array_dedup": (suffix_dedup.query, suffix_dedup.SQL),
    "op3_ngram_jaccard": (near_duplicates.query, near_duplicates.SQL),
    "op4_language_id": (language.query, language.SQL),
    "op5_benchmark_decontamination": (decontamination.query, decontamination.SQL),
    "op6_embedding_dedup": (embedding_dedup.query, embedding_dedup.SQL),
    "op7_quality_classifier": (quality.query, quality.SQL),
    "op8_packing": (packing.query, packing.SQL),
    "op9_substring_dedup": (substring_dedup.query, substring_dedup.SQL),
    "op10_lm_scoring": (lm_scoring.query, lm_scoring.SQL),
    "op11_byte_bpe": (byte_bpe.query, byte_bpe.SQL),
    "op12_embedding_whitening": (whitening.query, whitening.SQL),
    "op13_centroid_clustering": (centroids.query, centroids.SQL),
}

QUERIES = {name: run for name, (run, _) in _QUERIES.items()}
SQL_CHECKS = {name: sql for name, (_, sql) in _QUERIES.items() if sql is not None}
