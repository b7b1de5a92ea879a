"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from aquagrid.llm import (
    byte_bpe, language_id, lexical, lm_scoring, near_dedup, packing, quality, substring,
    token_counts, topk, toxicity, url_filter, vector_codes)

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1,
    "op2_best_fit_packing": packing.op2,
    "op3_quality_rules": quality.op3,
    "op4_url_filter": url_filter.op4,
    "op5_toxicity": toxicity.op5,
    "op6_token_counts": token_counts.op6,
    "op7_language_id": language_id.op7,
    "op8_near_dedup": near_dedup.op8,
    "op9_top_k": topk.op9,
    "op10_byte_bpe": byte_bpe.op10,
    "op11_substring_dedup": substring.op11,
    "op12_lexical_search": lexical.op12,
    "op13_vector_codes": vector_codes.op13,
}
ORACLES = {
    "op3_quality_rules": quality.ORACLE,
    "op9_top_k": topk.ORACLE,
    "op11_substring_dedup": substring.ORACLE,
    "op12_lexical_search": lexical.ORACLE,
    "op13_vector_codes": vector_codes.ORACLE,
}
