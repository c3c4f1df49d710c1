"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from tarnwork.llm import op10_toxicity, op11_pii, op12_filter_audit, op13_lexical_search, op1_url_rules, op2_language, op3_substring_dedup, op4_jaccard_join, op5_records, op6_cover_tree, op7_mixing, op8_quality, op9_packing

QUERIES = {
    "op1_url_rules": op1_url_rules.query,
    "op2_language_id": op2_language.query,
    "op3_substring_dedup": op3_substring_dedup.query,
    "op4_jaccard_join": op4_jaccard_join.query,
    "op5_token_records": op5_records.query,
    "op6_embedding_dedup": op6_cover_tree.query,
    "op7_mixing": op7_mixing.query,
    "op8_quality_rules": op8_quality.query,
    "op9_best_fit_packing": op9_packing.query,
    "op10_toxicity": op10_toxicity.query,
    "op11_pii": op11_pii.query,
    "op12_filter_audit": op12_filter_audit.query,
    "op13_lexical_search": op13_lexical_search.query,
}
ORACLES: dict[str, str] = {
    "op1_url_rules": op1_url_rules.SQL,
    "op4_jaccard_join": op4_jaccard_join.SQL,
    "op6_embedding_dedup": op6_cover_tree.SQL,
    "op8_quality_rules": op8_quality.SQL,
    "op12_filter_audit": op12_filter_audit.SQL,
    "op13_lexical_search": op13_lexical_search.SQL,
}
