"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from folioframe.llm import (
    byte_bpe,
    exact_dedup,
    jaccard_join,
    language_id,
    lm_scoring,
    mixing,
    piece_chunks,
    quality_classifier,
    quality_rules,
    ranked_search,
    spelling_variants,
    substring_dedup,
    url_filters,
)

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_language_id": language_id.op2_language_id,
    "op3_jaccard_join": jaccard_join.op3_jaccard_join,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_ranked_search": ranked_search.op12_ranked_search,
    "op13_sentencepiece": piece_chunks.op13_sentencepiece,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op3_jaccard_join": jaccard_join.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE,
    "op10_url_filters": url_filters.ORACLE,
    "op11_spelling_variants": spelling_variants.ORACLE,
    "op12_ranked_search": ranked_search.ORACLE,
}
