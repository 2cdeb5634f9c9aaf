"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tabwright.llm import (
    alignment,
    chunks,
    embeddings,
    fingerprints,
    html,
    language,
    minhash,
    negatives,
    packing,
    pieces,
    quality,
    suffixes,
    tokenfiles,
)

QUERIES = {
    "op1_substring_dedup": chunks.op1_substring_dedup,
    "op2_embedding_near_dedup": embeddings.op2_embedding_near_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_language_id": language.op5_language_id,
    "op6_minhash_near_dedup": minhash.op6_minhash_near_dedup,
    "op7_suffix_array_dedup": suffixes.op7_suffix_array_dedup,
    "op8_html_extraction": html.op8_html_extraction,
    "op9_document_fingerprints": fingerprints.op9_document_fingerprints,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_token_files": tokenfiles.op12_token_files,
    "op13_token_alignment": alignment.op13_token_alignment,
}
#: Those that SQL cannot express are held against brute force in tests/llm.
SQL: dict[str, str] = {"op11_hard_negatives": negatives.OP11_SQL}
