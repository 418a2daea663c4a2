"""Queries of the training-data operators, by name, and SQL where SQL expresses them."""

from __future__ import annotations

from kindred.llm import bpe, chat, classifiers, embedding_dedup, hard_negatives, html_text, line_dedup, mixing, oracles, quality, secrets, simhash, vector_codes


def queries() -> dict:
    return {
        "op1_embedding_near_dedup": embedding_dedup.op1_embedding_near_dedup,
        "op2_byte_bpe": bpe.op2_byte_bpe,
        "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
        "op4_html_extraction": html_text.op4_html_extraction,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_quality_classifier": classifiers.op7_quality_classifier,
        "op8_language_id": classifiers.op8_language_id,
        "op9_preference_pairs": chat.op9_preference_pairs,
        "op10_secret_scans": secrets.op10_secret_scans,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_line_dedup": line_dedup.op13_line_dedup,
    }


def oracle_sql() -> dict:
    return dict(oracles.SQL)
