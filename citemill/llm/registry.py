"""Queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from citemill.llm import chat_format, fingerprints, language_id, mixing, near_dedup, packing, quality_rules, token_counts, toxicity, url_filters


def queries() -> dict:
    return {f.__name__: f for f in (
        toxicity.op1_toxicity, mixing.op2_mixing, token_counts.op3_token_counts, fingerprints.op4_fingerprints, near_dedup.op5_near_dedup, quality_rules.op6_quality_rules,
        chat_format.op7_chat_format, packing.op8_packing, url_filters.op9_url_filters, language_id.op10_language_id,
    )}


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_format": chat_format.SQL, "op9_url_filters": url_filters.SQL}
