"""Queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from placewright.llm import chat_format, decontaminate, exact_dedup, html_text, language_id, lexical_search, license_scan, near_dedup, packing, repeat_removal, sharding, source_audit, toxicity


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_sharding": sharding.op2_sharding,
        "op10_repeat_removal": repeat_removal.op10_repeat_removal,
        "op3_chat_format": chat_format.op3_chat_format,
        "op4_packing": packing.op4_packing,
        "op5_decontamination": decontaminate.op5_decontamination,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_html_text": html_text.op8_html_text,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op11_source_audit": source_audit.op11_source_audit,
        "op12_lexical_search": lexical_search.op12_lexical_search,
        "op13_license_scan": license_scan.op13_license_scan,
    }


def oracle_sql() -> dict:
    return {
        "op3_chat_format": chat_format.ORACLE,
        "op6_near_dedup": near_dedup.ORACLE,
        "op9_exact_dedup": exact_dedup.ORACLE,
        "op11_source_audit": source_audit.ORACLE,
        "op12_lexical_search": lexical_search.ORACLE,
        "op13_license_scan": license_scan.ORACLE,
    }
