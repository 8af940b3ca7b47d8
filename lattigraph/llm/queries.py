"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontamination, fingerprints, html_cut, licenses, near_dedup, oracle, ordering, packing, quality, sharding


def queries() -> dict:
    return {
        "op1_chat_formatting": chat.op1_chat_formatting,
        "op2_packing": packing.op2_packing,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_training_order": ordering.op6_training_order,
        "op7_sharding": sharding.op7_sharding,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_fingerprints": fingerprints.op9_fingerprints,
        "op10_html_extraction": html_cut.op10_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested against brute force in tests/llm."""
    return oracle.oracle_sql()
