"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, license_scan, mixing, paragraph_dedup, pii_crf, quality_fm, sharding, simhash_trie, syncmers


def queries() -> dict:
    return {
        "op1_license_scan": license_scan.query,
        "op2_decontamination": decontaminate.query,
        "op3_pii": pii_crf.query,
        "op4_sharding": sharding.query,
        "op5_quality_classifier": quality_fm.query,
        "op6_mixing": mixing.query,
        "op7_paragraph_dedup": paragraph_dedup.query,
        "op8_simhash_near_dedup": simhash_trie.query,
        "op9_chat_formatting": chat_format.query,
        "op10_document_fingerprints": syncmers.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.SQL, "op6_mixing": mixing.SQL, "op9_chat_formatting": chat_format.SQL, "op10_document_fingerprints": syncmers.SQL}
