"""Queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from docengine.llm import bpe, html, langid, licenses, merkle, mixing, ngrams, quality, simhash, urls


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_url_filter": urls.op2_url_filter,
        "op3_merkle_fingerprints": merkle.op3_merkle_fingerprints,
        "op4_html_main_text": html.op4_html_main_text,
        "op5_language_id": langid.op5_language_id,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_byte_bpe": bpe.op8_byte_bpe,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_lm_score": ngrams.op10_lm_score,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": urls.OP2_SQL, "op7_mix_sources": mixing.OP7_SQL, "op9_license_scan": licenses.OP9_SQL, "op10_lm_score": ngrams.OP10_SQL}
