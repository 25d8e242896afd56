"""The queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from gnomon.llm import bitpack, decontam, hardneg, html, langid, packing, pii, quality, ranked, simhash, substring, suffix, webp

QUERIES = {
    "op1_substring_dedup": substring.query,
    "op2_main_text": html.query,
    "op3_language_id": langid.query,
    "op4_simhash": simhash.query,
    "op5_packing": packing.query,
    "op6_token_ids": bitpack.query,
    "op7_decontamination": decontam.query,
    "op8_quality": quality.query,
    "op9_suffix_dedup": suffix.query,
    "op10_media": webp.query,
    "op11_personal_data": pii.query,
    "op12_ranked_search": ranked.query,
    "op13_hard_negatives": hardneg.query,
}
SQL = {
    "op1_substring_dedup": substring.SQL,
    "op7_decontamination": decontam.SQL,
    "op12_ranked_search": ranked.SQL,
    "op13_hard_negatives": hardneg.SQL,
}
