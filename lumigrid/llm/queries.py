"""The queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from . import chat, divergence, jaccard, licenses, media, mixing, packing, pii, quality, substrings, token_files, vector_codes, wrappers

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_source_mixing": mixing.query,
    "op3_substring_dedup": substrings.query,
    "op4_chat_formatting": chat.query,
    "op5_jaccard_join": jaccard.query,
    "op6_media_columns": media.query,
    "op7_token_files": token_files.query,
    "op8_quality_rules": quality.query,
    "op9_license_scan": licenses.query,
    "op10_personal_data": pii.query,
    "op11_vector_codes": vector_codes.query,
    "op12_html_extraction": wrappers.query,
    "op13_source_divergence": divergence.query,
}

ORACLES: dict[str, str] = {
    "op11_vector_codes": vector_codes.ORACLE,
    "op13_source_divergence": divergence.ORACLE,
}
