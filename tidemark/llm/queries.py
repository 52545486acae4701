"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import op1_quality_model, op2_repeated_strings, op3_decontaminate, op4_language_id, op5_warc_archive, op6_ngram_join, op7_html_text, op8_mix_sources, op9_quality_rules, op10_license_scan, op11_whitening, op12_token_alignment, op13_fingerprints

QUERIES = {
    "op1_quality_model": op1_quality_model.query,
    "op2_repeated_strings": op2_repeated_strings.query,
    "op3_decontaminate": op3_decontaminate.query,
    "op4_language_id": op4_language_id.query,
    "op5_warc_archive": op5_warc_archive.query,
    "op6_ngram_join": op6_ngram_join.query,
    "op7_html_text": op7_html_text.query,
    "op8_mix_sources": op8_mix_sources.query,
    "op9_quality_rules": op9_quality_rules.query,
    "op10_license_scan": op10_license_scan.query,
    "op11_whitening": op11_whitening.query,
    "op12_token_alignment": op12_token_alignment.query,
    "op13_fingerprints": op13_fingerprints.query,
}

#: Models, windows, page texts, components and tokens (1, 3, 4, 7, 10, 11, 12) have no SQL; tests/llm compares them with plain re-statements.
SQL = {
    "op2_repeated_strings": op2_repeated_strings.SQL,
    "op5_warc_archive": op5_warc_archive.SQL,
    "op6_ngram_join": op6_ngram_join.SQL,
    "op8_mix_sources": op8_mix_sources.SQL,
    "op9_quality_rules": op9_quality_rules.SQL,
    "op13_fingerprints": op13_fingerprints.SQL,
}
