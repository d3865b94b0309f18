"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from stridemap.llm import (
    binary_output,
    decontamination,
    divergence,
    exact_dedup,
    html_text,
    lang_id,
    merkle,
    ngram_join,
    packing,
    substring_dedup,
    token_counts,
    url_filter,
    warc_revisit,
)

QUERIES = {
    "op1_warc_revisit": warc_revisit.op1_warc_revisit,
    "op2_lang_id": lang_id.op2_lang_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_packing": packing.op4_packing,
    "op5_html_text": html_text.op5_html_text,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_merkle": merkle.op11_merkle,
    "op12_binary_output": binary_output.op12_binary_output,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLE_SQL = {
    "op1_warc_revisit": warc_revisit.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op6_ngram_join": ngram_join.OP6_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op11_merkle": merkle.OP11_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
