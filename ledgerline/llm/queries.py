"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, ctw, decontaminate, jaccard, langid, pages, quality, token_counts, toxicity, urls

QUERIES = {
    "op1_byte_bpe": bpe.op1,
    "op2_ngram_jaccard": jaccard.op2,
    "op3_html_text": pages.op3,
    "op4_url_filters": urls.op4,
    "op5_toxicity": toxicity.op5,
    "op6_context_tree": ctw.op6,
    "op7_language_id": langid.op7,
    "op8_token_counts": token_counts.op8,
    "op9_decontamination": decontaminate.op9,
    "op10_quality_rules": quality.op10,
}
ORACLES: dict[str, str] = {"op4_url_filters": urls.ORACLE}
