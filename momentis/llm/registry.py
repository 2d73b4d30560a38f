"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from momentis.llm import bpe, conversation_repair, exact_topk, html_text, license_scan, near_dedup, packing, pii_surrogates, quality_classifier, quality_rules, suffix_dedup, token_alignment, token_counts


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_html_extraction": html_text.op2_html_extraction,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_bpe": bpe.op5_bpe,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_license_scans": license_scan.op7_license_scans,
        "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
        "op9_pii_surrogates": pii_surrogates.op9_pii_surrogates,
        "op10_exact_topk": exact_topk.op10_exact_topk,
        "op11_token_alignment": token_alignment.op11_token_alignment,
        "op12_quality_classifier": quality_classifier.op12_quality_classifier,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    found = {
        "op3_quality_rules": quality_rules.OP3_SQL,
        "op10_exact_topk": exact_topk.OP10_SQL,
        "op13_conversation_repair": conversation_repair.OP13_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in found.items() if sql}
