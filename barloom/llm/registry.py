"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, bpe, embedding_dedup, hard_negatives, html_extract, mixing, near_dedup, packing, quality_rules, secret_scan, suffix_dedup, toxicity, url_filters


def queries() -> dict:
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_bpe_round_trip": bpe.op2_bpe_round_trip,
        "op3_html_extract": html_extract.op3_html_extract,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_near_dedup": near_dedup.op5_near_dedup,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_embedding_dedup": embedding_dedup.op9_embedding_dedup,
        "op10_url_filters": url_filters.op10_url_filters,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_cross_tokenizer": alignment.op12_cross_tokenizer,
        "op13_source_mixing": mixing.op13_source_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": quality_rules.ORACLE, "op10_url_filters": url_filters.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE}
