"""Queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from . import decontaminate, html_extract, language, lm_scoring, near_dedup, perplexity, piece_sampling, quality, token_files, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_quality": quality.op3_quality,
        "op4_language": language.op4_language,
        "op5_html_extract": html_extract.op5_html_extract,
        "op6_piece_sampling": piece_sampling.op6_piece_sampling,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_token_files": token_files.op8_token_files,
        "op9_lm_scoring": lm_scoring.op9_lm_scoring,
        "op10_quality_rules": perplexity.op10_quality_rules,
    }


def oracle_sql() -> dict:
    return {"op1_url_filter": url_filter.op1_sql(), "op2_decontaminate": decontaminate.op2_sql(), "op7_near_dedup": near_dedup.op7_sql()}
