"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, html_text, language, line_dedup, lm_score, near_dedup, packing, quality_model, quality_rules, token_count

QUERIES = {
    "op1_language_id": language.query,
    "op2_near_dedup": near_dedup.query,
    "op3_quality_rules": quality_rules.query,
    "op4_html_extraction": html_text.query,
    "op5_decontamination": decontaminate.query,
    "op6_packing": packing.query,
    "op7_token_counts": token_count.query,
    "op8_quality_classifier": quality_model.query,
    "op9_lm_scoring": lm_score.query,
    "op10_line_dedup": line_dedup.query,
}
ORACLES = {"op3_quality_rules": quality_rules.ORACLE, "op10_line_dedup": line_dedup.ORACLE}
