"""The queries of this subpackage, and SQL for those that have such a form."""

from __future__ import annotations

from . import decontaminate, line_dedup, near_dedup, paragraph_dedup, pii, quality_rules, secret_scan, sentencepiece_codec, suffix_dedup, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_pii": pii.op5_pii,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_paragraph_dedup": paragraph_dedup.op8_paragraph_dedup,
    "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
ORACLES = {
    "op1_near_dedup": near_dedup.SQL,
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op6_secret_scan": secret_scan.SQL,
    "op8_paragraph_dedup": paragraph_dedup.SQL,
    "op10_quality_rules": quality_rules.SQL,
}
