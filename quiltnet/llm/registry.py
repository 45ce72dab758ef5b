"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import centroids, decontaminate, hard_negatives, jaccard_join, license_scan, lm_score, mixing, pii, quality_model, quality_rules, suffix_dedup, token_files, url_trust

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_pii_field": pii.op2_pii_field,
    "op3_lm_score": lm_score.op3_lm_score,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_url_trust": url_trust.op5_url_trust,
    "op6_token_files": token_files.op6_token_files,
    "op7_quality": quality_model.op7_quality,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_rule_ledger": quality_rules.op9_rule_ledger,
    "op10_cube_mix": mixing.op10_cube_mix,
    "op11_elkan": centroids.op11_elkan,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_license_scan": license_scan.op13_license_scan,
}
ORACLE = {
    "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op9_rule_ledger": quality_rules.OP9_SQL,
    "op11_elkan": centroids.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_license_scan": license_scan.OP13_SQL,
}
