"""Queries of this package: name -> builder, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from . import (bpe, cotraining, decontaminate, fill_middle, importance, jaccard_join, language_id, line_dedup,
               quality_rules, secret_scan, substring_dedup, toxicity, url_rules)

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_line_dedup": line_dedup.op2,
    "op3_quality_rules": quality_rules.op3,
    "op4_cotraining": cotraining.op4,
    "op5_url_rules": url_rules.op5,
    "op6_bpe": bpe.op6,
    "op7_language_id": language_id.op7,
    "op8_decontaminate": decontaminate.op8,
    "op9_secret_scan": secret_scan.op9,
    "op10_jaccard_join": jaccard_join.op10,
    "op11_fill_middle": fill_middle.op11,
    "op12_toxicity": toxicity.op12,
    "op13_importance": importance.op13,
}

ORACLE: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op5_url_rules": url_rules.ORACLE_SQL,
    "op9_secret_scan": secret_scan.ORACLE_SQL,
    "op11_fill_middle": fill_middle.ORACLE_SQL,
    "op13_importance": importance.ORACLE_SQL,
}
