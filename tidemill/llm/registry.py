"""Queries of this folder and their SQL."""

from __future__ import annotations

from . import collocations, decontamination, filter_audit, html_text, language, line_dedup, neighbours, ngram_join, packing, pii, quality, quality_rules, token_output

QUERIES = {
    "op1_token_output": token_output.op1_token_output,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_packing": packing.op3_packing,
    "op4_neighbours": neighbours.op4_neighbours,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_pii": pii.op6_pii,
    "op7_html_text": html_text.op7_html_text,
    "op8_quality": quality.op8_quality,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_language": language.op10_language,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_collocations": collocations.op12_collocations,
    "op13_filter_audit": filter_audit.op13_filter_audit,
    "quality_rule_ablations": quality_rules.quality_rule_ablations,
}
ORACLES = {
    "op2_ngram_join": ngram_join.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op6_pii": pii.ORACLE_SQL,
    "op11_quality_rules": quality_rules.ORACLE_SQL,
    "op12_collocations": collocations.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
    "quality_rule_ablations": quality_rules.ABLATION_SQL,
}
